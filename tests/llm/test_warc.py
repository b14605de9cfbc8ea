import base64
import gzip
import hashlib
import io
import random

import pytest

from tenun.llm.warc import HTTP_HEAD, page_records, read_warc, record, salvage, write_warc
from tenun.sources.shared import Workspace


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def records(n, rng=None):
    rng = rng or random.Random(3)
    return [record("response", f"<urn:page:{k}>", f"http://x/{k}", HTTP_HEAD + rng.randbytes(rng.randrange(3000)), {}) for k in range(n)]


def ids(found):
    return [x.headers["warc-record-id"] for x in found if x.kind == "record"]


def covered(found, data):
    at = 0
    for x in found:
        assert x.offset == at
        at += x.length
    assert at == len(data)


def test_reads_members_and_plain_records():
    raw = records(20)
    data = b"".join(gzip.compress(r) if k % 2 else r for k, r in enumerate(raw))
    found = list(salvage(io.BytesIO(data)))
    assert len(ids(found)) == 20 and len(found) == 20
    covered(found, data)


def test_salvages_after_damage():
    rng = random.Random(4)
    for trial in range(60):
        raw = records(12, rng)
        parts = [gzip.compress(r) if trial % 2 else r for r in raw]
        hit = rng.randrange(12)
        kind = trial % 3
        if kind == 0:
            broken = bytearray(parts[hit])
            at = len(broken) // 2
            broken[at : at + 30] = bytes(b ^ 0x55 for b in broken[at : at + 30])
            parts[hit] = bytes(broken)
        elif kind == 1:
            parts[hit] = parts[hit][: len(parts[hit]) // 2]
        else:
            parts.insert(hit, rng.randbytes(500).replace(b"\x1f\x8b\x08", b"zzz").replace(b"WARC/", b"zzzzz"))
        data = b"".join(parts)
        found = list(salvage(io.BytesIO(data)))
        covered(found, data)
        want = [f"<urn:page:{k}>" for k in range(12) if kind == 2 or k != hit]
        assert set(want) <= set(ids(found))
        assert any(x.kind == "gap" and x.reason for x in found)


def test_damage_at_the_end_and_nothing():
    assert list(salvage(io.BytesIO(b""))) == []
    found = list(salvage(io.BytesIO(records(1)[0] + b"tail")))
    assert [x.kind for x in found] == ["record", "gap"] and found[1].length == 4
    assert [x.kind for x in salvage(io.BytesIO(b"junk" * 300_000))] == ["gap"]


def test_round_trip(spark):
    same, rows = "<p>größe 😀</p>", []
    rows += [(1, "http://a", same, 1), (5, "http://b", same, 1), (3, None, same, 1), (2, "http://c", None, 1), (4, "http://d\r\nX: y", "", 1), (6, "http://e", "WARC/1.0\r\n\r\n\x1f�", 1), (7, "u", "x" * 2_000_000, 1), (None, "u", same, 1), (8, "u", "WARC/1.1\r\nother", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    manifest = write_warc(pages, Workspace(spark, "warc"))
    assert sum(r.records for r in manifest.collect()) == len(rows)
    found = read_warc(manifest)
    assert found.where("kind = 'gap'").count() == 0
    got = sorted((tuple(r) for r in page_records(found).collect()), key=str)
    size = lambda t: len((t or "").encode())
    newest = {same: 5, None: 4, "": 4}
    want = []
    for i, _, t, _ in rows:
        n = newest.get(t, i)
        revisit = i is not None and n != i
        want.append((i, size(t), digest(t), "revisit" if revisit else "response", n if revisit else None))
    assert got == sorted(want, key=str)


def test_least_bytes_repeated_ids_and_empty(spark):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd")], schema)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in page_records(read_warc(write_warc(pages, Workspace(spark, "warc"), least=3))).collect())
    assert got == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert read_warc(write_warc(spark.createDataFrame([], schema), Workspace(spark, "warc"))).count() == 0


def test_files_are_cut(spark):
    pages = spark.createDataFrame([(k, "u", random.Random(k).randbytes(4000).hex()) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = write_warc(pages, Workspace(spark, "warc"), limit=20_000)
    assert manifest.count() > 4 and page_records(read_warc(manifest.repartition(3))).count() == 40


def test_headers_of_any_length(spark):
    long_url = "data:text/html," + "a b:c" * 60_000
    pages = [(1, "http://x/1", "same"), (2, long_url, "same"), (3, long_url, "other")]
    made = write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), Workspace(spark, "warc"))
    found = read_warc(made)
    assert found.where("kind = 'gap'").count() == 0
    assert {(r.page_id, r.record_type, r.refers_to) for r in page_records(found).collect()} == {(1, "revisit", 2), (2, "response", None), (3, "response", None)}
    plain = [record("response", f"<urn:page:{k}>", u, HTTP_HEAD, {}) for k, u, _ in pages]
    assert len(ids(salvage(io.BytesIO(b"".join(plain))))) == 3
    damaged = plain[2][:200_000] + plain[0] + plain[2][:100_000]
    found = list(salvage(io.BytesIO(damaged)))
    covered(found, damaged)
    assert ids(found) == ["<urn:page:1>"] and {x.reason for x in found} == {"", "header not ended"}


def test_gaps_can_be_errors(spark):
    schema = "path string, kind string, offset long, length long, reason string, headers map<string,string>, block binary"
    rows = [("f", "record", 0, 9, "", {"warc-type": "response", "warc-record-id": "<urn:page:1>"}, b"h\r\n\r\nx"), ("f", "gap", 9, 5, "member damaged", {}, b"")]
    found = spark.createDataFrame(rows, schema)
    assert [r.page_id for r in page_records(found).collect()] == [1]
    with pytest.raises(Exception, match="gap: f 9 member damaged"):
        page_records(found, strict=True).collect()
    assert page_records(found.where("kind = 'record'"), strict=True).count() == 1
