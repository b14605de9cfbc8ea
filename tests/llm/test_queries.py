"""The contract queries on the smallest tables, against SQL or brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
import tokenizers

from tenun.llm import queries
from tenun.llm.minhash import banded_similarity
from tenun.llm.url_filter import host_of
from tenun.llm.words import word_hashes
from tests.test_queries import TABLES, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return found


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name]))


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_near_duplicates(spark, docs):
    """Against the alignment of all pairs of documents."""
    split = {i: word_hashes([t])[0][0] >> np.uint64(32) for i, t in docs.items()}
    head = {i: i for i in docs}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (docs[i] or "") == (docs[j] or "") or find(i) != find(j) and banded_similarity(split[i], split[j]):
                x, y = sorted((find(i), find(j)))
                head[y] = x
    rows = queries.op1_minhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: find(i) for i in ids}
    assert {r.doc_id: r.class_size for r in rows} == {i: sum(find(j) == find(i) for j in ids) for i in ids}


def test_language(spark, duck, docs):
    truth = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.op2_language_id(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) / len(own) > 0.95


def test_toxicity(spark, docs):
    rows = queries.op3_toxicity(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in queries.op7_fingerprints(spark, SF).collect()}
    order = sorted(docs)
    prints = {}
    for k, i in enumerate(order):
        own, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
        share = lambda a, b: sum(x == y for x, y in zip(a.split("-"), b.split("-"))) / len(a.split("-"))
        assert r.near_next == share(r.fingerprint, rows[order[(k + 1) % len(order)]].fingerprint)
        assert r.near_edited == share(r.fingerprint, r.edited_fingerprint)
    assert len(rows) == len(docs)


def test_packing(spark, docs):
    """Every piece holds its document's ids, sequences are gapless and full, and they are as few as can be but one."""
    rows = queries.op8_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and [f.name for f in queries.op8_packing(spark, SF).schema][:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    tokenizer = tokenizers.Tokenizer.from_file(queries.tokenizer_file())
    for doc_id, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 2048 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r.start == at and 0 < r.length <= 2048 and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(pieces) == 1)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_chat(spark, duck):
    rows = {r.conv_id: r for r in queries.op10_chat_format(spark, SF).collect()}
    said = "</s>[INST] ok [/INST]"
    turns: dict[int, list] = {-7: [("user", said), ("assistant", said)]}
    for conv, role, text in duck.sql("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        turns.setdefault(conv, []).append((role, text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert set(rows) == set(turns)
    for conv, given in turns.items():
        learned = "".join(t for role, t in given if role == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.turns_sha256) == (len(given), sha("".join(f"{a}\n{b}\n" for a, b in given)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned)) and r.formatted_chars > r.loss_chars


def test_host_column(spark):
    row = spark.createDataFrame([("x://A.B:80\n/",)], "u string").select(host_of("u").alias("h")).first()
    assert row.h == "a.b:80\n"
