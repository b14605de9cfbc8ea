import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from tenun.llm import filter_audit
from tenun.llm.filter_audit import audit_filters, failure_masks
from tests.llm.fixtures import edge_docs, edge_rows, no_docs, text

LABELS = "doc_id long, quality int, toxic int, source string, text string"


def fails(docs):
    """Plain loops: the letters that each row fails, in order of the rows."""
    out = []
    for doc_id, given, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", given or "")
        found = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", given or "")) > 2 * len(given or ""),
            "D": bool(re.search("[#$%&*|]", given or "")),
            "E": doc_id is not None and any(d[0] is not None and d[0] < doc_id and (d[1] or "") == (given or "") for d in docs),
        }
        out.append({k for k, v in found.items() if v})
    return out


def brute(docs, labels):
    good = {i for i, quality, *_ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad, *_ in labels if bad == 1 and i is not None}
    failed = fails(docs)
    parts = defaultdict(list)
    for row, f in zip(docs, failed):
        parts[row[3] or ""].append((row[0], f))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = [x for x in rows if letter in x[1]]
                total[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(len(x[1]) == 1 for x in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


def material(rng, n):
    texts = [text(rng, rng.randrange(150, 260), rng.choice([40, 4000])) + rng.choice(["", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4]) for _ in range(n // 3)] + ["", None]
    return [(rng.randrange(n * 2), rng.choice(texts), "en", rng.choice(["a", "b", "", None])) for _ in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = material(rng, 200) + [(None, "x", "en", "a"), (None, "x", "en", None)]
    labels = [(rng.randrange(400), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "s", "t") for _ in range(150)] + [(None, 1, 1, "s", "t")]
    spread = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(7)
    want = brute(docs, labels)
    table = spark.createDataFrame(labels, LABELS)
    assert rows_of(audit_filters(spread, table)) == want
    monkeypatch.setattr(filter_audit, "_HELD_BYTES", 2000)
    assert rows_of(audit_filters(spread, table)) == want


def test_masks_by_id(spark):
    docs = [(5, "b", "", "s"), (2, "b", "", "s"), (2, "b", "", "t"), (9, "B", "", None), (7, None, "", "s"), (8, "", "", "s")]
    found = failure_masks(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3))
    assert {(r.id, r.part, r.mask >> 4, r.rows) for r in found.collect()} == {(5, "s", 1, 1), (2, "s", 0, 1), (2, "t", 0, 1), (9, "", 0, 1), (7, "s", 0, 1), (8, "s", 1, 1)}


def test_hashes_that_collide(spark, monkeypatch):
    rows = [(0, i, "s", t) for i, t in enumerate(["a", "b", "a", "c", "b", "a"])]
    routed = [x for part in (rows[:3], rows[3:]) for x in filter_audit._local(part, {}, 1)]
    found = sorted((i, mask) for i, _, mask, _ in filter_audit._routed([(0, v) for _, v in routed], 1))
    assert found == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1)]


def test_copies_are_routed_once_a_task():
    rows = [(1, i, "s", "the same") for i in range(1000, 0, -1)]
    sent = list(filter_audit._local(rows, {}, 1))
    assert sum(v[0] is not None for _, v in sent) == 1 and len(sent) == 1000


def test_string_ids_and_other_filters(spark):
    docs = spark.createDataFrame([("k2", "aa", "p"), ("k1", "aa", "p"), ("k3", "z", "p")], "key string, body string, site string")
    labels = spark.createDataFrame([("k2", 1, 0)], "key string, quality int, toxic int")
    found = audit_filters(docs, labels, {"Z": lambda text, raw, words: "z" in text}, "D", "key", "body", "site")
    assert rows_of(found) == {("p", "ZD", 1): [2, 1, 0, 1, 0, 0, 2], ("p", "ZD", 2): [1, 1, 0, 1, 1, 0, 2], ("p", "DZ", 1): [2, 1, 0, 1, 1, 0, 2], ("p", "DZ", 2): [1, 1, 0, 1, 0, 0, 2]}


def test_edge_cases(spark):
    labels = [(7, 1, 0, "s", "t"), (5, 0, 1, None, None)]
    assert rows_of(audit_filters(edge_docs(spark), spark.createDataFrame(labels, LABELS))) == brute(edge_rows(), labels)
    assert audit_filters(no_docs(spark), spark.createDataFrame([], LABELS)).count() == 0
    docs = [(1, "x", "", "s"), (1, "x", "", "s")]
    assert rows_of(audit_filters(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame([], LABELS))) == brute(docs, [])
