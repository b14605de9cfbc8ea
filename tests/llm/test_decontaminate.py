import random

from tenun.llm.decontaminate import ItemIndex, contaminated, without_contamination
from tenun.llm.words import shingle_hashes, word_hashes
from tests.llm.fixtures import edge_docs, no_docs, words


def brute(docs, items, least=0.8):
    shingles = lambda t: set(shingle_hashes(word_hashes([t])[0][0]).tolist())
    out = {}
    for d, t in docs:
        have = shingles(t)
        for i, x in items:
            own = shingles(x)
            if own and len(own & have) / len(own) >= least:
                out[d, i] = max(out.get((d, i), 0), len(own & have) / len(own))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, rng.choice([3, 5, 6, 12, 30, 60, 200]), 10**5))) for k in range(60)]
    docs = []
    for d in range(120):
        body = words(rng, rng.choice([0, 4, 50, 400, 5000]), 10**5)
        if d % 3 == 0:
            own = items[rng.randrange(60)][1].upper().split()
            if d % 2:
                own = own[: max(1, int(len(own) * rng.uniform(0.7, 1)))]
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((d, ", ".join(body)))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.containment for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 20 and got == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    import tenun.llm.decontaminate as module

    rng = random.Random(12)
    items = [(k, " ".join(words(rng, 20, 10**5))) for k in range(9)]
    docs = spark.createDataFrame([(k, f"x y z {t} and more") for k, t in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, contaminated(docs, table).collect()))
    monkeypatch.setattr(module, "ITEMS_PER_BLOCK", 2)
    assert sorted(map(tuple, contaminated(docs, table).collect())) == whole and len(whole) == 9


def test_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "four words are few"), (None, "a text without an id"), (4, "w1 w2 w3 w4 w5"), (4, "w1 w2 w3 w4 w5")], "item_id long, text string")
    docs = edge_docs(spark)
    rows = contaminated(docs, items).collect()
    assert [tuple(r) for r in rows] == [(None, None, 1.0)]
    assert contaminated(no_docs(spark), items).count() == 0
    empty = contaminated(docs, items.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "item_id", "containment"]
    assert without_contamination(docs, contaminated(docs, items)).count() == docs.count()
    assert not ItemIndex([(1, "too few")]).classes


def test_items_of_few_shingles_are_not_missed(spark):
    rng = random.Random(13)
    items = [(k, " ".join(words(rng, 5 + k % 4, 10**6))) for k in range(40)]
    docs = []
    for d in range(800):
        body = words(rng, 60, 10**6)
        at = rng.randrange(61)
        docs.append((d, " ".join([*body[:at], items[d % 40][1], *body[at:]])))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, d % 40) for d in range(800)}
