"""Each stage on its own input, and the whole, against brute force."""

import random

import pytest

import corpus_pipeline
from tests.llm.fixtures import edge_docs, text, words
from tests.llm.test_decontaminate import brute as contaminated_brute
from tests.llm.test_line_chunks import brute as chunks_brute
from tests.llm.test_minhash import brute_classes, edited

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    root = tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    items = [(k, " ".join(words(rng, 25, 10**5))) for k in range(6)]
    passage = text(rng, 80, 10**5)
    for k in range(260):
        body = text(rng, rng.randrange(40, 160), 3000)
        toxic = int(k % 6 == 0)
        if toxic:
            body = " ".join(f"{w} zorched" if i % 5 == 0 else w for i, w in enumerate(body.split(" ")))
        if k % 20 == 3:
            body += f"\n{passage}\nend {k}"
        if k % 20 == 7:
            body = f"{items[k % 6][1]}\n{body}"
        if k % 20 == 9 and k > 20:
            body = " ".join(edited(rng, docs[k - 8][1].split(" "), 2))
        docs.append((k, body, "en", f"s{k % 3}", len(body)))
        labels.append((k, 1, toxic))
    docs += [(300, docs[1][1], "en", "s", None), (301, None, None, None, None), (302, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()} if name != "packing" else {}
        texts = {i: r.text or "" for i, r in before.items()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            wrong = [i for i in before if (i not in after) != bool(truth.get(i))]
            assert len(wrong) <= 0.03 * len(before) and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            want = chunks_brute([(i, t) for i, t in texts.items() if before[i].text is not None])
            assert {i: r.text for i, r in after.items() if r.text is not None} == {i: t for i, (t, _) in want.items()}
            assert set(after) == set(before) and all(r.n_chars == len(r.text) for i, r in after.items() if want.get(i, ("", 0))[1])
        elif name == "minhash_near_dedup":
            classes = brute_classes(texts)
            assert set(after) == set(classes.values()) and all(after[i] == before[i] for i in after)
        elif name == "decontamination":
            assert set(before) - set(after) == {d for d, _ in contaminated_brute(list(texts.items()), items)}
        else:
            assert {r.doc_id for r in docs.collect()} == set(before)


def test_run_equals_its_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, docs.collect()))


def test_edges_of_every_stage(spark, sf_dir):
    """Nulls, empty and long texts, repeated ids and columns with names that the operators use themselves."""
    given = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf_dir)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in given.collect()}
            continue
        assert out.columns == given.columns
        kept = out.collect()
        lost = {r.doc_id for r in given.collect()} - {r.doc_id for r in kept}
        assert lost <= ({2, 6, 8} if name == "minhash_near_dedup" else {1, 2, 3, 4, 9, 10, 11, 12, 13, 5, 6, 7, 8} if name == "toxicity" else set())
        assert sum(r.doc_id is None for r in kept) == 2
        bare = stage(spark, given.select("doc_id", "text"), sf_dir)
        assert bare.columns == ["doc_id", "text"]


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert stage(spark, docs, str(tmp_path)).count() > 0


def test_an_id_with_several_texts_loses_none(spark, sf_dir):
    rng = random.Random(22)
    a, b = text(rng, 60, 10**6), text(rng, 60, 10**6)
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, a), (2, b)])
