import math
import random
from datetime import date

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from tenun.operators import audit, checks, evaluation, features, groups, labeling, snapshot
from tenun.operators.checks import ContractError
from tenun.operators.components import connected_components, extend_components
from tenun.sources.shared import Workspace

LABELS = checks.LABELS


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- components and groups


def plain_components(edges):
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        head[y] = x
    return {x: find(x) for x in head}


@pytest.mark.parametrize("kind", ["random", "path", "backwards", "star", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "path": [(k, k + 1) for k in range(300)],
        "backwards": [(1000 - k, 999 - k) for k in range(100)],
        "star": [(7, k) for k in range(200)],
        "none": [(3, 3)],
    }[kind]
    table = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r.node: r.component for r in connected_components(table, "a", "b").collect()}
    assert got == {k: v for k, v in plain_components([e for e in edges if e[0] != e[1]]).items()}


def test_leakage_groups_are_typed_and_transitive(spark):
    rows = [(0, "a", "c1", "g1", "text one"), (1, "b", "c1", "g2", "text two"), (2, "c", "c2", "g2", "text three"), (3, "c1", "", "", "Text  THREE"), (4, "d", "", None, "alone"), (5, "g1", "a", "", "")]
    table = spark.createDataFrame(rows, "row_id long, tweet_id string, conversation_id string, split_group_id string, model_text string")
    got = dict(rows_of(groups.leakage_groups(table, "row_id")))
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5}


def test_protection_is_transitive(spark):
    schema = "row_id long, tweet_id string, conversation_id string, split_group_id string, model_text string"
    candidates = spark.createDataFrame([(0, "a", "c", "", "x y"), (1, "b", "c", "", "z"), (2, "k", "", "", "free")], schema)
    protected = spark.createDataFrame([(9, "q", "", "", "X y")], schema)
    assert [r[0] for r in rows_of(groups.protect_rows(candidates, protected, "row_id"))] == [2]


# --- contracts


def test_violations_in_one_pass(spark):
    table = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, x string")
    found = rows_of(checks.violations(table, [checks.Rule("x is a", F.col("x") == "a"), checks.Rule("never", F.lit(False))], "id"), "rule")
    assert found == [("never", 0, None, 3), ("x is a", 2, "1", 3)]


def test_collection(spark):
    schema = "seq long, id_str string, full_text string, created_at string"
    start, end = date(2026, 10, 4), date(2026, 10, 10)
    good = [(0, "1", "a", "2026-10-03T17:00:00Z"), (1, "2", "b", "2026-10-10T16:59:59Z")]
    summary = checks.validate_collection(spark.createDataFrame(good, schema), start, end, 2)
    assert summary["rows"] == 2 and summary["published_at_min"] == "2026-10-03T17:00:00Z" and summary["end_exclusive_utc"] == "2026-10-10T17:00:00Z"
    for bad, limit in ((good, 1), (good, 0), (good, True), ([], 5), ([(0, "", "a", good[0][3])], 5), ([(0, "1", " ", good[0][3])], 5), ([(0, "1", "a", "x")], 5), ([(0, "1", "a", "2026-10-10T17:00:00Z")], 5)):
        with pytest.raises(ContractError):
            checks.validate_collection(spark.createDataFrame(bad, schema), start, end, limit)
    mixed = good + [(2, "2", "again", good[0][3]), (3, "", "no id", good[0][3]), (4, "3", "late", "2026-10-11T00:00:00Z"), (5, "4", "seen", good[0][3]), (6, "5", "over", good[0][3])]
    seen = spark.createDataFrame([("4",)], "id_str string")
    assert [r[0] for r in rows_of(checks.select_posts(spark.createDataFrame(mixed, schema), start, end, 3, seen), "seq")] == [0, 1, 3]


def training(**change):
    base = {"tweet_id": "1", "conversation_id": "1", "split_group_id": "g", "target_program": "mbg", "model_text": "t", "sentiment_label": "neutral", "annotation_source": "ai", "human_reviewed": "False", "approved_for_training": "False", "ai_training_candidate": "True", "quality_status": "accepted", "relevance_review": "relevant"}
    return [base | {"tweet_id": f"{k}", "sentiment_label": label} | (change if k == 0 else {}) for k, label in enumerate(LABELS)]


def test_training_contract(spark):
    frame = lambda **c: spark.createDataFrame(training(**c))
    checks.validate_training(frame(), allow_provisional=True)
    for bad in ({"model_text": " "}, {"tweet_id": ""}, {"tweet_id": "1"}, {"quality_status": "duplicate"}, {"relevance_review": "uncertain"}, {"sentiment_label": "uncertain"}, {"sentiment_label": "neutral"}, {"ai_training_candidate": "False"}):
        with pytest.raises(ContractError):
            checks.validate_training(frame(**bad), allow_provisional=True)
    with pytest.raises(ContractError):
        checks.validate_training(frame())
    with pytest.raises(ContractError):
        checks.validate_training(frame().withColumn("annotation_method", F.lit(checks.PSEUDO_LABEL)), allow_provisional=True)
    with pytest.raises(ContractError):
        checks.validate_training(frame().drop("model_text"))


# --- snapshot


def test_snapshot(spark):
    schema = "seq long, target_program string, id_str string, v string"
    old = spark.createDataFrame([(0, "p", "1", "old"), (1, "p", "2", "old")], schema)
    new = spark.createDataFrame([(0, "p", "2", "n"), (1, "q", "2", "n"), (2, "q", "2", "later"), (3, "p", "3", "n")], schema)
    assert rows_of(snapshot.build_snapshot(old, new), "seq") == [(0, "p", "1", "old"), (1, "p", "2", "old"), (3, "q", "2", "n"), (5, "p", "3", "n")]
    assert rows_of(snapshot.build_snapshot(None, new), "seq")[0] == (0, "p", "2", "n")
    assert rows_of(snapshot.append_counts(old, new, "v"), "v") == [("later", 1, 0, 1), ("n", 3, 2, 1)]
    for a, b in ((old, old), (old, new.withColumn("id_str", F.lit(" "))), (old.unionByName(old), new), (old, new.drop("v"))):
        with pytest.raises(ContractError):
            snapshot.build_snapshot(a, b)


# --- labels


@pytest.mark.parametrize("p, eligible, truncated, label, reason", [([0.1, 0.05, 0.85], True, False, "positive", ""), ([0.45, 0.4, 0.15], True, False, "uncertain", "uncertain_teacher_prediction"), ([0.9, 0.05, 0.05], False, True, "uncertain", "preprocessing_requires_review;teacher_input_truncated"), ([0.5, 0.5, 0.0], True, False, "uncertain", "uncertain_teacher_prediction"), ([0.9, 0.05, 0.05], True, False, "negative", "")])
def test_proposals(spark, p, eligible, truncated, label, reason):
    row = labeling.select_proposals(spark.createDataFrame([(p, eligible, truncated)], "probabilities array<double>, eligible boolean, truncated boolean")).first()
    assert (row.sentiment_label, row.candidate_exclusion_reason) == (label, reason)
    assert math.isclose(row.teacher_score, max(p)) and math.isclose(row.teacher_margin, max(p) - sorted(p)[1])


@pytest.mark.parametrize("p", [[float("nan"), 0.0, 1.0], [0.9, 0.9, 0.0], [-1.0, 1.0, 1.0], [0.5, 0.5]])
def test_bad_probabilities(spark, p):
    with pytest.raises(Exception, match="not three probabilities"):
        labeling.select_proposals(spark.createDataFrame([(p, True, False)], "probabilities array<double>, eligible boolean, truncated boolean")).collect()


def reviewable(spark):
    import hashlib

    rows = [{**r, "model_text": f"text {k}", "is_eligible_for_labeling": "True", "ai_training_candidate": "False"} for k, r in enumerate(training())]
    decision = {"target_program": "mbg", "tweet_id": "1", "text_sha256": hashlib.sha256(b"text 1").hexdigest(), "sentiment_label": "positive", "relevance_review": "relevant", "reason": "clear"}
    return spark.createDataFrame(rows), decision


def test_reviews(spark):
    rows, decision = reviewable(spark)
    got = {r.tweet_id: r for r in labeling.apply_reviews(rows, spark.createDataFrame([decision]), "now").collect()}
    assert got["1"].sentiment_label == "positive" and got["1"].ai_training_candidate == "True" and got["1"].human_reviewed == "False" and got["1"].review_reason == "clear"
    assert got["0"].ai_training_candidate == "False" and got["0"].annotation_status == ""
    for bad in ({"text_sha256": "x"}, {"tweet_id": "77"}, {"sentiment_label": "great"}, {"relevance_review": "maybe"}, {"reason": " "}):
        with pytest.raises(ContractError):
            labeling.apply_reviews(rows, spark.createDataFrame([decision | bad]), "now")
    with pytest.raises(ContractError):
        labeling.apply_reviews(rows, spark.createDataFrame([decision, decision]), "now")


def test_conflicts_and_lineage(spark):
    rows = spark.createDataFrame([("1", "Same text", "positive", "True", ""), ("2", "same  text", "negative", "True", ""), ("3", "same text", "neutral", "False", "old"), ("4", "other", "neutral", "True", "")], "tweet_id string, model_text string, sentiment_label string, ai_training_candidate string, candidate_exclusion_reason string")
    assert [r.ai_training_candidate for r in labeling.mark_conflicts(rows).orderBy("tweet_id").collect()] == ["False", "False", "False", "True"]
    labels = spark.createDataFrame(training())
    raw = spark.createDataFrame([("mbg", str(k), "1", "t @user https://x.y") for k in range(3)], "target_program string, id_str string, conversation_id_str string, full_text string")
    assert labeling.prepare_training(labels, raw, allow_provisional=True).count() == 3
    for bad in (raw.where("id_str <> '2'"), raw.withColumn("full_text", F.lit("u")), raw.withColumn("conversation_id_str", F.lit("9")), raw.unionByName(raw)):
        with pytest.raises(ContractError):
            labeling.prepare_training(labels, bad, allow_provisional=True)
    assert rows_of(labeling.program_label_counts(labels)) == [("mbg", 1, 1, 1)]


# --- features and metrics


def plain_tfidf(docs, tokens):
    from collections import Counter

    counts = {k: Counter(tokens(t)) for k, t in docs.items()}
    df = Counter(x for c in counts.values() for x in c)
    out = {}
    for k, c in counts.items():
        raw = {x: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[x])) + 1) for x, n in c.items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out |= {(k, x): v / length for x, v in raw.items()}
    return out


def test_tfidf_equals_the_formulas(spark):
    import re

    docs = {0: "Tidak bagus! bagus 😊", 1: "bagus a bagus", 2: "", 3: "ya"}
    table = spark.createDataFrame(list(docs.items()), "id long, t string")
    got = {(r.id, r.term): r.weight for r in features.tfidf(table, "id", features.ngrams(features.word_tokens(F.col("t"), True), 2)).collect()}

    def tokens(t):
        found = re.findall(r"\b\w+\b|[^\w\s]", t.lower())
        return found + [f"{a} {b}" for a, b in zip(found, found[1:])]

    want = plain_tfidf(docs, tokens)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)

    def chars(t):
        words = [f" {w} " for w in t.lower().split()]
        return [w[i : i + n] for w in words for n in (3, 4, 5) for i in range(len(w) - n + 1)]

    got = {(r.id, r.term): r.weight for r in features.tfidf(table, "id", features.character_grams(F.col("t"))).collect()}
    want = plain_tfidf(docs, chars)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    got = {(r.id, r.term): r.weight for r in features.character_tfidf(table, "id", F.col("t")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    top = features.tfidf(table, "id", features.word_tokens(F.col("t")), most=1).collect()
    assert {r.term for r in top} == {"bagus"}
    trained = features.tfidf(table, "id", features.word_tokens(F.col("t")), train=F.col("id") == 0).collect()
    assert {r.term for r in trained} == {"tidak", "bagus"}


def test_terms_are_not_exchanged(spark):
    """One exchange, of the texts: the rows' terms, many times as large, are counted and scaled where the texts are."""
    table = spark.createDataFrame([(k, f"some words of row {k}") for k in range(20)], "id long, t string")
    for found in (features.tfidf(table, "id", features.word_tokens(F.col("t"))), features.character_tfidf(table, "id", F.col("t"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1 and "/counts" not in plan


def test_metrics(spark):
    pairs = [("negative", "negative"), ("negative", "positive"), ("positive", "positive"), ("positive", "positive"), ("positive", "negative")]
    table = spark.createDataFrame(pairs, "t string, p string")
    row = evaluation.metrics(table, "t", "p", "test").first().asDict()
    assert math.isclose(row["test_accuracy"], 0.6) and math.isclose(row["test_macro_f1"], (0.5 + 0 + 2 / 3) / 3) and math.isclose(row["test_weighted_f1"], (0.5 * 2 + 2 / 3 * 3) / 5)
    assert row["test_recall_neutral"] == 0 and math.isclose(row["test_recall_positive"], 2 / 3)
    assert rows_of(evaluation.confusion(table, "t", "p"), "t") == [("negative", 1, 0, 1), ("neutral", 0, 0, 0), ("positive", 1, 0, 2)]


def test_character_runs_of_short_words(spark):
    row = spark.createDataFrame([("a  bc",)], "t string").select(features.character_grams(F.col("t"), (5, 6)).alias("g")).first()
    assert row.g == [" a ", " bc "]


def test_sparse_vectors(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "row long")
    words = spark.createDataFrame([(1, 0, 3.0), (1, 2, 4.0), (2, 1, 5.0)], "row long, place int, raw double")
    other = spark.createDataFrame([(1, 1, 1.0)], "row long, place int, raw double")
    found = {r.row: r.features for r in features.sparse_vectors(ids, [(words, 3), (other, 2)], Workspace(spark, "v"), "v").collect()}
    assert found == {1: SparseVector(5, [0, 2, 4], [0.6, 0.8, 1.0]), 2: SparseVector(5, [1], [1.0]), 3: SparseVector(5, [], [])}


def plain_percentile(values, share):
    values = sorted(values)
    place = share * (len(values) - 1)
    low = values[math.floor(place)]
    return low + (values[math.ceil(place)] - low) * (place - math.floor(place))


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 500 + [1.0], [float(k * k % 101) for k in range(1000)], [-1.5, 0.0, 1e300, 7.25, 7.25]])
def test_exact_percentiles(spark, values):
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    got = {r.share: r.value for r in evaluation.exact_percentiles(table, "v", shares).collect()}
    assert got.keys() == set(shares) and all(math.isclose(got[s], plain_percentile(values, s)) for s in shares)


def test_percentiles_of_nothing(spark):
    table = spark.createDataFrame([(None,)], "v double")
    assert [r.value for r in evaluation.exact_percentiles(table, "v", [0.5]).collect()] == [None]
    assert evaluation.latency_summary(table, "v").first().asDict() == {"median": None, "p95": None, "max": None}
    with pytest.raises(ValueError):
        evaluation.exact_percentiles(table, "v", [1.5])


@pytest.mark.parametrize("last, kind", [(0, "long"), (5, "long"), (10_000, "string")])
def test_components_in_rounds_and_at_once(spark, kind, last):
    rng = random.Random(last)
    for edges in ([(k, k + 1) for k in range(40)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 3), (4, None)]):
        heads = {n: n for e in edges if None not in e for n in e}
        for _ in range(len(edges)):
            for a, b in edges:
                if None not in (a, b):
                    heads[a] = heads[b] = min(heads[a], heads[b])
        name = (lambda n: n) if kind == "long" else (lambda n: None if n is None else f"n{n:03}")
        table = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
        got = {r.node: r.component for r in connected_components(table, "a", "b", last=last).collect()}
        assert got == {name(n): name(h) for n, h in heads.items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}


def test_keyed_snapshot(spark, tmp_path):
    """The rows of the plain append, over several appends, with nothing of the table moved."""
    rng = random.Random(21)
    kinds = "seq long, target_program string, id_str string, text string"
    part = lambda n: spark.createDataFrame([(k, rng.choice("pq"), f"i{rng.randrange(60)}", f"t{rng.random()}") for k in range(n)], kinds)
    first = snapshot.build_snapshot(None, part(40))
    store = snapshot.KeyedSnapshot(spark, f"keyed_{tmp_path.name.replace('-', '_')}", f"{tmp_path}/t", 3)
    store.create(first)
    want = first
    for n in (30, 50):
        new = part(n).cache()
        plan = store.additions(new)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("Join") :]
        assert "Bucketed: true" in join and join.count("Exchange hashpartitioning") <= 2
        want = snapshot.append_first_wins(want, new).cache()
        added = store.append(new)
        assert rows_of(store.rows(), "seq") == rows_of(want, "seq") and added.count() > 0
    with pytest.raises(ContractError):
        store.append(want.withColumn("text", F.lit("again")))
    with pytest.raises(ContractError):
        store.append(part(1).withColumn("id_str", F.lit(" ")))


@pytest.mark.parametrize("last", [0, 1000])
def test_components_extend(spark, last):
    """Batches of links, one after the other, against all of them at once."""
    rng = random.Random(last + 1)
    batches = [[(rng.randrange(120), rng.randrange(120)) for _ in range(25)] for _ in range(4)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    labels = connected_components(frame(batches[0]), "a", "b")
    for k, batch in enumerate(batches[1:], 2):
        fresh, merged = extend_components(labels, frame(batch), "a", "b", last)
        moved = {r.component: r.merged for r in merged.collect()}
        now = {r.node: moved.get(r.component, r.component) for r in labels.collect()} | {r.node: r.component for r in fresh.collect()}
        assert now == {r.node: r.component for r in connected_components(frame(sum(batches[:k], [])), "a", "b").collect()}
        labels = spark.createDataFrame(list(now.items()), "node long, component long")


def test_leakage_in_batches(spark):
    rng = random.Random(11)
    kinds = "row_id long, tweet_id string, conversation_id string, model_text string"
    rows = [(k, rng.choice(["", None, f"t{rng.randrange(60)}"]), rng.choice(["", f"c{rng.randrange(80)}"]), f"text {rng.randrange(70)}") for k in rng.sample(range(1000), 90)]
    state = None
    for k in range(3):
        state, added, _ = groups.extend_leakage(state, spark.createDataFrame(rows[k * 30 : k * 30 + 30], kinds), "row_id")
        assert added.count() == 30
        want = groups.leakage_groups(spark.createDataFrame(rows[: k * 30 + 30], kinds), "row_id")
        assert {(r.row, r.leakage_group) for r in state.groups.collect()} == {(r.row_id, r.leakage_group) for r in want.collect()}


@pytest.mark.parametrize("score, good", [(0.7476383, False), (0.75, True), (0.8, True), (float("nan"), False), (None, False)])
def test_gate(score, good):
    summary = {"registry": None, "deployment_approved": False, "split": {"group_overlap": 0, "test_rows": 5}, "test_metrics": {"test_macro_f1": score}}
    assert evaluation.passes_gate(summary) is good
    assert not evaluation.passes_gate(summary | {"registry": {}}) and not evaluation.passes_gate(summary | {"split": {"group_overlap": 1, "test_rows": 5}})


def test_audit(spark):
    done = spark.createDataFrame([("a", "3", "h1"), ("b", "2", "h2"), ("c", "3", "h3"), ("d", "1", "hx")], "run_path string, schema_version string, input_sha256 string")
    raw = spark.createDataFrame([("h1", True), ("h2", True), ("h3", False)], "sha256 string, manifest_ok boolean")
    assert rows_of(audit.audit_runs(done, raw), "run_path") == [("b", ["outdated_schema"]), ("c", ["manifest_invalid"]), ("d", ["outdated_schema", "raw_input_missing"])]
