from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenun.operators.checks import LABELS, ContractError
from tenun.operators.model import Trial, check_predictions, check_trials, cross_validate, fit_model, grouped_splits
from tenun.plans.registry import Experiments, Registry

WORDS = {"negative": "buruk", "neutral": "berita", "positive": "bagus"}


def rows(spark, n=10, shared=()):
    out = []
    for k, (label, word) in enumerate(WORDS.items()):
        for i in range(n):
            key = f"{k}-{i}"
            out.append((k * n + i, key, key, "shared" if (k, i) in shared else key, f"{word} program sekolah contoh {k} nomor {i}", "mbg", label))
    return spark.createDataFrame(out, "row_id long, tweet_id string, conversation_id string, split_group_id string, model_text string, target_program string, sentiment_label string")


def test_splits_keep_groups_and_labels(spark):
    out = grouped_splits(rows(spark, shared={(0, 0), (1, 0), (2, 0), (2, 1)}), 42).collect()
    assert len(out) == 30
    where = {}
    for r in out:
        where.setdefault(r.leakage_group, set()).add((r.split, r.fold))
    assert all(len(v) == 1 for v in where.values())
    for part in [[r for r in out if r.split == "test"], *[[r for r in out if r.fold == f] for f in range(3)]]:
        assert {r.sentiment_label for r in part} == set(LABELS)
    assert all((r.fold is None) == (r.split == "test") for r in out)
    assert 3 <= sum(r.split == "test" for r in out) <= 9


def test_too_few_groups(spark):
    with pytest.raises(ContractError):
        grouped_splits(rows(spark, 4), 42)


@pytest.mark.parametrize("mode", ["word_program", "word_char", "word_char_program"])
def test_model_learns_the_words(spark, mode):
    given = rows(spark)
    model = fit_model(given.where("row_id % 10 < 8"), Trial(C=10.0, ngram_max=2, feature_mode=mode), iterations=100)
    out = model.predict(given.where("row_id % 10 >= 8").withColumn("target_program", F.lit("unseen"))).collect()
    assert len(out) == 6 and all(r.predicted == r.sentiment_label for r in out)
    with pytest.raises(ContractError):
        model.predict(given.withColumn("model_text", F.lit(" ")))


def tight_loss(x, labels, weights, penalty):
    """The least objective of a multinomial regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    classes = max(labels) + 1
    truth, w = np.eye(classes)[labels], weights / weights.sum()
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, penalty), 0.0])
    coefficients = np.zeros((classes, x.shape[1]))

    def loss(c):
        z = x @ c.T
        top = z.max(1, keepdims=True)
        return float((w * (np.log(np.exp(z - top).sum(1)) + top[:, 0] - (z * truth).sum(1))).sum() + 0.5 * np.einsum("ki,ij,kj->", c, ridge, c))

    for _ in range(30):
        z = x @ coefficients.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = ((p - truth) * w[:, None]).T @ x + coefficients @ ridge
        curve = np.einsum("n,nk,kl,ni,nj->kilj", w, p, np.eye(classes), x, x) - np.einsum("n,nk,nl,ni,nj->kilj", w, p, p, x, x) + np.einsum("kl,ij->kilj", np.eye(classes), ridge)
        step = np.linalg.lstsq(curve.reshape(gradient.size, gradient.size), gradient.ravel(), rcond=1e-12)[0].reshape(gradient.shape)
        size = 1.0
        while loss(coefficients - size * step) > loss(coefficients) and size > 1e-6:
            size /= 2
        coefficients = coefficients - size * step
    return loss(coefficients)


@pytest.mark.parametrize("mode", ["word_program", "word_char_program"])
def test_the_fit_is_tight(spark, mode):
    """The tolerance leaves no more than a thousandth of the objective, and the weights are balanced."""
    given = rows(spark, 4).where("row_id % 5 <> 1 or row_id < 5").withColumn("target_program", F.when(F.col("row_id") % 3 == 0, "a").otherwise("b"))
    model = fit_model(given, Trial(C=2.0, feature_mode=mode))
    found = model.features(given).select("features", "sentiment_label").collect()
    labels = [sorted(WORDS).index(r.sentiment_label) for r in found]
    counts = np.bincount(labels)
    weights = np.array([len(labels) / (3 * counts[k]) for k in labels])
    x = np.array([r.features.toArray() for r in found])
    x = x[:, x.any(0)]
    want = tight_loss(x, labels, weights, 1 / (2.0 * len(labels)))
    assert want * (1 - 1e-9) <= model.classifier.summary.objectiveHistory[-1] <= want * 1.001


def test_features_run_no_python(spark):
    model = fit_model(rows(spark), Trial(2.0, 2, "word_char_program"), iterations=3)
    plan = model.predict(rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert model.features(rows(spark)).schema["features"].dataType.typeName() == "vectorudt"


def test_trials():
    good = [Trial(0.5), Trial(2.0), Trial(10.0, 2, "word_char")]
    assert check_trials(good) == good
    for bad in (lambda: check_trials(good[:2]), lambda: check_trials([*good[:2], good[0]]), lambda: Trial(0.0), lambda: Trial(float("inf")), lambda: Trial(True), lambda: Trial(1.0, 3), lambda: Trial(1.0, 1, "x")):
        with pytest.raises(ContractError):
            bad()


def test_registry(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    assert registry.register("m", "d1") == 1 and registry.register("m", "d2") == 2
    assert [registry.promote("m", 1, "d1") for _ in range(2)] == ["Staging", "Production"]
    for bad in (("m", 1, "d1"), ("m", 2, "other"), ("m", 9, "d1")):
        with pytest.raises(ValueError):
            registry.promote(*bad)
    registry.promote("m", 2, "d2")
    registry.promote("m", 2, "d2")
    assert {r.version: r.stage for r in registry.current().collect()} == {1: "Archived", 2: "Production"}
    registry.annotate("m", 2, "measured")
    assert registry.verify("m", "d2") == 2 and registry.current().where("version = 2").first().note == "measured"
    for bad in (lambda: registry.verify("m", "other"), lambda: registry.verify("n", "d2"), lambda: registry.annotate("m", 9, "x")):
        with pytest.raises(ValueError):
            bad()


def test_writers_of_a_registry_wait_for_each_other(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: registry.register("m", f"d{k}"), range(6)))
    assert sorted(versions) == list(range(1, 7))
    assert sorted(r.event for r in registry.events().collect()) == list(range(1, 7))


def test_experiments(spark, tmp_path):
    log = Experiments(spark, str(tmp_path / "runs"), "e")
    for run, score in (("a", 0.5), ("b", 0.75), ("c", 0.75)):
        log.log(run, "param", {"C": 2, "mode": "word_char", "balanced": True})
        log.log(run, "metric", {"cv_macro_f1": score})
    log.log_table("b", "slice", spark.createDataFrame([("mbg", 3, 0.5)], "program string, rows long, accuracy double"), "program")
    assert log.best("cv_macro_f1").first().run == "b"
    got = {(r.kind, r.key): r.number if r.text is None else r.text for r in log.runs().where("run = 'b'").collect()}
    assert got == {("param", "C"): 2.0, ("param", "mode"): "word_char", ("param", "balanced"): "True", ("metric", "cv_macro_f1"): 0.75, ("slice", "mbg.rows"): 3.0, ("slice", "mbg.accuracy"): 0.5}
    assert Experiments(spark, log.path, "other").runs().count() == 0
    with pytest.raises(ValueError):
        log.log("a", "other", {"x": 1})


def test_many_groups_are_dealt_evenly(spark):
    out = grouped_splits(rows(spark, 200), 7).collect()
    parts = {}
    for r in out:
        parts.setdefault((r.split, r.fold), []).append(r.sentiment_label)
    assert {len(v) for k, v in parts.items() if k[0] == "test"} == {120}
    for labels in parts.values():
        assert all(abs(labels.count(x) - len(labels) / 3) <= 1 for x in LABELS)
    assert out != grouped_splits(rows(spark, 200), 8).collect()
    again = {r.row_id: (r.split, r.fold) for r in grouped_splits(rows(spark, 200).repartition(3), 7).collect()}
    assert again == {r.row_id: (r.split, r.fold) for r in out}


def test_cross_validation(spark):
    given = grouped_splits(rows(spark, 12), 42)
    trials = [Trial(2.0), Trial(10.0), Trial(2.0, 2)]
    out = cross_validate(given, trials, iterations=20).collect()
    assert [(r.trial, r.fold) for r in sorted(out)] == [(k, f) for k in range(3) for f in range(3)]
    assert all(0.9 <= r.macro_f1 <= 1 for r in out)
    with pytest.raises(ContractError):
        cross_validate(given, trials[:2])


def test_predictions_are_checked(spark):
    given = spark.createDataFrame([(k,) for k in range(4)], "row_id long")
    fine = given.withColumn("predicted", F.lit("neutral"))
    assert check_predictions(given, fine) == 4
    for bad in (fine.where("row_id < 3"), fine.withColumn("predicted", F.lit("other")), fine.withColumn("predicted", F.lit(None).cast("string"))):
        with pytest.raises(ContractError):
            check_predictions(given, bad)
    model = fit_model(rows(spark), Trial(2.0), iterations=5)
    assert [r.row_id for r in model.predict(rows(spark).repartition(3), "row_id").collect()] == list(range(30))
