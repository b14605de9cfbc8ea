"""Grouped splits and the TF-IDF logistic-regression model on MLlib."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.operators.checks import LABELS, ContractError, Rule, blank, enforce, require_columns
from tenun.operators.features import CHARACTERS, MODES, WORDS, character_counts, class_weights, learn_vocabulary, ngrams, number_programs, sparse_vectors, term_counts, weigh, word_tokens
from tenun.operators.groups import leakage_groups
from tenun.sources.posts import with_sequence
from tenun.sources.shared import Workspace

LEAST_GROUPS = 5
ROWS_PER_TASK = 5000


@dataclass(frozen=True)
class Trial:
    """One set of model parameters."""

    C: float
    ngram_max: int = 1
    feature_mode: str = "word_program"

    def __post_init__(self):
        if self.feature_mode not in MODES:
            raise ContractError(f"unknown feature mode: {self.feature_mode}")
        if isinstance(self.C, bool) or not math.isfinite(self.C) or self.C <= 0 or self.ngram_max not in (1, 2):
            raise ContractError("C must be finite and positive, ngram_max 1 or 2")


def check_trials(trials: Iterable[Trial]) -> list[Trial]:
    found = list(trials)
    if len(set(found)) < 3 or len(set(found)) != len(found):
        raise ContractError("at least three different trials are needed")
    return found


Profile = tuple[int, ...]


def _deal(profiles: dict[Profile, int], folds: int, seed: int) -> dict[Profile, list[int]]:
    """How many groups of each profile (label counts) go to each fold.

    Whole rounds go to all folds alike; what is left goes, the most uneven profiles
    first, to the folds where label counts stay most alike.
    """
    order = sorted(profiles)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda p: -(max(p) - min(p)))
    total = [sum(p[k] * n for p, n in profiles.items()) or 1 for k in range(len(LABELS))]
    have = [[0] * len(LABELS) for _ in range(folds)]
    out = {}
    for profile in order:
        each, rest = divmod(profiles[profile], folds)
        given = [each] * folds
        for fold in range(folds):
            have[fold] = [h + each * c for h, c in zip(have[fold], profile)]
        for _ in range(rest):
            def cost(fold: int) -> tuple[float, int]:
                shares = [[(have[f][k] + (c if f == fold else 0)) / total[k] for f in range(folds)] for k, c in enumerate(profile)]  # noqa: B023
                uneven = sum(math.sqrt(sum((s - sum(v) / folds) ** 2 for s in v) / folds) for v in shares)
                return uneven, sum(have[fold])

            best = min((f for f in range(folds) if given[f] == each), key=cost)
            given[best] += 1
            have[best] = [h + c for h, c in zip(have[best], profile)]
        out[profile] = given
    return out


def _holds_all(dealt: dict[Profile, list[int]], fold: int) -> bool:
    return all(any(p[k] and n[fold] for p, n in dealt.items()) for k in range(len(LABELS)))


def grouped_splits(rows: DataFrame, seed: int, row_id: str = "row_id", label: str = "sentiment_label", outer: int = 5, inner: int = 3) -> DataFrame:
    """``rows`` with ``leakage_group, split (development or test), fold (of development, else null)``.

    No group is in two splits or two folds, and every split and fold holds all
    labels. Groups with the same label counts are interchangeable: the driver only
    deals out how many of each such profile go where, and the groups are numbered
    within their profile, in an order that the seed shuffles, in parallel.
    """
    work = Workspace(rows.sparkSession, "splits")
    grouped = work.save(rows.join(leakage_groups(rows, row_id), row_id), "grouped")
    counts = grouped.groupBy("leakage_group").pivot(label, list(LABELS)).agg(F.count(F.lit(1))).fillna(0)
    numbered = work.save(with_sequence(counts.withColumn("_order", F.xxhash64(F.lit(seed), "leakage_group")), [*LABELS, "_order", "leakage_group"], "_seq"), "numbered")
    # a row for every kind of group, however many groups there are
    kinds = numbered.groupBy(*LABELS).agg(F.count("*").alias("n"), F.min("_seq").alias("base")).collect()
    profiles, bases = ({tuple(r[x] for x in LABELS): r[c] for r in kinds} for c in ("n", "base"))
    if any(sum(n for p, n in profiles.items() if p[k]) < LEAST_GROUPS for k in range(len(LABELS))):
        raise ContractError(f"every label needs at least {LEAST_GROUPS} independent groups")
    for attempt in range(seed, seed + outer):
        dealt = _deal(profiles, outer, attempt)
        for test in range(outer):
            rest = {p: n - dealt[p][test] for p, n in profiles.items() if n > dealt[p][test]}
            folds = _deal(rest, inner, attempt)
            if _holds_all(dealt, test) and all(_holds_all(folds, f) for f in range(inner)):
                table = []
                for p in profiles:
                    at = bases[p]
                    for split, fold, n in (("test", None, dealt[p][test]), *(("development", f, m) for f, m in enumerate(folds.get(p, [])))):
                        if n:
                            table.append((*p, at, at + n, split, fold))
                            at += n
                places = rows.sparkSession.createDataFrame(table, ", ".join(f"{x} long" for x in LABELS) + ", _from long, _to long, split string, fold int")
                placed = numbered.join(places, list(LABELS)).where("_seq >= _from and _seq < _to").select("leakage_group", "split", "fold")
                return grouped.join(placed, "leakage_group")
    raise ContractError("no split has every label in each fold")


def _counts(rows: DataFrame, trial: Trial) -> list[tuple[DataFrame, int]]:
    """Of each block of text features the terms' counts by ``_row``, and the most terms it may know."""
    marks = trial.feature_mode != "word_program"
    words = term_counts(rows, "_row", ngrams(word_tokens(F.col("model_text"), marks), trial.ngram_max))
    return [(words, WORDS)] + ([(character_counts(rows, "_row", F.col("model_text")), CHARACTERS)] if marks else [])


def _numbered(rows: DataFrame, trial: Trial, work: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with ``_row``, and their counts by block, both saved: every later step starts from these tables."""
    numbered = work.save(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return numbered, [work.save(counted, f"counts-{k}") for k, (counted, _) in enumerate(_counts(numbered, trial))]


@dataclass
class TextModel:
    """A fitted model: the terms of its text blocks, its programs, their numbers, and the classifier."""

    trial: Trial
    blocks: list[tuple[DataFrame, int]]
    programs: tuple[DataFrame, int] | None
    classifier: object
    labels: list[str]

    def features(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``features``: word, character and program features side by side, by column functions alone."""
        work = Workspace(rows.sparkSession, "features")
        return self._features(*_numbered(rows, self.trial, work), work)

    def _features(self, numbered: DataFrame, counts: list[DataFrame], work: Workspace) -> DataFrame:
        blocks = [(weigh(counted, terms), size) for counted, (terms, size) in zip(counts, self.blocks)]
        if self.programs is not None:
            known, size = self.programs
            blocks.append((numbered.join(F.broadcast(known), "target_program").select(F.col("_row").alias("row"), "place", F.lit(1.0).alias("raw")), size))
        vectors = sparse_vectors(numbered.select(F.col("_row").alias("row")), blocks, work, "vectors")
        return numbered.join(vectors.withColumnRenamed("row", "_row"), "_row").drop("_row")

    def predict(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """``rows`` with ``predicted``, with ``order`` in that column's order; blank texts or programs raise an error."""
        require_columns(rows, ("model_text", "target_program"))
        enforce(rows, [Rule("an input is blank", blank(F.col("model_text")) | blank(F.col("target_program")))])
        named = F.array(*[F.lit(x) for x in self.labels])
        scored = self.classifier.transform(self.features(rows))
        out = scored.select(*rows.columns, F.get(named, F.col("prediction").cast("int")).alias("predicted"))
        return out.orderBy(order) if order else out


def check_predictions(given: DataFrame, predicted: DataFrame, labels: Iterable[str] = LABELS) -> int:
    """As many predictions as inputs, all of known labels; returns how many."""
    n = enforce(predicted, [Rule("an unknown label", ~F.coalesce(F.col("predicted").isin(*labels), F.lit(False)))])
    if n != (asked := given.count()):
        raise ContractError(f"{n} predictions for {asked} rows")
    return n


def fit_model(rows: DataFrame, trial: Trial, iterations: int = 2000, tolerance: float = 1e-6) -> TextModel:
    """Fit vocabulary, frequencies and a balanced multinomial regression on ``rows`` alone."""
    work = Workspace(rows.sparkSession, "model")
    numbered, counts = _numbered(rows, trial, work)
    docs = numbered.count()
    blocks = []
    for k, (counted, (_, most)) in enumerate(zip(counts, _counts(numbered, trial))):
        terms = work.save(learn_vocabulary(counted, F.lit(docs), most), f"terms-{k}", 1)
        blocks.append((terms, terms.count()))
    programs = None
    if trial.feature_mode != "word_char":
        # one that isn't among them has no feature
        known = work.save(number_programs(numbered), "programs", 1)
        programs = known, known.count()
    labels = sorted(r[0] for r in numbered.select("sentiment_label").distinct().collect())
    model = TextModel(trial, blocks, programs, None, labels)
    weights = class_weights(numbered)
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("sentiment_label")).cast("double") - 1
    ready = model._features(numbered, counts, work).withColumn("_label", place).join(F.broadcast(weights.select("sentiment_label", F.col("weight").alias("_weight"))), "sentiment_label")
    # every iteration is a job: few rows are kept in few partitions
    ready = work.save(ready.select("features", "_label", "_weight"), "ready", -(-docs // ROWS_PER_TASK))
    regression = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_weight", family="multinomial", regParam=1 / (trial.C * docs), standardization=False, maxIter=iterations, tol=tolerance)
    model.classifier = regression.fit(ready)
    return model


def cross_validate(rows: DataFrame, trials: Iterable[Trial], iterations: int = 2000) -> DataFrame:
    """``(trial, fold, macro_f1)`` over the development folds of ``grouped_splits``."""
    from tenun.operators.evaluation import metrics

    development = rows.where("split = 'development'")
    out = []
    for k, trial in enumerate(check_trials(trials)):
        for fold in sorted(r[0] for r in development.select("fold").distinct().collect()):
            model = fit_model(development.where(F.col("fold") != fold), trial, iterations)
            found = metrics(model.predict(development.where(F.col("fold") == fold)), "sentiment_label", "predicted", "cv").first()
            out.append((k, fold, found["cv_macro_f1"]))
    return rows.sparkSession.createDataFrame(out, "trial int, fold int, macro_f1 double")
