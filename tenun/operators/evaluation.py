"""Classification metrics, summaries, model choice and the quality gate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenun.operators.checks import LABELS
from tenun.sources.shared import Workspace

LEAST_MACRO_F1 = 0.75


def confusion(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per true label with a zero-filled count per predicted label."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], f"{truth} string")
    counts = rows.groupBy(truth).pivot(predicted, list(labels)).agg(F.count(F.lit(1)))
    return every.join(counts, truth, "left").fillna(0)


def label_report(rows: DataFrame, truth: str, predicted: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(label, support, precision, recall, f1)`` for each of ``labels``, absent ones included; 0/0 is 0."""
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).alias("taken"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("taken"), F.lit(0).alias("hit")),
    )
    sums = cells.select(F.explode(sides).alias("s")).select("s.*").where(F.col("label").isin(*labels)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "taken", "hit")])
    joined = every.join(sums, "label", "left").fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return joined.select("label", "support", share(F.col("hit"), F.col("taken")).alias("precision"), share(F.col("hit"), F.col("support")).alias("recall"), share(2 * F.col("hit"), F.col("support") + F.col("taken")).alias("f1"))


def metrics(rows: DataFrame, truth: str, predicted: str, prefix: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row: accuracy, macro and weighted F1, and recall of each label."""
    accuracy = rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias(f"{prefix}_accuracy"))
    report = label_report(rows, truth, predicted, labels)
    recalls = [F.max(F.when(F.col("label") == x, F.col("recall"))).alias(f"{prefix}_recall_{x}") for x in labels]
    summed = report.agg(F.avg("f1").alias(f"{prefix}_macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias(f"{prefix}_weighted_f1"), *recalls)
    return accuracy.crossJoin(summed)


def slice_metrics(rows: DataFrame, by: str, truth: str, predicted: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``metrics`` for each value of ``by``: ``(by, rows, accuracy, macro_f1, weighted_f1, recall_*)``, in one aggregation."""
    t, p = F.col(truth), F.col(predicted)
    n = lambda condition: F.count(F.when(condition, 1))
    counts = [c for x in labels for c in (n((t == x) & (p == x)).alias(f"hit_{x}"), n(t == x).alias(f"support_{x}"), n(p == x).alias(f"taken_{x}"))]
    summed = rows.groupBy(by).agg(F.count("*").alias("rows"), F.avg((t == p).cast("double")).alias("accuracy"), *counts)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = {x: share(2 * F.col(f"hit_{x}"), F.col(f"support_{x}") + F.col(f"taken_{x}")) for x in labels}
    known = sum((F.col(f"support_{x}") for x in labels), F.lit(0))
    macro = sum(f1.values(), F.lit(0.0)) / len(labels)
    weighted = share(sum((f1[x] * F.col(f"support_{x}") for x in labels), F.lit(0.0)), known)
    recalls = [share(F.col(f"hit_{x}"), F.col(f"support_{x}")).alias(f"recall_{x}") for x in labels]
    return summed.select(by, "rows", "accuracy", macro.alias("macro_f1"), weighted.alias("weighted_f1"), *recalls)


def fold_summary(scores: DataFrame, trial: str, score: str) -> DataFrame:
    """Mean and population deviation of each trial's fold scores."""
    return scores.groupBy(trial).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count("*").alias("folds"))


def best_trial(summary: DataFrame, trial: str, score: str = "mean") -> DataFrame:
    """The trial with the greatest score, the first of equals."""
    return summary.orderBy(F.desc(score), trial).limit(1)


def majority_label(rows: DataFrame, label: str = "sentiment_label") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), label).limit(1)


def exact_percentiles(rows: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """``(share, value)``: the interpolated percentile of ``value`` at each share, 0 to 1, nulls left out.

    Different values are counted and range-partitioned; the counts of the ranges say which of
    them hold the wanted ranks, and only these are read again, in order, a range a task.
    Without values all percentiles are null.
    """
    if bad := [s for s in shares if not 0 <= s <= 1]:
        raise ValueError(f"no shares: {bad}")
    spark = rows.sparkSession
    work = Workspace(spark, "percentiles")
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    held = work.save(counted.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()), "values")
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    places = [s * (total - 1) for s in shares]
    wanted = sorted({f(p) for p in places for f in (math.floor, math.ceil)}) if total else []
    base, starts = 0, {}
    for part, n in sizes:
        if any(base <= k < base + n for k in wanted):
            starts[part] = base
        base += n
    found = {}
    if wanted:
        start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part"))
        upto = start + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
        ranked = held.where(F.col("part").isin(list(starts))).withColumn("upto", upto)
        hit = reduce(or_, [(F.lit(k) < F.col("upto")) & (F.lit(k) >= F.col("upto") - F.col("n")) for k in wanted])
        picked = [(r["upto"] - r["n"], r["upto"], r["v"]) for r in ranked.where(hit).collect()]
        found = {k: next(v for low, high, v in picked if low <= k < high) for k in wanted}
    work.keep()
    out = [(float(s), found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) if total else None) for s, p in zip(shares, places)]
    return spark.createDataFrame(out, "share double, value double")


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """Median, 95th percentile (interpolated) and maximum."""
    named = {"median": 0.5, "p95": 0.95, "max": 1.0}
    found = exact_percentiles(rows, value, list(named.values()))
    return found.agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in named.items()])


def independent_groups(rows: DataFrame, label: str, group: str) -> DataFrame:
    """Exact number of leakage groups per label."""
    return rows.groupBy(label).agg(F.countDistinct(group).alias("groups"))


def split_counts(rows: DataFrame, split: str, by: str) -> DataFrame:
    return rows.groupBy(split, by).agg(F.count("*").alias("rows"))


def passes_gate(summary: dict) -> bool:
    """Whether an experiment may be staged: unregistered, without overlap, tested, and good enough."""
    split, score = summary.get("split", {}), summary.get("test_metrics", {}).get("test_macro_f1")
    sound = summary.get("registry") is None and not summary.get("deployment_approved") and split.get("group_overlap") == 0 and split.get("test_rows", 0) > 0
    return bool(sound and isinstance(score, int | float) and not isinstance(score, bool) and math.isfinite(score) and score >= LEAST_MACRO_F1)


def rank_within(rows: DataFrame, keys: list[str], score: str, top: int) -> DataFrame:
    """The ``top`` highest scores of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score)))
    return rows.withColumn("place", place).where(F.col("place") <= top)
