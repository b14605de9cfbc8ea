"""Leakage groups: rows that share an id, conversation, campaign or text stay together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.functions.text import text_fingerprint
from tenun.operators.components import connected_components, extend_components
from tenun.sources.shared import Workspace

#: Fewer links than this are followed in one task.
LAST_LINKS = 500_000
GROUP_KEYS = ("tweet_id", "conversation_id", "split_group_id", "campaign_group_id")


def _values(rows: DataFrame, row_id: str, keys: tuple[str, ...], text_col: str | None) -> DataFrame:
    """``(row, kind, value)``: all non-empty keys of all rows."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys if k in rows.columns]
    if text_col:
        kinds.append(F.struct(F.lit("text").alias("kind"), text_fingerprint(F.col(text_col)).alias("value")))
    return rows.select(F.col(row_id).alias("row"), F.explode(F.array(*kinds)).alias("k")).select("row", "k.kind", "k.value").where("value is not null and value <> ''")


def _hubs(values: DataFrame) -> DataFrame:
    return values.groupBy("kind", "value").agg(F.min("row").alias("hub"), F.count("*").alias("n"))


def leakage_groups(rows: DataFrame, row_id: str, keys: tuple[str, ...] = GROUP_KEYS, text_col: str | None = "model_text") -> DataFrame:
    """``(row_id, leakage_group)``: rows joined by any equal, non-empty key of the same kind.

    The group is named by its smallest row. Keys that the table lacks are skipped;
    values of different kinds never link. Each key value becomes a star around its
    smallest row, so a value that many rows share makes one link per row.
    """
    # the texts are prepared once; hubs are saved before they are joined, so a hot key's rows can be dealt to several tasks
    work = Workspace(rows.sparkSession, "leakage")
    values = work.save(_values(rows, row_id, keys, text_col), "values")
    stars = work.save(_hubs(values).where("n > 1").drop("n"), "hubs")
    found = connected_components(values.join(stars, ["kind", "value"]).where("row <> hub").select("row", "hub"), "row", "hub", last=LAST_LINKS)
    joined = rows.select(F.col(row_id).alias("row")).join(found.withColumnRenamed("node", "row"), "row", "left")
    return joined.select(F.col("row").alias(row_id), F.coalesce("component", "row").alias("leakage_group"))


@dataclass(frozen=True)
class LeakageState:
    """What later batches need of earlier ones: ``groups (row, leakage_group)`` and ``hubs (kind, value, hub)``, a row that has the value."""

    groups: DataFrame
    hubs: DataFrame


def extend_leakage(state: LeakageState | None, batch: DataFrame, row_id: str, keys: tuple[str, ...] = GROUP_KEYS, text_col: str | None = "model_text") -> tuple[LeakageState, DataFrame, DataFrame]:
    """The state with ``batch``, the batch's ``(row, leakage_group)``, and ``(leakage_group, merged)``: earlier groups that it joined to others.

    Only the batch's keys are looked up among the earlier ones, and only groups that they
    name are followed: the cost of a batch is its own. All groups together are those that
    ``leakage_groups`` finds for all rows at once. Rows must be new.
    """
    work = Workspace(batch.sparkSession, "extend-leakage")
    values = work.save(_values(batch, row_id, keys, text_col), "values")
    own = work.save(_hubs(values).drop("n"), "own")
    rows = batch.select(F.col(row_id).alias("row"))
    if state is None:
        links = values.join(own, ["kind", "value"]).where("row <> hub").select("row", "hub")
        found = connected_components(links, "row", "hub", last=LAST_LINKS)
        groups = rows.join(found.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("leakage_group"))
        groups = work.save(groups, "groups")
        none = groups.select("leakage_group", F.col("leakage_group").alias("merged")).where("false")
        return LeakageState(groups, own), groups, none
    met = work.save(own.join(state.hubs.withColumnRenamed("hub", "old"), ["kind", "value"], "left"), "met")
    links = values.join(met, ["kind", "value"]).select("row", F.coalesce("old", "hub").alias("hub")).where("row <> hub")
    labels = state.groups.select(F.col("row").alias("node"), F.col("leakage_group").alias("component"))
    fresh, merged = extend_components(labels, links, "row", "hub", LAST_LINKS)
    added = rows.join(fresh.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("leakage_group"))
    added, merged = work.save(added, "added"), work.save(merged.withColumnRenamed("component", "leakage_group"), "merged")
    renamed = state.groups.join(merged, "leakage_group", "left").select("row", F.coalesce("merged", "leakage_group").alias("leakage_group"))
    hubs = state.hubs.unionByName(met.where("old is null").select("kind", "value", "hub"))
    return LeakageState(renamed.unionByName(added), hubs), added, merged


def protect_rows(candidates: DataFrame, protected: DataFrame, row_id: str, keys: tuple[str, ...] = GROUP_KEYS, text_col: str | None = "model_text") -> DataFrame:
    """``candidates`` without those whose leakage group holds a protected row, however remotely linked.

    ``row_id`` must be unique over both tables.
    """
    both = candidates.unionByName(protected, allowMissingColumns=True)
    grouped = Workspace(candidates.sparkSession, "protect").save(leakage_groups(both, row_id, keys, text_col), "groups")
    barred = grouped.join(protected.select(row_id), row_id, "left_semi").select("leakage_group").distinct()
    gone = grouped.join(barred, "leakage_group", "left_semi").select(row_id)
    return candidates.join(gone, row_id, "left_anti")
