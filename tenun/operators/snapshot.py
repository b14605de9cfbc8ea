"""Versioned snapshots: what was there stays, of each new key the first row is added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenun.operators.checks import ContractError, Rule, blank, enforce, unique_keys
from tenun.sources.shared import Workspace

KEYS = ("target_program", "id_str")


def append_first_wins(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "seq") -> DataFrame:
    """``existing`` and, after it, the first row by ``order`` of every key it lacks, with new numbers.

    Ids are numbered on: the new rows' ``order`` is moved past the existing rows'.
    """
    base = existing.agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("_base"))
    firsts = new.groupBy(*keys).agg(F.min(order).alias(order))
    added = new.join(firsts, [*keys, order], "left_semi").join(existing.select(*keys), list(keys), "left_anti")
    moved = added.crossJoin(F.broadcast(base)).withColumn(order, F.col(order) + F.col("_base")).select(*existing.columns)
    return existing.unionByName(moved)


def append_counts(existing: DataFrame, new: DataFrame, source: str, keys: tuple[str, ...] = KEYS, order: str = "seq") -> DataFrame:
    """``(source, rows_read, rows_added, rows_skipped)`` for every source of ``new``."""
    firsts = new.groupBy(*keys).agg(F.min(order).alias("_first"))
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(1))
    marked = new.join(firsts, list(keys)).join(known, list(keys), "left")
    added = F.sum(((F.col(order) == F.col("_first")) & F.col("_known").isNull()).cast("long"))
    return marked.groupBy(source).agg(F.count("*").alias("rows_read"), added.alias("rows_added"), (F.count("*") - added).alias("rows_skipped"))


def build_snapshot(existing: DataFrame | None, new: DataFrame, keys: tuple[str, ...] = KEYS, order: str = "seq") -> DataFrame:
    """``append_first_wins`` with its contract: same columns, no blank ids, unique keys, something new."""
    if existing is not None:
        if existing.columns != new.columns:
            raise ContractError("the columns differ from the snapshot's")
        unique_keys(existing, keys)
    enforce(new, [Rule("a key is blank", F.greatest(*[blank(F.col(k)).cast("int") for k in keys]) == 1)])
    old = existing if existing is not None else new.limit(0)
    built = append_first_wins(old, new, keys, order)
    if built.count() == old.count():
        raise ContractError("there are no new rows")
    return built


class KeyedSnapshot:
    """A snapshot whose files are dealt by the hash of its keys, so that what is appended is compared without a shuffle of what is there.

    ``path`` is where the table's files lie; ``table`` names it in the session's catalog. As
    many ``buckets`` are made as tasks are to read them at a time.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int, keys: tuple[str, ...] = KEYS, order: str = "seq"):
        self.spark, self.table, self.path, self.buckets, self.keys, self.order = spark, table, path, buckets, keys, order

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # one file a bucket and write
        dealt = rows.repartition(self.buckets, *self.keys)
        dealt.write.mode(mode).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", self.path).saveAsTable(self.table)

    def create(self, rows: DataFrame) -> None:
        """The first version; blank and repeated keys are errors."""
        enforce(rows, [Rule("a key is blank", F.greatest(*[blank(F.col(k)).cast("int") for k in self.keys]) == 1)])
        unique_keys(rows, self.keys)
        self._write(rows, "errorifexists")

    def additions(self, new: DataFrame) -> DataFrame:
        """What ``append`` adds: of each key that isn't there the first row by order, numbered on."""
        there = self.rows()
        firsts = new.groupBy(*self.keys).agg(F.min_by(F.struct(*[F.col(c).alias(c) for c in there.columns]), self.order).alias("row")).select(*self.keys, "row")
        base = there.agg((F.coalesce(F.max(self.order), F.lit(-1)) + 1).alias("_base"))
        # only the new rows move: they go to the buckets
        added = firsts.repartition(self.buckets, *self.keys).join(there.select(*self.keys).hint("shuffle_merge"), list(self.keys), "left_anti").select("row.*")
        return added.crossJoin(F.broadcast(base)).withColumn(self.order, F.col(self.order) + F.col("_base")).select(*there.columns)

    def append(self, new: DataFrame) -> DataFrame:
        """Add ``additions`` to the table, and return them; a blank key or a row set without new keys is an error."""
        enforce(new, [Rule("a key is blank", F.greatest(*[blank(F.col(k)).cast("int") for k in self.keys]) == 1)])
        added = Workspace(self.spark, "snapshot").save(self.additions(new), "added")
        if added.isEmpty():
            raise ContractError("there are no new rows")
        self._write(added, "append")
        return added
