"""Experiment runs and model versions as append-only Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenun.sources.posts import Zone

STAGES = ("None", "Staging", "Production", "Archived")
NEXT = {"None": "Staging", "Staging": "Production"}
SCHEMA = "name string, version int, stage string, event int, digest string, note string"


class Registry:
    """Model versions and their stages; every change is a new row, the last one holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as error:  # a registry that nothing was written to
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def current(self) -> DataFrame:
        last = F.row_number().over(Window.partitionBy("name", "version").orderBy(F.desc("event")))
        return self.events().withColumn("_last", last).where("_last = 1").drop("_last")

    def _add(self, name: str, version: int, stage: str, digest: str, note: str) -> None:
        event = (self.events().agg(F.max("event")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, version, stage, event, digest, note)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def _alone(self):
        """One writer at a time: what an event follows from is read under the lock it is written under."""
        return Zone(self.spark, self.path).lock()

    def register(self, name: str, digest: str, note: str = "") -> int:
        with self._alone():
            version = (self.current().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
            self._add(name, version, "None", digest, note)
        return version

    def annotate(self, name: str, version: int, note: str) -> None:
        """A note on a version; its stage stays."""
        with self._alone():
            row = self._version(name, version)
            self._add(name, version, row["stage"], row["digest"], note)

    def verify(self, name: str, digest: str) -> int:
        """The one version in production, whose artifact must still have this digest."""
        found = self.current().where((F.col("name") == name) & (F.col("stage") == "Production")).collect()
        if len(found) != 1:
            raise ValueError(f"{name}: {len(found)} versions in production")
        if found[0]["digest"] != digest:
            raise ValueError(f"{name} {found[0]['version']}: the artifact changed")
        return found[0]["version"]

    def _version(self, name: str, version: int):
        row = self.current().where((F.col("name") == name) & (F.col("version") == version)).first()
        if row is None:
            raise ValueError(f"{name} {version} isn't registered")
        return row

    def promote(self, name: str, version: int, digest: str, note: str = "") -> str:
        """One stage on; the artifact must be unchanged. What was in production is archived."""
        with self._alone():
            row = self._version(name, version)
            if row["stage"] not in NEXT:
                raise ValueError(f"{name} {version} can't be promoted")
            if row["digest"] != digest:
                raise ValueError(f"{name} {version}: the artifact changed")
            stage = NEXT[row["stage"]]
            if stage == "Production":
                for old in self.current().where((F.col("name") == name) & (F.col("stage") == stage)).collect():
                    self._add(name, old["version"], "Archived", old["digest"], f"replaced by {version}")
            self._add(name, version, stage, digest, note)
            return stage


class Experiments:
    """Parameters, metrics (of folds, holdout and slices) and notes of runs, one row for each."""

    SCHEMA = "experiment string, run string, kind string, key string, number double, text string"
    KINDS = ("param", "metric", "slice", "note")

    def __init__(self, spark: SparkSession, path: str, experiment: str):
        self.spark, self.path, self.experiment = spark, path, experiment

    def log(self, run: str, kind: str, values: dict[str, object]) -> None:
        """Add ``values`` of one kind; numbers stay numbers, all else is text."""
        if kind not in self.KINDS or not values:
            raise ValueError(f"nothing to log as {kind}")
        is_number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
        rows = [(self.experiment, run, kind, k, float(v) if is_number(v) else None, None if is_number(v) else str(v)) for k, v in values.items()]
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def log_table(self, run: str, kind: str, rows: DataFrame, key: str) -> None:
        """Add every numeric column of ``rows`` as ``key.column``, such as the metrics of slices."""
        names = [f.name for f in rows.schema if f.name != key and f.dataType.typeName() in ("integer", "long", "double", "float")]
        cells = F.array(*[F.struct(F.concat_ws(".", F.col(key), F.lit(n)).alias("key"), F.col(n).cast("double").alias("number")) for n in names])
        long = rows.select(F.explode(cells).alias("c")).select(F.lit(self.experiment).alias("experiment"), F.lit(run).alias("run"), F.lit(kind).alias("kind"), "c.key", "c.number", F.lit(None).cast("string").alias("text"))
        long.write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("experiment") == self.experiment)

    def best(self, metric: str) -> DataFrame:
        """The run with the greatest ``metric``, the first name of equals."""
        return self.runs().where((F.col("kind") == "metric") & (F.col("key") == metric)).orderBy(F.desc("number"), "run").limit(1)
