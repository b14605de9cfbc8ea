"""Raw runs against their manifests, as one plan over all runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenun.operators.checks import ContractError, validate_collection

HISTORY = "history"
_DIGEST = "^[a-f0-9]{64}$"


def _kind(name: str) -> Column:
    """The JSON type of a field, null if it isn't there."""
    return F.schema_of_variant(F.try_variant_get("document", f"$.{name}", "variant"))


def _text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", F.try_variant_get("document", f"$.{name}", "string"))


def _day(name: str) -> Column:
    return F.when(_text(name).rlike(r"^\d{4}-\d{2}-\d{2}$"), _text(name).try_cast("date"))


def _limit() -> Column:
    return F.when(_kind("limit") == "BIGINT", F.try_variant_get("document", "$.limit", "long"))


def manifest_problems(runs: DataFrame, files: DataFrame, current_sha256: str | None = None, required: bool = True) -> DataFrame:
    """``(run, problem)`` for every run whose manifest doesn't vouch for its data and its configuration.

    ``runs`` has ``run`` (its folder), ``sha256`` of the data as it is now, and
    ``manifest``, the JSON text or null. ``files`` has ``folder, name, sha256`` of the
    configurations that are kept: beside the runs, and in ``history`` named by their
    digest. A run's configuration is the one its manifest names, which must lie in
    the run's folder; without a name the current one if its digest is the stated
    one, else the one in the history. The first problem counts, in this order:
    ``missing``, ``invalid``, ``data changed``, ``configuration outside the run``,
    ``invalid configuration checksum``, ``configuration changed``.
    """
    named = runs.withColumn("document", F.try_parse_json("manifest"))
    has_name = F.coalesce(F.array_contains(F.json_object_keys("manifest"), "config_snapshot"), F.lit(False))
    name, expected = _text("config_snapshot"), _text("config_sha256")
    plain = ~name.isin("", ".", "..") & ~name.rlike(r"[/\\]")
    where = F.when(has_name, F.col("run")).otherwise(F.lit(HISTORY))
    what = F.when(has_name, name).otherwise(F.concat(expected, F.lit(".yaml")))
    kept = files.select(F.col("folder").alias("_folder"), F.col("name").alias("_name"), F.col("sha256").alias("_kept"))
    joined = named.withColumns({"_folder": where, "_name": what}).join(kept, ["_folder", "_name"], "left")
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    is_current = ~has_name & F.coalesce(expected == F.lit(current_sha256), F.lit(False))
    sound = (_day("from_date") <= _day("to_date")) & (_limit() > 0) & _text("input_sha256").isNotNull()
    problem = (
        F.when(F.col("manifest").isNull(), F.lit("missing") if required else F.lit(None))
        .when(no(sound), "invalid")
        .when(_text("input_sha256") != F.col("sha256"), "data changed")
        .when(has_name & no(plain), "configuration outside the run")
        .when(~has_name & ~is_current & no(expected.rlike(_DIGEST)), "invalid configuration checksum")
        .when(~is_current & no(F.col("_kept") == expected), "configuration changed")
    )
    return joined.select("run", problem.alias("problem")).where("problem is not null")


def validate_run(posts: DataFrame, run: DataFrame, files: DataFrame, current_sha256: str | None = None) -> dict:
    """One run's posts, accepted whole or rejected whole: manifest, data and configuration digests, then the window.

    ``run`` is its row as ``manifest_problems`` reads it. Returns the collection's summary.
    """
    if found := manifest_problems(run, files, current_sha256).take(1):
        raise ContractError(f"{found[0]['run']}: manifest {found[0]['problem']}")
    said = run.withColumn("document", F.try_parse_json("manifest")).select(_day("from_date").alias("start"), _day("to_date").alias("end"), _limit().alias("most")).first()
    return validate_collection(posts, said["start"], said["end"], said["most"])
