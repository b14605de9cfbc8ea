"""Audit of processed runs against their raw inputs, and their quarantine."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.operators.checks import ContractError


def audit_runs(processed: DataFrame, raw: DataFrame, version: str = "3") -> DataFrame:
    """``(run_path, reasons)`` for runs to quarantine.

    ``processed`` has ``run_path, schema_version, input_sha256``; ``raw`` has
    ``sha256`` and ``manifest_ok``. Reasons come in a fixed order.
    """
    known = raw.groupBy(F.col("sha256").alias("input_sha256")).agg(F.max("manifest_ok").alias("manifest_ok"), F.lit(True).alias("present"))
    joined = processed.join(known, "input_sha256", "left")
    reasons = F.array_compact(F.array(
        F.when(~F.col("schema_version").eqNullSafe(F.lit(version)), "outdated_schema"),
        F.when(F.col("present").isNull(), "raw_input_missing"),
        F.when(F.col("present") & ~F.coalesce("manifest_ok", F.lit(False)), "manifest_invalid"),
    ))
    return joined.select("run_path", reasons.alias("reasons")).where(F.size("reasons") > 0)


def quarantine_runs(audited: DataFrame, root: str, quarantine: str) -> list[str]:
    """Move the runs that ``audit_runs`` names out of ``root``, each with a note of the reasons; returns where they went.

    ``run_path`` is relative to ``root``. A path that leads out of ``root``, or a
    place that is taken, is an error before anything is moved. Moves are renames
    on the driver, one per run; data isn't read.
    """
    spark = audited.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = audited.orderBy("run_path").collect()  # what is to be moved one by one
    for r in rows:
        if r["run_path"].startswith("/") or any(p in ("", ".", "..") for p in r["run_path"].split("/")):
            raise ContractError(f"{r['run_path']}: leads out of the zone")
        if fs.exists(path(f"{quarantine}/{r['run_path']}")):
            raise ContractError(f"{r['run_path']}: is in quarantine already")
    moved = []
    for r in rows:
        target = path(f"{quarantine}/{r['run_path']}")
        fs.mkdirs(target.getParent())
        if not fs.rename(path(f"{root}/{r['run_path']}"), target):
            raise ContractError(f"{r['run_path']}: can't be moved")
        note = {"status": "quarantined", "eligible_for_labeling": False, "eligible_for_training": False, "reasons": list(r["reasons"]), "original_path": r["run_path"]}
        out = fs.create(path(target, "quarantine.json"), False)
        out.write(bytearray(json.dumps(note, indent=2).encode()))
        out.close()
        moved.append(target.toString())
    return moved
