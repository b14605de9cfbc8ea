"""Rows in order of their id, each with its successor, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW = -(1 << 63)
_BLOCK = 1 << 20
MOST_RUNS = 20_000


def map_with_next(docs: DataFrame, of: Callable[[list[int | None], list[str]], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """``of(ids, texts)`` over blocks of consecutive documents in order of id.

    ``texts`` has one text more than ``ids`` has ids: the successor of the last
    one; the last document's successor is the first. Null ids come first, equal
    ids in order of their texts, null texts are empty.

    Ids are cut at quantiles into runs. The first document of a run is dealt twice,
    to its run and as the last successor to the run before, so texts are shuffled
    once and a task streams its run, however long. At most ``MOST_RUNS`` runs are made,
    which bounds the quantile sketch; only one id per run comes to the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))
    given = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = runs or min(MOST_RUNS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    cuts = given.approxQuantile("key", [k / wanted for k in range(1, wanted)], 0.2 / wanted) if wanted > 1 else []
    splits = np.array(sorted({int(x) for x in cuts}), np.int64)
    run_of = F.pandas_udf(lambda keys: pd.Series(np.searchsorted(splits, keys.to_numpy(), "right")), "long")
    heads = {r["run"]: r["low"] for r in given.select(run_of("key").alias("run"), "key").groupBy("run").agg(F.min("key").alias("low")).collect()}
    order = sorted(heads)
    before = {heads[r]: order[k - 1] for k, r in enumerate(order)}

    def dealt(keys: pd.Series) -> pd.Series:
        runs_of = np.searchsorted(splits, keys.to_numpy(), "right")
        return pd.Series([[2 * r] + ([2 * before[k] + 1] if k in before else []) for k, r in zip(keys.tolist(), runs_of.tolist())])

    spread = given.select(F.explode(F.pandas_udf(dealt, "array<long>")("key")).alias("place"), "key", "text")
    spread = spread.select(F.expr("place div 2").alias("run"), (F.col("place") % 2 == 1).alias("closing"), "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[str] = []
        size, now, closed = 0, None, False
        for batch in batches:
            for r, closing, k, text in zip(*(batch.column(c).to_pylist() for c in ("run", "closing", "key", "text"))):
                if r != now:
                    now, closed, ids, texts, size = r, False, [], [], 0
                if closed:
                    continue
                texts.append(text)
                size += len(text)
                if closing or size >= _BLOCK and ids:
                    yield of(ids, texts)
                    texts, ids, size, closed = [text], [], len(text), closing
                ids.append(None if k == _LOW else k)

    # one run a partition: run numbers become places without gaps
    place = {r: k for k, r in enumerate(order)}
    placed = F.pandas_udf(lambda runs: runs.map(place).astype("int32"), "int")
    return spread.repartitionById(max(len(order), 1), placed("run")).sortWithinPartitions("run", "closing", "key", "text").mapInArrow(run, schema)
