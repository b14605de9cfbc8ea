"""How filters on whole texts interact: who removes what, in every order of application.

Every text is judged by all filters once, which gives a mask of the filters that it
fails. One of them is exact duplication: texts are routed by their xxhash, and the task
that a hash belongs to keeps chains of the different texts that share it, each with
the smallest id seen. An id that isn't its text's smallest fails. Each input task first
does the same with its own rows, so of a text that is copied a million times only one
copy a task is routed. Counts of masks are vectors, merged by partial aggregation; all
orders are then read off them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_HELD_BYTES = 32 << 20
_COUNTS = ("rows", "good", "toxic")


def _short(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def _repetitive(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def _shouting(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 2 * len(text)


def _marked(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, _MARKS)) < len(raw)


#: By letter, whether a text fails; it is given as characters, as UTF-8 and as words between ASCII white space.
TEXT_FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {"A": _short, "B": _repetitive, "C": _shouting, "D": _marked}
DUPLICATE = "E"

# Of a row: its text's hash, its id, its part, the mask of filters that its text fails. Chains are lists of
# [text, smallest id, parts of the rows with that id, mask of the text].
Chain = list[list]


def _meet(chains: dict[int, Chain], key: int, raw: bytes, doc_id, parts: Counter, mask: int) -> Iterator[tuple]:
    """Enter one text; yields ``(id, parts)`` of whatever isn't the smallest id any more."""
    chain = chains.setdefault(key, [])
    held = next((x for x in chain if x[0] == raw), None)
    if held is None:
        chain.append([raw, doc_id, parts, mask])
    elif doc_id == held[1]:
        held[2] += parts
    elif doc_id > held[1]:
        yield doc_id, parts
    else:
        yield held[1], held[2]
        held[1:3] = doc_id, parts


def _local(rows: Iterable, filters: dict, duplicate: int) -> Iterator[tuple]:
    """``(key, (text or None, id, parts, mask))``: of each text the smallest id among the task's rows, and what is decided.

    Decided rows travel without their text, under a key of their own, rows without an id
    as counts. Keys follow from the rows alone, so a task that runs again on the rows of a
    table sends the same to the same.
    """
    chains: dict[int, Chain] = {}
    nameless: dict[int, Counter] = {}
    held = 0

    def given() -> Iterator[tuple]:
        for key, chain in chains.items():
            for raw, doc_id, parts, mask in chain:
                yield key, (raw, doc_id, parts, mask)

    for key, doc_id, part, text in rows:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        mask = sum(1 << k for k, fails in enumerate(filters.values()) if fails(text, raw, words))
        if doc_id is None:
            nameless.setdefault(mask, Counter())[part] += 1
            continue
        before = sum(map(len, chains.get(key, ())))
        for loser, parts in _meet(chains, key, raw, doc_id, Counter([part]), mask):
            yield zlib.crc32(repr(loser).encode()), (None, loser, parts, mask | duplicate)
        held += len(raw) if sum(map(len, chains[key])) > before else 0
        if held > _HELD_BYTES:
            yield from given()
            chains.clear()
            held = 0
    yield from given()
    for mask, parts in nameless.items():
        yield mask, (None, None, parts, mask)


def _routed(rows: Iterable, duplicate: int) -> Iterator[tuple]:
    """``(id, part, mask, rows)``: of each text that is routed to the task, all but the smallest id fail as duplicates."""
    chains: dict[int, Chain] = {}
    for key, (raw, doc_id, parts, mask) in rows:
        if raw is None:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())
            continue
        for loser, others in _meet(chains, key, raw, doc_id, parts, mask):
            yield from ((loser, part, mask | duplicate, n) for part, n in others.items())
    for chain in chains.values():
        for _, doc_id, parts, mask in chain:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())


def failure_masks(docs: DataFrame, filters: dict = TEXT_FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, mask, rows)``: which filters each document fails, a bit each in order of ``filters``, then duplication.

    A null text is an empty one, a null part the empty string. A document is a duplicate
    if any smaller id has its text; rows with one id and one text don't make each other
    duplicates and are counted in ``rows``; a null id is neither smaller nor larger than any.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.xxhash64(text).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    duplicate = 1 << len(filters)
    # as many tasks as keep the chains of each small, however large the corpus
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _HELD_BYTES))
    routed = given.rdd.mapPartitions(lambda rows: _local(rows, filters, duplicate)).partitionBy(tasks, lambda key: key)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("rows", T.LongType())])
    return spark.createDataFrame(routed.mapPartitions(lambda rows: _routed(rows, duplicate)), schema, verifySchema=False)


def mask_counts(masks: DataFrame, labels: DataFrame, filters: int, id_col: str = "doc_id") -> RDD:
    """``(part, vector)``: of every mask, how many rows fail just these filters, and how many of them are good and toxic.

    A document is good or toxic if any of its label rows says so.
    """
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    flags = flags.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = masks.where("id is not null").join(flags, "id", "left").select("part", "mask", "rows", "good", "toxic")
    rest = masks.where("id is null").select("part", "mask", "rows", F.lit(0).alias("good"), F.lit(0).alias("toxic"))

    def vectors(rows: Iterable) -> Iterator[tuple[str, np.ndarray]]:
        for part, mask, n, good, toxic in rows:
            yield part, (mask, n, n if good else 0, n if toxic else 0)

    def start(value: tuple) -> np.ndarray:
        return more(np.zeros((1 << filters, len(_COUNTS)), np.int64), value)

    def more(vector: np.ndarray, value: tuple) -> np.ndarray:
        vector[value[0]] += value[1:]
        return vector

    return named.unionByName(rest).rdd.mapPartitions(vectors).combineByKey(start, more, lambda a, b: a + b)


def _orders(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray], np.ndarray]:
    """All ``(order, step)``; by kind of count, which masks each of them counts; and what each mask gives its filters' shares."""
    masks = np.arange(1 << len(letters))
    places, tables = [], {"kept": [], "removed": [], "redundant": [], "unique_fails": [], "shapley": []}
    fails = np.array([[bool(m >> k & 1) for k in range(len(letters))] for m in masks])
    # of all orders, a filter comes first among those that a text fails in the same share as every other of them
    share = np.where(fails, factorial(len(letters)) // np.maximum(fails.sum(1), 1)[:, None], 0)
    for order in permutations(range(len(letters))):
        before = np.zeros(len(masks), bool)
        for step, k in enumerate(order, 1):
            places.append(("".join(letters[x] for x in order), step))
            now = fails[:, k]
            tables["removed"].append(now & ~before)
            tables["redundant"].append(now & before)
            tables["unique_fails"].append(masks == 1 << k)
            tables["shapley"].append(share[:, k])
            before = before | now
            tables["kept"].append(~before)
    return places, {name: np.array(rows, np.int64) for name, rows in tables.items()}, share


AUDIT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict = TEXT_FILTERS, duplicate: str = DUPLICATE, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for every part, order of the filters, and step, zeros included; ``AUDIT_SCHEMA`` has the columns.

    ``kept`` are left after the step, ``removed`` go in it, ``redundant`` fail its filter but
    went before, ``unique_fails`` fail nothing else; ``good_lost`` and ``toxic_lost`` are
    the removed ones that ``labels`` marks; ``shapley`` is what the filter removes summed
    over all orders. An empty table has no parts and gives no rows. ``failure_masks`` says
    what nulls, ties and repeated rows do.
    """
    letters = "".join(filters) + duplicate
    counts = mask_counts(failure_masks(docs, filters, id_col, text_col, part_col), labels, len(letters), id_col)

    def expand(parts: Iterable) -> Iterator[tuple]:
        places, tables, _ = _orders(letters)
        for part, vector in parts:
            found = {name: table @ vector[:, 0] for name, table in tables.items()}
            lost = tables["removed"] @ vector[:, 1:]
            columns = [found[name].tolist() for name in ("kept", "removed", "redundant", "unique_fails")] + [lost[:, 0].tolist(), lost[:, 1].tolist(), found["shapley"].tolist()]
            for (order, step), *values in zip(places, *columns):
                yield part, order, step, *values

    return docs.sparkSession.createDataFrame(counts.mapPartitions(expand), AUDIT_SCHEMA, verifySchema=False)
