"""Best-fit packing of token sequences with exact complements.

Only the number of pieces of each length matters for the plan, so it is made on
a histogram of at most ``capacity`` counts, whatever the size of the corpus: from
the longest length down, the gap it leaves is looked up among single lengths,
then pair sums, then triple sums, and as many sequences are filled exactly as
the counts allow; what can't be completed exactly is packed best-fit. Pieces are
then numbered within their length and dealt to the planned places.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenun.sources.shared import Workspace

CAPACITY = 2048
END_ID = 0
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by a faster library.

    Merge order and id order are the same in such a file, so its vocabulary serves
    as ranks; special tokens' strings are ordinary text. The ids equal those of
    ``tokenizers`` with ``encode_special_tokens`` set; ``token_ids`` gives added
    tokens their own ids.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    special = {t["id"] for t in given["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in given["model"]["vocab"].items() if i not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def token_ids(path: str):
    """A function from a text to the ids that ``tokenizers`` gives it with the file's own settings.

    Texts that hold the string of an added token are left to ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        added = [t["content"] for t in json.load(file)["added_tokens"]]
    fast, whole = encoder(path).encode_to_numpy, Tokenizer.from_file(path)

    def ids(text: str) -> np.ndarray:
        if any(a in text for a in added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast(text, disallowed_special=())

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: only the first may be shorter than ``capacity``."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), end_id).astype("<u4")
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


class _Counts:
    """How many pieces of each length are left; a bit per length that is."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [0] * (capacity + 1)
        self.bits = self.mirror = 0
        self.capacity = capacity
        for length, n in counts.items():
            self.take(length, -n)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        on = 1 if self.left[length] > 0 else 0
        self.bits = self.bits & ~(1 << length) | on << length
        at = self.capacity - length
        self.mirror = self.mirror & ~(1 << at) | on << at

    def largest(self, most: int) -> int:
        """The largest length left that is at most ``most``, or 0."""
        return ((self.bits & ((2 << most) - 1)).bit_length() - 1) if most > 0 and self.bits & ((2 << most) - 1) else 0

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths left that sum to ``total``, the larger one at most ``most`` and as large as can be."""
        # bit a of the shifted mirror: length total - a is left
        shift = self.capacity - total
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift)
        both &= (2 << min(most, total - 1)) - 1 if min(most, total - 1) > 0 else 0
        both &= ~((1 << ((total + 1) // 2)) - 1)
        while both:
            a = both.bit_length() - 1
            if a != total - a or self.left[a] > 1:
                return a, total - a
            both &= ~(1 << a)
        return None

    def complement(self, gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that sum to ``gap`` exactly."""
        if gap <= most and self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap, most):
            return found
        a = self.largest(min(gap - 2, most))
        while 3 * a >= gap and a:
            self.left[a] -= 1
            found = self.pair(gap - a, a if self.left[a] else a - 1)
            self.left[a] += 1
            if found:
                return (a, *found)
            a = self.largest(a - 1)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as ``(lengths in order, how many alike)``; places each counted piece once."""
    have = _Counts(counts, capacity)
    out: list[tuple[tuple[int, ...], int]] = []

    def times(lengths: list[int]) -> int:
        return min(have.left[x] // lengths.count(x) for x in set(lengths))

    while top := have.largest(capacity):
        have.take(top, 1)
        rest = have.complement(capacity - top, top) if top < capacity else ()
        have.take(top, -1)
        if rest is not None:
            lengths = [top, *rest]
        else:  # no exact complement: the largest that fits, again and again
            lengths, gap = [top], capacity - top
            while True:
                have.take(lengths[-1], 1)
                rest = have.complement(gap, capacity) if len(lengths) > 1 else None
                nxt = have.largest(gap)
                if rest is not None or not nxt:
                    break
                lengths.append(nxt)
                gap -= nxt
            for x in lengths:
                have.take(x, -1)
            lengths += rest or ()
        n = times(lengths)
        for x in lengths:
            have.take(x, n)
        out.append((tuple(lengths), n))
    return out


class Places:
    """Where the n-th piece of each length goes."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]):
        self.first: dict[int, list[int]] = {}
        self.where: dict[int, list[tuple[int, int]]] = {}
        self.sequences = 0
        used: dict[int, int] = {}
        for lengths, n in planned:
            offset = 0
            for x in lengths:
                self.first.setdefault(x, []).append(used.get(x, 0))
                self.where.setdefault(x, []).append((self.sequences, offset))
                used[x] = used.get(x, 0) + n
                offset += x
            self.sequences += n

    def __call__(self, length: int, rank: int) -> tuple[int, int]:
        k = bisect_right(self.first[length], rank) - 1
        sequence, offset = self.where[length][k]
        return sequence + rank - self.first[length][k], offset


def _dealt(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [places(x, r) for x, r in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist())]
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([s for s, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64())], [*keep, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    A document's token ids end with ``end_id``; only documents of more than
    ``capacity`` ids are cut. Sequences hold at most ``capacity`` ids and have no
    gaps. ``tokenizer`` is the path of a byte-level BPE file that every executor
    can read. The plan is exact bookkeeping over all pieces: each gets one place.

    Null and empty texts are the end id alone. Repeated rows are documents of their
    own. A null id is kept; ids that aren't numbers raise Spark's cast error. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut_up = given.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES_SCHEMA)
    part = F.spark_partition_id().alias("_part")
    row = F.monotonically_increasing_id().alias("_row")
    pieces = work.save(cut_up.select("*", part, row), "pieces")

    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    counts = work.save(counts, "counts", 4)
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(totals, capacity)))

    by_length = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_row")) - 1
    # partitions times lengths is too much to broadcast; the rows are dealt by both already
    ranked = pieces.withColumn("_nth", inside).join(bases.hint("merge"), ["_part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("_nth")).alias("rank"))
    return ranked.mapInArrow(lambda batches: _dealt(places.value)(batches), PIECES_SCHEMA + ", sequence_id long, offset long")
