"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: class c holds items of 2**(c-1)+1 .. 2**c
five-word shingles, class 0 those of one. A document is scanned once per class through overlapping
windows of twice the class size, so an item always lies whole in a window of
comparable size, however long the document is, and the resemblance of window and
item stays bounded below. Windows whose minimum under one of the hash functions
equals the item's become candidates; each is verified by counting exactly which
of the item's shingles the whole document holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.llm.words import blocks, seeds, shingle_hashes, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 48
ITEMS_PER_BLOCK = 20_000
BLOCKS_PER_SCAN = 4
CHARS_PER_BLOCK = 16_000_000


class ItemIndex:
    """MinHash keys of one block of items, by size class."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = SHINGLE, hashes: int = HASHES):
        self.size = size
        self.salts, self.odds = seeds(hashes, 401), seeds(hashes, 402) | np.uint64(1)
        self.ids: list[int] = []
        self.shingles: list[np.ndarray] = []
        classes: dict[int, list[int]] = defaultdict(list)
        (words,), offsets = word_hashes([text for _, text in items])
        for i, (item_id, _) in enumerate(items):
            own = np.unique(shingle_hashes(words[offsets[i] : offsets[i + 1]], size))
            if len(own):
                classes[int(len(own) - 1).bit_length()].append(len(self.ids))
                self.ids.append(item_id)
                self.shingles.append(own)
        # per class and hash function: the items' minima in order, and whose they are
        self.classes = {}
        for c, members in sorted(classes.items()):
            minima = np.array([((self.shingles[m][None, :] ^ self.salts[:, None]) * self.odds[:, None]).min(axis=1) for m in members])
            order = np.argsort(minima, axis=0, kind="stable")
            self.classes[c] = (np.take_along_axis(minima, order, axis=0), np.array(members)[order])

    def candidates(self, shingles: np.ndarray, bounds: np.ndarray) -> list[set[int]]:
        """Per document, the items that share a minimum with some window of it.

        ``shingles`` holds several documents one after the other, the k-th at
        ``bounds[k]:bounds[k + 1]``; windows never reach into the next one.
        """
        found: list[set[int]] = [set() for _ in bounds[1:]]
        if not len(shingles):
            return found
        finest = 1 << min(self.classes)
        cuts, owner = _parts(np.diff(bounds), finest)
        levels = []  # per class: how finest parts join to its parts, and whose they are
        for c, (minima, members) in self.classes.items():
            per = (1 << c) // finest
            joins, whose = _parts(np.bincount(owner, minlength=len(found)), per)
            levels.append((joins, whose, np.flatnonzero(whose[1:] != whose[:-1]), minima, members))
        hashed = np.empty_like(shingles)
        for h, (salt, odd) in enumerate(zip(self.salts, self.odds)):
            np.bitwise_xor(shingles, salt, out=hashed)
            np.multiply(hashed, odd, out=hashed)
            low = np.minimum.reduceat(hashed, cuts)
            for joins, whose, last, minima, members in levels:
                part = np.minimum.reduceat(low, joins) if len(joins) < len(low) else low
                window = part.copy()
                np.minimum(part[:-1], part[1:], out=window[:-1])
                window[last] = part[last]
                column = minima[:, h]
                at = np.minimum(np.searchsorted(column, window), len(column) - 1)
                for w in np.flatnonzero(column[at] == window):
                    k = at[w]
                    while k < len(column) and column[k] == window[w]:
                        found[whose[w]].add(int(members[k, h]))
                        k += 1
        return found

    def matches(self, found: set[int], shingles: np.ndarray, least: float) -> list[tuple[int, float]]:
        """The candidates of which the document holds at least the share ``least``, with that share."""
        held = np.unique(shingles) if found else shingles
        out = []
        for k in sorted(found):
            own = self.shingles[k]
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            share = float((held[at] == own).sum()) / len(own)
            if share + 1e-12 >= least:
                out.append((self.ids[k], share))
        return out


def _parts(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where parts of ``width`` begin in runs of the given sizes laid end to end, and whose they are."""
    counts = -(-sizes // width)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (np.cumsum(sizes) - sizes)[owner] + nth * width, owner


def _scan(shared: Broadcast, size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows: list[tuple] = []
            for start, texts in blocks(batch.column("text").to_pylist()):
                (words,), offsets = word_hashes(texts)
                shingles = shingle_hashes(words, size)
                ends = np.repeat(offsets[1:], np.diff(offsets))[: len(shingles)]
                inside = np.arange(len(shingles)) + size <= ends
                bounds = np.concatenate(([0], np.cumsum(inside)))[np.minimum(offsets, len(shingles))]
                shingles = shingles[inside]
                for index in shared.value:
                    for i, found in enumerate(index.candidates(shingles, bounds)):
                        if found:
                            rows += [(ids[start + i], item, share) for item, share in index.matches(found, shingles[bounds[i] : bounds[i + 1]], least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["id", "item_id", "containment"])

    return run


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded number and text, streamed from the table."""
    block, chars = [], 0
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        chars += len(row["text"] or "")
        if len(block) >= ITEMS_PER_BLOCK or chars >= CHARS_PER_BLOCK:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = CONTAINMENT, size: int = SHINGLE, hashes: int = HASHES) -> DataFrame:
    """``(id_col, item_id, containment)`` for every document that holds a test item.

    ``containment`` is the share of the item's distinct five-word shingles found
    anywhere in the document; pairs of at least ``least`` are returned. An item of
    2**c shingles at most meets windows of 2**(c+1), so at containment 0.8 window
    and item resemble each other by 0.19 or more, and 48 hash functions miss such
    a pair with probability ``(1 - 0.19)**48 < 5e-5``; an item held whole is
    missed with probability below 2e-6.

    Items are the stated query set: they are held in blocks of at most 20 000
    items or 16 million characters, and ``BLOCKS_PER_SCAN`` blocks are compared with
    all documents in one scan without a shuffle. Items of fewer than five words have no shingle
    and match nothing, nor do null or empty texts on either side. Repeated items,
    and repeated documents, give one row per pair of ids. Ids that aren't numbers
    raise Spark's cast error. Null ids are kept as
    ids. Empty tables give an empty result; other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    schema = "id long, item_id long, containment double"
    out, held = None, []

    def scan() -> DataFrame:
        part = given.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(list(held)), size, least), schema)
        held.clear()
        return part if out is None else out.unionByName(part)

    for block in _item_blocks(tests):
        index = ItemIndex(block, size, hashes)
        held += [index] if index.classes else []
        if len(held) == BLOCKS_PER_SCAN:
            out = scan()
    if held:
        out = scan()
    if out is None:
        out = given.sparkSession.createDataFrame([], schema)
    return out.groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("containment").alias("containment"))


def without_contamination(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in no hit; rows without an id are kept."""
    found = hits.select(F.col(id_col).alias("_hit")).distinct()
    return docs.join(found, docs[id_col] == found["_hit"], "left_anti")
