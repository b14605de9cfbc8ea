"""URL rules by Bloom filter cascades: exact membership without joins.

The keys that a URL could match are all pairs of a host suffix and a path prefix
of a length that some rule has. Over all keys of the corpus, the key universe,
a cascade is exact: level 1 holds the listed keys, level 2 the keys of the
universe that level 1 takes wrongly, level 3 the listed keys that level 2 takes,
and so on until no key is taken wrongly. A key is listed if the first level that
lacks it is an even one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenun.sources.shared import Workspace

RULES_PER_CASCADE = 5_000_000
LEVEL_RATE = 0.5
BITMAP_ROWS = 1 << 16


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes per key, for double hashing."""
    raw = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
    pairs = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
    return pairs | np.array([[0, 1]], np.uint64)


class Bloom:
    """A Bloom filter over hash pairs; ``salt`` makes levels independent."""

    def __init__(self, n: int, rate: float, salt: int):
        self.bits = max(64, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2))
        self.probes = max(1, round(-math.log2(rate)))
        self.salt = salt
        self.cells = np.zeros((self.bits + 7) // 8, np.uint8)

    def spots(self, pairs: np.ndarray) -> np.ndarray:
        first = (pairs[:, 0] ^ np.uint64(self.salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        first ^= first >> np.uint64(29)
        return (first[:, None] + pairs[:, 1, None] * np.arange(1, self.probes + 1, dtype=np.uint64)) % np.uint64(self.bits)

    def add(self, pairs: np.ndarray) -> None:
        at = self.spots(pairs).ravel()
        np.bitwise_or.at(self.cells, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, pairs: np.ndarray) -> np.ndarray:
        at = self.spots(pairs)
        return ((self.cells[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """Bloom filter levels; exact for the listed keys and for the universe it was built over."""

    def __init__(self):
        self.levels: list[Bloom] = []

    def has(self, keys: list[str]) -> np.ndarray:
        return self.listed(_hashes(keys)) if keys else np.zeros(0, bool)

    def listed(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), bool)
        open_ = np.arange(len(pairs))
        for k, level in enumerate(self.levels):
            inside = level.has(pairs[open_])
            out[open_[~inside]] = k % 2 == 1
            open_ = open_[inside]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _passing(level: Bloom, negative: Broadcast | None):
    """Distinct keys of a task that ``level`` takes, without the listed ones in ``negative``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sorted({k for row in batch.column("keys").to_pylist() for k in row})
            if keys:
                taken = level.has(_hashes(keys))
                keys = [k for k, t in zip(keys, taken) if t and (negative is None or k not in negative.value)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    return run


def _cells(level: Bloom):
    """A task's keys as set cells of a level: (row of the bitmap, its bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(1, 0.5, level.salt)
        own.bits, own.probes, own.cells = level.bits, level.probes, np.zeros_like(level.cells)
        for batch in batches:
            own.add(_hashes(batch.column("key").to_pylist()))
        places = range(0, len(own.cells), BITMAP_ROWS)
        rows = [(at, own.cells[at : at + BITMAP_ROWS]) for at in places if own.cells[at : at + BITMAP_ROWS].any()]
        yield pa.RecordBatch.from_arrays([pa.array([at for at, _ in rows], pa.int64()), pa.array([c.tobytes() for _, c in rows], pa.binary())], ["place", "cells"])

    return run


def _filled(keys: DataFrame, n: int, rate: float, salt: int) -> Bloom:
    """A level over ``keys``; tasks send bitmaps of the level's size, not keys."""
    level = Bloom(n, rate, salt)
    for row in keys.mapInArrow(_cells(level), "place long, cells binary").toLocalIterator():
        part = np.frombuffer(row["cells"], np.uint8)
        level.cells[row["place"] : row["place"] + len(part)] |= part
    return level


def build_cascade(listed: list[str], universe: DataFrame, work: Workspace, name: str) -> Cascade:
    """A cascade for ``listed`` over ``universe`` (column ``keys``).

    The universe is read once: keys that level 1 takes wrongly are written out, and
    only they, a share that halves twice with every further pair of levels, are
    looked at again. Level 1's error rate is set so that about as many keys pass
    wrongly as are listed, which keeps all levels in proportion to the list.
    """
    cascade = Cascade()
    if not listed:
        return cascade
    keys = sorted(set(listed))
    total = universe.select(F.sum(F.size("keys")).alias("n")).first()["n"] or 0
    first = Bloom(len(keys), min(0.5, max(1e-9, len(keys) / max(total, 1))), 1)
    first.add(_hashes(keys))
    cascade.levels.append(first)
    inside = work.spark.sparkContext.broadcast(frozenset(keys))
    wrong = work.save(universe.mapInArrow(_passing(first, inside), "key string").distinct(), f"{name}-1")
    held = keys
    while (n := wrong.count()) and held:
        salt = len(cascade.levels) + 1
        cascade.levels.append(even := _filled(wrong, n, LEVEL_RATE, salt))
        taken = even.has(_hashes(held))
        held = [k for k, t in zip(held, taken) if t]
        if not held:
            break
        odd = Bloom(len(held), LEVEL_RATE, salt + 1)
        odd.add(_hashes(held))
        cascade.levels.append(odd)
        again = wrong.select(F.array("key").alias("keys")).mapInArrow(_passing(odd, None), "key string")
        wrong = work.save(again, f"{name}-{salt + 1}")
    return cascade


def _cascades(listed: set[str], universe: DataFrame, work: Workspace, name: str) -> list[Cascade]:
    """One cascade for each ``RULES_PER_CASCADE`` keys."""
    keys = sorted(listed)
    return [build_cascade(keys[at : at + RULES_PER_CASCADE], universe, work, f"{name}-{at}") for at in range(0, len(keys), RULES_PER_CASCADE)]


def _candidates(hosts: set[int], lengths: list[int]):
    """The keys a URL could match, longest first; a host suffix starts at a label and has the length of some rule's host."""

    def of(host: str, path: str) -> list[str]:
        if not host:
            return []
        starts = [0] + [i + 1 for i, c in enumerate(host) if c == "."]
        keys = [(len(host) - s + n, host[s:] + path[:n]) for s in starts if len(host) - s in hosts for n in lengths if n <= len(path)]
        return [k for _, k in sorted(keys, key=lambda x: -x[0])]

    return of


def judge_urls(pages: DataFrame, block: list[tuple[str, str]], allow: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row.

    Rules are pairs of host and path: one fits its host and all subdomains if the
    URL's path starts with the rule's. The longest fitting rule (host and path
    together) decides; a rule that is both allowed and blocked counts as allowed.
    Without a fitting rule the verdict is ``default``: nothing listed speaks
    against the URL. ``rule`` is the rule as host and path in one string, else null.

    Null URLs, and URLs without ``://``, have an empty host and path and fit no
    rule. Repeated rows give repeated rows, null ids are kept, other columns are
    not read, and an empty table gives an empty result. Rules with an empty host
    or a path that doesn't start with ``/`` raise an error.
    """
    rules = [*block, *allow]
    if bad := [r for r in rules if not r[0] or not r[1].startswith("/")]:
        raise ValueError(f"not a rule: {bad[0]}")
    blocked, allowed = {h + p for h, p in block} - {h + p for h, p in allow}, {h + p for h, p in allow}
    candidates = _candidates({len(h) for h, _ in rules}, sorted({len(p) for _, p in rules}))
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [candidates(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.string()))], ["keys"])

    work = Workspace(pages.sparkSession, "url-filter")
    universe = parsed.select("host", "path").mapInArrow(keyed, "keys array<string>")
    cascades = work.spark.sparkContext.broadcast((_cascades(blocked, universe, work, "block"), _cascades(allowed, universe, work, "allow")))

    def listed(parts: list[Cascade], keys: list[str]) -> list[bool]:
        return np.any([c.has(keys) for c in parts], axis=0).tolist() if parts else [False] * len(keys)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [candidates(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            flat = [k for row in rows for k in row]
            stop, go = cascades.value
            is_blocked, is_allowed = listed(stop, flat), listed(go, flat)
            found, at = [], 0
            for row in rows:
                hit = next(((k, "block" if is_blocked[i] else "allow") for i, k in enumerate(row, at) if is_blocked[i] or is_allowed[i]), (None, default))
                found.append(hit)
                at += len(row)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("path"), pa.array([r for r, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(judged, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
