"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams in order of
frequency. A text's own list is compared with each profile by the out-of-place
distance: how far each n-gram's rank differs, with a fixed cost for n-grams the
profile lacks. The nearest profile names the language.

N-grams are runs of one to three code points of the lower-cased text, in which
every run of characters other than letters is one blank.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenun.llm.words import blocks
from tenun.sources.shared import Workspace

ORDERS = (1, 2, 3)
PROFILE = 400
UNDETERMINED = "und"
MOST_LANGUAGES = 1000
#: Possible n-grams of a text's letters, for each of its characters, up to which they are counted in bins.
BINS = 32
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; fractions and raised digits are word characters, but none."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    return np.frombuffer(_OTHER.sub(" ", every).encode("utf-32-le", "surrogatepass"), np.uint32) != 32


def _code_points(text: str) -> np.ndarray:
    """The lower-cased text between two blanks, in which every run of other characters is one blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    return np.where(letter, points, np.uint32(32))[kept].astype(np.uint64)


_BLANK_PAIR = np.uint64(32 << 21 | 32)


def _grams(points: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
    """All n-grams, each packed into 64 bits: up to three code points of 21 bits.

    Texts may stand one after the other: two blanks in a row mark where one ends,
    and no n-gram reaches across.
    """
    out, gram = [], np.zeros(len(points), np.uint64)
    several = bool(((points[1:] == 32) & (points[:-1] == 32)).any())
    for n in range(1, max(orders) + 1):
        gram = (gram[: len(points) - n + 1] << np.uint64(21)) | points[n - 1 :]
        if n in orders and n > 1 and not several:
            out.append(gram)
        elif n in orders:
            # a lone blank says nothing
            crosses = gram == (32 if n == 1 else _BLANK_PAIR)
            if n == 3:
                crosses = (gram >> np.uint64(21) == _BLANK_PAIR) | (gram & np.uint64((1 << 42) - 1) == _BLANK_PAIR)
            out.append(gram[~crosses])
    return np.concatenate(out)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their numbers."""
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams in order; equal counts in order of the n-gram."""
    kinds, numbers = counted(grams)
    if len(kinds) > 4 * most:
        least = np.partition(numbers, len(numbers) - most)[len(numbers) - most]
        keep = numbers >= least
        kinds, numbers = kinds[keep], numbers[keep]
    return kinds[np.argsort(-numbers, kind="stable")][:most]


def ranked_of(points: np.ndarray, orders: tuple[int, ...], most: int) -> np.ndarray:
    """``ranked(_grams(points, orders), most)`` of one text.

    Where the text has few different letters for its length, every possible n-gram of
    these is a bin to count in, and nothing is sorted but the counts.
    """
    top, longest = int(points.max()) + 1, max(orders)
    if top > 1 << 16:
        return ranked(_grams(points, orders), most)
    at = points.astype(np.int64)
    place = np.zeros(top, np.int64)
    place[at] = 1
    letters = place.nonzero()[0]
    base = len(letters)
    if base**longest > BINS * len(at):
        return ranked(_grams(points, orders), most)
    place[letters] = np.arange(base)
    gram = codes = place[at]
    # a key for each n-gram: how rare, how long, and its letters as digits; so keys are in the order asked for
    bits = (base**longest).bit_length()
    keys = []
    for n in range(1, longest + 1):
        if n > 1:
            gram = gram[:-1] * base + codes[n - 1 :]
        if n in orders:
            numbers = np.bincount(gram)
            if n == 1 and letters[0] == 32:  # a lone blank says nothing
                numbers[0] = 0
            found = (numbers != 0).nonzero()[0]
            keys.append(found + ((n - (numbers[found] << 8)) << bits))
    keys = np.concatenate(keys)
    keys = np.sort(np.partition(keys, most)[:most] if len(keys) > most else keys)
    length, code = keys >> bits & 255, keys & (1 << bits) - 1
    packed = np.zeros(len(keys), np.int64)
    for k in range(longest):
        rest = code // base
        packed |= np.where(length > k, letters[code - rest * base], 0) << (21 * k)
        code = rest
    return packed.astype(np.uint64)


class Profiles:
    """Ranks of every n-gram of any profile in each profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE, orders: tuple[int, ...] = ORDERS):
        self.names = sorted(profiles)
        self.size, self.orders = size, orders
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[k, np.searchsorted(self.grams, np.array(profiles[name], np.uint64))] = np.arange(len(profiles[name]))
        # an n-gram that a profile lacks is as far from every place as any can be
        self.places = np.where(self.ranks < 0, 2 * size, self.ranks)

    def distances(self, text: str) -> np.ndarray:
        """Mean out-of-place distance to each profile, as a share of the greatest possible."""
        own = ranked_of(_code_points(text), self.orders, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = np.where(self.grams[at] == own, at, len(self.grams))
        moved = self.places.take(at, axis=1)
        moved -= np.arange(len(own), dtype=np.int32)
        np.minimum(np.abs(moved, out=moved), self.size, out=moved)
        return moved.sum(axis=1) / (len(own) * self.size)

    def identify(self, text: str | None) -> tuple[str, float]:
        """The nearest profile's language, and how much nearer it is than the second nearest."""
        if not text or not self.names or not has_letter(text):
            return UNDETERMINED, 0.0
        far = self.distances(text)
        best = int(np.argmin(far))
        least, *rest = sorted(far.tolist())
        if not rest:
            return self.names[best], 1 - least
        return self.names[best], 1 - least / rest[0] if rest[0] > 0 else 0.0


def _count_grams(orders: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, texts in blocks(batch.column("text").to_pylist(), 1 << 19):
                for lang in sorted({x for x in langs[start : start + len(texts)]}):
                    joined = [_code_points(t) for x, t in zip(langs[start : start + len(texts)], texts) if x == lang and t]
                    if not joined:
                        continue
                    kinds, numbers = counted(_grams(np.concatenate(joined), orders))
                    if lang in sums:
                        both, place = np.unique(np.concatenate((sums[lang][0], kinds)), return_inverse=True)
                        kinds, numbers = both, np.bincount(place, np.concatenate((sums[lang][1], numbers)), len(both)).astype(np.int64)
                    sums[lang] = kinds, numbers
        for lang, (kinds, numbers) in sums.items():
            names = ["lang", "gram", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(numbers, pa.int64())], names)

    return run


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, orders: tuple[int, ...] = ORDERS) -> Profiles:
    """Profiles of all languages in ``docs``, counted over every row with a text and a language.

    Tasks count their own n-grams, so a language that most rows share is summed
    up before the shuffle. What comes to the driver is ``size`` n-grams for each
    of at most ``MOST_LANGUAGES`` languages; more raise an error.
    """
    work = Workspace(docs.sparkSession, "profiles")
    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = given.mapInArrow(_count_grams(orders), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = work.save(counts.withColumn("place", place).where(F.col("place") <= size), "profiles")
    if (languages := top.select("lang").distinct().count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MOST_LANGUAGES} can be told apart")
    found: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "place").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(found, size, orders)


def identify_languages(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` for every row, from the whole text alone.

    ``score`` is the margin to the second nearest profile, 0 to 1. Null texts, and
    texts without a letter, are ``und`` with score 0, as is every text if nothing
    was learned. Ties go to the language that sorts first, with score 0. Repeated rows give
    repeated rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.identify(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
