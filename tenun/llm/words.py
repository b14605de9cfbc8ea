"""Word and shingle hashing over whole texts, vectorised in numpy.

A word is a maximal run of letters, digits or underscores of the lower-cased
text (``[\\p{L}\\p{N}_]+``). A word's hash is a polynomial over its UTF-8 bytes
modulo 2**64, read off prefix sums, so one text costs a few array passes and no
Python object per word. Hashes depend on the word alone: they are the same in
every process and on every machine.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18
_WORD = re.compile(rb"[0-9A-Za-z_\x80-\xff]+")
_FOREIGN = re.compile(r"[^\w\x00-\x7f]+")

_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(salt))


_value = seeds(256, 7)


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, _SLICE + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
    return have[:n]


def normal_bytes(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which the bytes of words, and no others, are word bytes."""
    if not text:
        return b""
    text = text.lower()
    if not text.isascii():
        text = _FOREIGN.sub(" ", text)
    return text.encode("utf-8", "replace")


def _slices(data: bytes) -> Iterator[tuple[int, int]]:
    """Cut at bytes outside words, about every ``_SLICE`` bytes."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _SLICE)
        while end < n and _is_word[data[end]]:
            end += 1
        yield at, end
        at = end


def word_hashes(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words of ``texts``, and where each text's words begin.

    Returns ``([words, *prefix hashes], offsets)``: text ``i`` has the words
    ``offsets[i]:offsets[i + 1]``. Each length in ``prefixes`` adds the hashes of
    the words' first so many bytes.
    """
    parts = [normal_bytes(t) for t in texts]
    data = b"\n".join(parts) + b"\n"
    out: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    starts = []
    for at, end in _slices(data):
        raw = np.frombuffer(data, np.uint8, end - at, at)
        inside = _is_word[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_value[raw] * _power("up", _BASE, len(raw)), out=sums[1:])
        down = _power("down", _BASE_INVERSE, len(raw) + 1)[first]
        for k, size in enumerate((None, *prefixes)):
            to = last if size is None else np.minimum(last, first + size)
            out[k].append(mix((sums[to] - sums[first]) * down + (to - first).astype(np.uint64)))
        starts.append(first + at)
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    place = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out], np.searchsorted(place, begins)


def word_sizes(text: str | None) -> np.ndarray:
    """The words' lengths in bytes, in order."""
    return np.array([len(w) for w in _WORD.findall(normal_bytes(text))], np.int64)


def shingle_hashes(words: np.ndarray, size: int = 5, short: bool = False) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with ``short``, a shorter text is one run."""
    if len(words) < size:
        if not short or not len(words):
            return np.zeros(0, np.uint64)
        size = len(words)
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for j, odd in enumerate(seeds(size, 11) | np.uint64(1)):
        total += words[j : j + n] * odd
    return mix(total + np.uint64(size))


def occurrence_labels(keys: np.ndarray) -> np.ndarray:
    """Make repeated keys distinct: the n-th occurrence of a key gets its own label."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.arange(len(keys))
    again = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    if not again.any():
        return keys
    nth = at - np.maximum.accumulate(np.where(again, 0, at))
    out = np.empty_like(keys)
    out[order] = ordered + nth.astype(np.uint64) * np.uint64(_ODD)
    return out


def blocks(texts: Iterable[str | None], limit: int = _SLICE) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``limit`` characters, with the first one's index."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        run.append(text)
        size += len(text or "")
        if size >= limit:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run
