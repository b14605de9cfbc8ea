"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency over the corpus lies
in a band: neither everywhere nor in one document alone. A document's distinct
lexicon terms are sorted and hashed, once for each of several random subsets of
the lexicon; an edit changes only the hashes of the subsets it touches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.llm.words import blocks, seeds, word_hashes

BUCKETS = 1 << 22
SUBSETS = 8
KEPT = 0.2
LEAST_DOCS = 2
LEAST_SHARE = 1e-5
MOST_SHARE = 0.2
DIGITS = 12
MOST_HELD = 1 << 21


@dataclass
class Lexicon:
    """The band's term hashes in order, eight bytes each, a bit per bucket that holds one, and the subsets' salts.

    The bits only save searches: what counts is whether the hash itself is listed.
    """

    cells: bytes
    terms: bytes
    subsets: int = SUBSETS
    kept: float = KEPT

    def fingerprint(self, words: np.ndarray, text: str) -> list[str]:
        """One hash per subset. Without a term of the subset it is the hash of the whole text."""
        bits = np.frombuffer(self.cells, np.uint8)
        band = np.frombuffer(self.terms, "<u8")
        bucket = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
        terms = np.unique(words[(bits[bucket >> 3] >> (bucket & 7)) & 1 == 1])
        if len(terms):
            terms = terms[band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms]
        limit = np.uint64(int(self.kept * 2**64))
        out, whole = [], ""
        for salt in seeds(self.subsets, 701):
            own = terms[(terms ^ salt) * np.uint64(0xD6E8FEB86659FD93) < limit]
            if len(own):
                out.append(hashlib.blake2b(own.tobytes(), digest_size=DIGITS // 2).hexdigest())
            else:
                whole = whole or hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=DIGITS // 2, person=b"whole").hexdigest()
                out.append(whole)
        return out


def likeness(a: list[str], b: list[str]) -> float:
    """The share of subsets with equal hashes."""
    return sum(x == y for x, y in zip(a, b)) / len(a)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes, each once, and the sums of their counts."""
    terms, place = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    sums = np.zeros(len(terms), np.int64)
    np.add.at(sums, place, np.concatenate([n for _, n in parts]))
    return terms, sums


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        terms, sums = _summed(parts)
        for at in range(0, len(terms), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(terms[part].view(np.int64)), pa.array(sums[part])], ["term", "docs"])

    for batch in batches:
        for _, texts in blocks(batch.column("text").to_pylist()):
            (words,), offsets = word_hashes(texts)
            own = [np.unique(words[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
            terms, counts = np.unique(np.concatenate(own), return_counts=True)
            parts.append((terms, counts))
            held += len(terms)
            if held > MOST_HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > MOST_HELD // 2:
                    yield from rows()
                    parts, held = [], 0
    if held:
        yield from rows()


def learn_lexicon(docs: DataFrame, text_col: str = "text", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE, subsets: int = SUBSETS, kept: float = KEPT) -> Lexicon:
    """The lexicon of terms in at least ``least_docs`` documents, and in ``least_share`` to ``most_share`` of all.

    Document frequencies are counted exactly over all whole texts, per 64-bit hash
    of a term; tasks sum what they saw before they send it. The lexicon lists the
    band's hashes, eight bytes for each of them, beside a bitmap of ``BUCKETS`` bits.
    There are at most as many as a text has distinct terms on average, divided by
    ``least_share``, however large the corpus.
    """
    given = docs.select(F.col(text_col).alias("text")).where("text is not null")
    total = given.count()
    counts = given.mapInArrow(_document_frequencies, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    least = max(least_docs, least_share * total)
    band = counts.where((F.col("docs") >= least) & (F.col("docs") <= max(least, most_share * total)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("term").to_numpy().tobytes()], pa.binary())], ["terms"])

    found = b"".join(row["terms"] for row in band.select("term").mapInArrow(packed, "terms binary").toLocalIterator())
    terms = np.sort(np.frombuffer(found, np.uint64))
    flags = np.zeros(BUCKETS, np.uint8)
    flags[(terms & np.uint64(BUCKETS - 1)).astype(np.int64)] = 1
    return Lexicon(np.packbits(flags, bitorder="little").tobytes(), terms.astype("<u8").tobytes(), subsets, kept)


def fingerprints(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint)``: an array of one hash per lexicon subset for every row.

    Equal texts have equal fingerprints. Null texts are empty. Repeated rows give
    repeated rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column("text").to_pylist()):
                (words,), offsets = word_hashes(texts)
                found = [lexicon.fingerprint(words[offsets[i] : offsets[i + 1]], t or "") for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(texts)), pa.array(found, pa.list_(pa.string()))], ["id", "fingerprint"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fingerprint array<string>")
    return out.withColumnRenamed("id", id_col)
