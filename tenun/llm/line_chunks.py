"""Removal of content-defined line chunks that repeat across documents, in DataFrame functions only.

Every non-blank line is hashed. A hash rolls over the hashes of each two neighbouring
lines, and where it has residue 0 by one modulus for all lines, whatever their length,
a boundary lies after the second of them; boundaries don't follow each other directly. The
stretches between boundaries are the chunks. So chunks depend on their own lines and
the two before them alone: a pasted passage has the same ones everywhere, whatever
its shift. A chunk that also stands in a document with a smaller id goes.

A passage of a few lines often holds no whole chunk, and the ends of a longer one
never do. What the chunks leave is found by runs, the second level: stretches of lines each two
neighbours of which also stand as neighbours in a document with a smaller id. Both levels
compare bytes with the smallest such document before a line goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenun.sources.shared import Workspace

LONG_RUN_WORDS = 50
LEAST_RUN = 3
MODULUS = 4
_LOW_BITS = (1 << 32) - 1
_CHUNK, _PAIR, _LINE = range(3)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lines(text: Column) -> Column:
    """The non-blank lines as structs of position ``p`` and ``line``."""
    lines = F.transform(F.split(text, "\n", -1), lambda line, p: F.struct(p.alias("p"), line.alias("line")))
    return F.filter(lines, lambda x: F.length(F.trim(x["line"])) > 0)


def _hashed(lines: Column) -> Column:
    """The lines with ``h``, 32 bits of the MD5 that boundaries go by, ``key``, 64 bits to group by, and ``n`` characters."""
    h = lambda x: F.conv(F.substring(F.md5(x["line"]), 1, 8), 16, 10).cast("long")
    return F.transform(lines, lambda x: F.struct(x["p"].alias("p"), h(x).alias("h"), F.xxhash64(x["line"]).alias("key"), F.length(x["line"]).alias("n"), x["line"].alias("line")))


def _may_end(a: Column, b: Column, modulus: int) -> Column:
    """Whether a hash rolling over the hashes of line ``a`` and of line ``b`` behind it has residue 0."""
    return F.floor((a["h"] * 31 + b["h"]).bitwiseAND(F.lit(_LOW_BITS)) / 31) % modulus == 0


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n]+"))


def _chunks(text: Column, long_run: int, modulus: int) -> Column:
    """Chunks, pairs of neighbours, and long lines: number of the first line, how many lines, the kind, the key of their hashes."""

    def of(lines: Column) -> Column:
        size = F.size(lines)
        may_end = F.zip_with(F.slice(lines, 1, F.greatest(size - 1, F.lit(0))), F.slice(lines, 2, size), lambda a, b: _may_end(a, b, modulus))
        # a boundary lies behind line i if it may and doesn't lie behind a line that may right before
        boundary = F.transform(may_end, lambda x, i: F.when(x & ~F.coalesce(F.get(may_end, i - 1), F.lit(False)), i + 1))
        ends = F.filter(boundary, lambda x: x.isNotNull())
        return _let(F.struct(lines.alias("lines"), F.transform(lines, lambda x: x["key"]).alias("keys"), ends.alias("ends")), found)

    def found(b: Column) -> Column:
        piece = lambda at, n, kind, key: F.struct(at.alias("at"), n.cast("int").alias("n"), F.lit(kind).alias("kind"), key.alias("key"))
        last = F.array(F.size(b["keys"]) - 1)
        stretches = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(b["ends"], lambda e: e + 1)), F.concat(b["ends"], last), lambda i, j: F.struct(i.alias("i"), (j - i + 1).alias("n")))
        chunks = F.transform(F.filter(stretches, lambda x: x["n"] > 1), lambda x: piece(x["i"], x["n"], _CHUNK, F.xxhash64(F.slice(b["keys"], x["i"] + 1, x["n"]))))
        numbers = F.when(F.size(b["keys"]) > 1, F.sequence(F.lit(0), F.size(b["keys"]) - 2)).otherwise(F.array().cast("array<int>"))
        pairs = F.transform(numbers, lambda i: piece(i, F.lit(2), _PAIR, F.xxhash64(F.get(b["keys"], i), F.get(b["keys"], i + 1))))
        long_ = lambda x: F.when(x["n"] > 2 * long_run, _words(x["line"]) > long_run).otherwise(False)
        lines = F.transform(b["lines"], lambda x, i: F.when(long_(x), piece(i, F.lit(1), _LINE, x["key"])))
        return F.concat(chunks, pairs, F.filter(lines, lambda c: c.isNotNull()))

    return _let(_hashed(_lines(text)), of)


def _texts(text: Column, marks: Column) -> Column:
    """``marks`` with each marked piece's text and the positions of its lines."""

    def of(lines: Column) -> Column:
        def told(m: Column) -> Column:
            here = F.slice(lines, m["at"] + 1, m["n"])
            return F.struct(m.alias("m"), F.transform(here, lambda x: x["p"]).alias("ps"), F.array_join(F.transform(here, lambda x: x["line"]), "\n").alias("text"))

        return F.transform(marks, told)

    return _let(_lines(text), of)


def _without(text: Column, drop: Column) -> Column:
    """``text`` without the lines at the sorted positions ``drop``: the stretches between them."""
    both = F.struct(F.split(text, "\n", -1).alias("lines"), F.concat(F.array(F.lit(-1)), drop).alias("after"), F.concat(drop, F.array(F.size(F.split(text, "\n", -1)))).alias("until"))
    stretch = lambda x: F.transform(F.arrays_zip(x["after"].alias("a"), x["until"].alias("b")), lambda r: F.slice(x["lines"], r["a"] + 2, r["b"] - r["a"] - 1))
    return _let(both, lambda x: F.array_join(F.flatten(stretch(x)), "\n"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows packed whole, so no column can clash, with the identity that marks are joined back by."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_hash"))


def repeated_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_run: int = LONG_RUN_WORDS, modulus: int = MODULUS) -> DataFrame:
    """``(_id, _text_hash, kind, at, n, ps, words)``: chunks, pairs and long lines that a document with a smaller id also holds."""
    work = Workspace(docs.sparkSession, "line-chunks")
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    keyed = known.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_hash"), F.col(text_col).alias("_text"))
    hashed = keyed.select("_id", "_text_hash", F.explode(_chunks(F.col("_text"), long_run, modulus)).alias("c")).select("_id", "_text_hash", "c.*")
    hashed = work.save(hashed, "chunks")

    # saved before it is joined, so a hot key's rows can be dealt to several tasks
    kind = ["key", "n", "kind"]
    spread = work.save(hashed.groupBy(*kind).agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last").drop("last"), "spread")
    marked = hashed.join(spread, kind).groupBy("_id", "_text_hash").agg(F.collect_set(F.struct("at", "n", "kind", "key", "first")).alias("marks"))
    marked = work.save(marked, "marked")

    # only marked pieces carry their bytes from here on
    seen = keyed.join(marked, ["_id", "_text_hash"]).select("_id", "_text_hash", F.explode(_texts(F.col("_text"), F.col("marks"))).alias("x"))
    seen = work.save(seen.select("_id", "_text_hash", "x.ps", "x.m.*", "x.text"), "seen")
    originals = work.save(seen.where("_id = first").select(*kind, F.col("text").alias("original")).distinct(), "originals")
    work.keep("seen", "originals")
    again = seen.where("_id <> first").join(originals, kind).where("text = original")
    return again.select("_id", "_text_hash", "kind", "at", "n", "ps", _words(F.col("text")).alias("words"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_run: int = LONG_RUN_WORDS, modulus: int = MODULUS) -> DataFrame:
    """``(_id, _text_hash, _drop)``: per document the sorted positions of the lines to remove."""
    # rows that repeat both id and text say the same twice
    pieces = repeated_pieces(docs, id_col, text_col, long_run, modulus).groupBy("_id", "_text_hash", "kind", "at", "n").agg(F.first("ps").alias("ps"), F.first("words").alias("words"))
    line = Window.partitionBy("_id", "_text_hash").orderBy("kind", "at", "n")
    beside = lambda other, step: F.coalesce((other("kind").over(line) == _PAIR) & (other("at").over(line) == F.col("at") + step), F.lit(False))
    in_run = (F.col("words") > long_run) | beside(F.lag, -1) | beside(F.lead, 1)
    gone = pieces.withColumn("goes", (F.col("kind") != _PAIR) | in_run).where("goes")
    return gone.select("_id", "_text_hash", F.explode("ps").alias("p")).groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("p")).alias("_drop"))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_run: int = LONG_RUN_WORDS, modulus: int = MODULUS) -> DataFrame:
    """``docs`` with repeated chunks and runs cut out of the text, and ``removed_lines``.

    A chunk is a stretch of two non-blank lines or more between two boundaries, or
    between a boundary and an end of the text. A run is a stretch of lines of which each
    two neighbours are neighbours in a document with a smaller id; it counts if it has
    ``LEAST_RUN`` lines, or two with over ``long_run`` words. A single line counts as a run
    only with over ``long_run`` words. A line goes if it is in a chunk that also is one,
    byte for byte, in a document with a smaller id, or in a run that counts; the smallest
    id keeps it. Blank lines between two lines don't separate them. Repetition inside one
    document is left alone. Lines that stay keep their order and their blank lines.

    Null and empty texts, and rows whose id is null, come back as they are with 0
    removed lines; a text of which nothing stays is empty. Rows that repeat an id
    are versions of one document: they don't count against each other. Documents
    without repeated chunks keep their text byte for byte. All other columns come
    back unchanged, but for one named ``removed_lines``, which is replaced; an empty
    table gives an empty table.
    """
    drops = repeated_lines(docs, id_col, text_col, long_run, modulus)
    joined = _keyed(docs, id_col, text_col).join(drops, ["_id", "_text_hash"], "left")
    text = F.col("row")[text_col]
    cleaned = F.when(F.col("_drop").isNull(), text).otherwise(_without(text, F.col("_drop"))).alias(text_col)
    removed = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).alias("removed_lines")
    return joined.select(*[cleaned if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != "removed_lines"], removed)
