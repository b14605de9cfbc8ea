"""TF-IDF blocks as relational plans, and as vectors for MLlib.

A block's weights are ``(1 + ln count) (ln((1 + n) / (1 + df)) + 1)``, each row
scaled to length one. The vocabulary is the most frequent terms of the training
rows; equal frequencies are ordered by term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenun.sources.shared import Workspace

# Results must agree on them.
WORDS, CHARACTERS = 10_000, 20_000
CHARACTER_ORDERS = (3, 4, 5)
MODES = ("word_program", "word_char", "word_char_program")
# End of the fixed values.


def word_tokens(text: Column, marks: bool = False) -> Column:
    """Lower-cased words of two or more letters; with ``marks`` all words, and single other characters."""
    pattern = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]" if marks else r"[\p{L}\p{N}_]{2,}"
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?U){pattern}"), F.lit(0))


def ngrams(tokens: Column, most: int) -> Column:
    """All runs of one to ``most`` tokens, joined by blanks."""
    out = tokens
    for n in range(2, most + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        out = F.concat(out, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")))  # noqa: B023
    return out


def word_grams(word: Column, orders: tuple[int, ...] = CHARACTER_ORDERS) -> Column:
    """Runs of characters inside a word, padded with a blank on both sides.

    A padded word shorter than the shortest run counts once, as it is.
    """
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    size = F.length(padded)
    empty = F.array().cast("array<string>")
    runs = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(empty) for n in orders]  # noqa: B023
    return F.concat(*runs, F.when(size < min(orders), F.array(padded)).otherwise(empty))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), " "), lambda w: w != "")


def character_grams(text: Column, orders: tuple[int, ...] = CHARACTER_ORDERS) -> Column:
    """The runs of all words of a text, one after the other."""
    return F.flatten(F.transform(_words(text), lambda w: word_grams(w, orders)))


def term_counts(rows: DataFrame, row_id: str, terms: Column) -> DataFrame:
    """``(row, term, n)``: how often each row has each of its terms."""
    return rows.select(F.col(row_id).alias("row"), F.explode(terms).alias("term")).groupBy("row", "term").agg(F.count("*").alias("n"))


def character_counts(rows: DataFrame, row_id: str, text: Column, orders: tuple[int, ...] = CHARACTER_ORDERS) -> DataFrame:
    """``term_counts`` of the characters' runs: a row's words are counted first, so each of them is cut once."""
    words = term_counts(rows, row_id, _words(text))
    return words.select("row", "n", F.explode(word_grams(F.col("term"), orders)).alias("term")).groupBy("row", "term").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame, docs: Column, most: int) -> DataFrame:
    """``(term, place, idf)``: the most frequent terms, numbered from 0; at most ``most`` rows.

    ``counts`` are those of the rows to learn from, ``docs`` is how many rows these are, a column or a literal.
    """
    known = counts.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("total"), "term")) - 1
    return known.select("term", place.alias("place"), (F.log((docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def number_programs(rows: DataFrame, program: str = "target_program") -> DataFrame:
    """``(program, place)``: the programs, of which there are as many as are configured, the most frequent first."""
    place = F.row_number().over(Window.orderBy(F.desc("n"), program)) - 1
    return rows.groupBy(program).agg(F.count("*").alias("n")).select(program, place.alias("place"))


def weigh(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(row, term, place, raw)``: weights of known terms before rows are scaled."""
    return counts.join(F.broadcast(vocabulary), "term").select("row", "term", "place", ((F.log("n") + 1) * F.col("idf")).alias("raw"))


def scaled(weighted: DataFrame, row_id: str) -> DataFrame:
    """``(row_id, term, weight)``: each row's weights as a vector of length one."""
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("row")))
    return weighted.select(F.col("row").alias(row_id), "term", (F.col("raw") / norm).alias("weight"))


_PARTS_OF_TERMS = 8


def _at_home(rows: DataFrame, row_id: str) -> DataFrame:
    """``rows`` with all of a row's parts in one partition: what is counted and scaled by row needs no exchange of its terms."""
    # a partition's terms are many times its texts: they should fit in memory
    parts = _PARTS_OF_TERMS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.col(row_id))


def _tfidf_of(counted: Callable[[DataFrame], DataFrame], rows: DataFrame, row_id: str, most: int, train: Column | None) -> DataFrame:
    """Terms are counted twice, for the vocabulary and for the weights: a table of counts would be many times as large as the texts."""
    learned = rows if train is None else rows.where(train)
    known = rows if train is None else rows.join(learned.select(row_id).distinct(), row_id, "left_semi")
    work = Workspace(rows.sparkSession, "tfidf")
    vocabulary = work.save(learn_vocabulary(counted(_at_home(known, row_id)), F.lit(learned.count()), most), "vocabulary", 1)
    return scaled(weigh(counted(_at_home(rows, row_id)), vocabulary), row_id)


def tfidf(rows: DataFrame, row_id: str, terms: Column, most: int = WORDS, train: Column | None = None) -> DataFrame:
    """``(row_id, term, weight)``, sparse: rows without a known term have no entry.

    ``train`` says which rows give vocabulary and frequencies (all by default).
    Only texts and the terms' totals are exchanged; the vocabulary is bounded by ``most``.
    """
    return _tfidf_of(lambda part: term_counts(part, row_id, terms), rows, row_id, most, train)


def character_tfidf(rows: DataFrame, row_id: str, text: Column, most: int = CHARACTERS, train: Column | None = None) -> DataFrame:
    """``tfidf`` over the runs of characters inside words."""
    return _tfidf_of(lambda part: character_counts(part, row_id, text), rows, row_id, most, train)


def vector_cells(ids: DataFrame, blocks: list[tuple[DataFrame, int]]) -> DataFrame:
    """``(row, features)`` for every row of ``ids``: blocks of ``(row, place, raw)`` weights side by side, as the struct a sparse vector is stored as.

    Each block is as wide as its size says, and every row's part of it scaled to length one.
    """
    nothing = F.lit(None).cast("int")
    cells, base = ids.select("row", nothing.alias("block"), nothing.alias("place"), F.lit(None).cast("double").alias("raw")), 0
    for k, (weighted, size) in enumerate(blocks):
        cells = cells.unionByName(weighted.select("row", F.lit(k).alias("block"), (F.col("place") + base).cast("int").alias("place"), F.col("raw").cast("double").alias("raw")))
        base += size
    norms = F.array(*[F.sqrt(F.sum(F.when(F.col("block") == k, F.col("raw") * F.col("raw")))) for k in range(len(blocks))])
    rows = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "block", "raw")))).alias("cells"), norms.alias("norms"))
    values = F.transform("cells", lambda c: c["raw"] / F.get("norms", c["block"]))
    return rows.select("row", F.struct(F.lit(0).cast("byte").alias("type"), F.lit(base).alias("size"), F.transform("cells", lambda c: c["place"]).alias("indices"), values.alias("values")).alias("features"))


def sparse_vectors(ids: DataFrame, blocks: list[tuple[DataFrame, int]], work: Workspace, name: str) -> DataFrame:
    """``vector_cells`` put together by column functions, written, and read back as vectors."""
    cells = vector_cells(ids, blocks)
    work.save(cells, name)
    kind = T.StructType([cells.schema["row"], T.StructField("features", VectorUDT())])
    return ids.sparkSession.read.schema(kind).parquet(f"{work.path}/{name}")


def class_weights(rows: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """``(label, rows, weight)``: balanced weights ``n / (classes * n_class)``."""
    counts = rows.groupBy(label).agg(F.count("*").alias("rows"))
    every = Window.partitionBy()
    return counts.withColumn("weight", F.sum("rows").over(every) / (F.count("*").over(every) * F.col("rows")))
