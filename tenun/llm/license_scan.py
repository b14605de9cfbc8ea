"""License statements in texts by ordered signatures, in DataFrame functions only.

A text is cut into words. Wherever one of the rules' keywords stands, the words around it
are written out, and only the rules of that keyword are tried there. What they find
are spans of words. A span goes if another one of the same or a higher priority
contains it (of equal spans the earlier rule stays), which a running maximum over the
text's spans in order of their starts decides, however many there are.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenun.llm.license_rules import AFTER, BEFORE, Rule, all_rules

#: Words of digits, letters and whatever isn't ASCII; ``LOWER_WORD`` is for texts whose A to Z are in lower case already.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PRIORITIES = (1, 2, 3)
#: How sure a span of each priority makes that a text is under some license or reservation.
SURENESS = {1: 0.4, 2: 0.7, 3: 1.0}
RULE_SCHEMA = "_rule int, _label string, _priority int, _keyword string, _pattern string, _base boolean"


def plain_lower(text: Column) -> Column:
    """A to Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_words(pattern: str) -> str:
    """The expression between blanks, its words as group 1."""
    return f"(?:^| )({pattern}) "


def _surroundings(words: Column, at: Column) -> Column:
    """The words around one, a mark before it, each followed by a blank."""
    before = F.slice(words, F.greatest(at - BEFORE, F.lit(0)) + 1, F.least(at, F.lit(BEFORE)))
    lead = F.when(at > 0, F.concat(F.array_join(before, " "), F.lit(" "))).otherwise("")
    return plain_lower(F.concat(lead, F.lit("@"), F.array_join(F.slice(words, at + 1, AFTER), " "), F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def license_spans(docs: DataFrame, rules: Iterable[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n_words, start, finish, label, priority, base, kept)``: every span, first and last word from 0.

    ``row`` tells apart documents with equal or null ids. ``kept`` is false where another
    span suppresses this one. Null and empty texts have no spans. The rules are broadcast:
    they are the caller's, some hundreds, and don't grow with the documents.
    """
    return _spans(docs, rules, id_col, text_col).where("label is not null")


def _spans(docs: DataFrame, rules: Iterable[Rule] | None, id_col: str, text_col: str) -> DataFrame:
    """The spans, and for every document at least one row, maybe without a label."""
    found = list(all_rules() if rules is None else rules)
    keywords = sorted({r.keyword for r in found})
    table = docs.sparkSession.createDataFrame([(k, r.label, r.priority, r.keyword, whole_words(r.pattern), r.base) for k, r in enumerate(found)], RULE_SCHEMA)

    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("words"), F.size(words).cast("long").alias("n_words"))
    everywhere = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))
    # full lower case finds no less than A to Z in lower case does; the expressions then decide
    gated = F.filter(everywhere, lambda i: F.lower(F.get("words", i)).isin(keywords))
    around = F.transform(gated, lambda i: F.struct(i.alias("at"), plain_lower(F.get("words", i)).alias("_keyword"), _surroundings(F.col("words"), i).alias("window")))
    spread = cut.select("row", "id", "n_words", F.posexplode_outer(around).alias("place", "c")).select("row", "id", "n_words", "place", "c.*")

    text = F.call_function("regexp_extract", "window", "_pattern", F.lit(1))
    tried = spread.join(F.broadcast(table), "_keyword", "left").withColumn("text", F.nullif(text, F.lit("")))
    # a row is left of every document, with a span or without
    tried = tried.where("text is not null or coalesce(place, 0) = 0")
    start = F.col("at") - _blanks(F.substring_index("text", "@", 1))
    spans = tried.select("row", "id", "n_words", "_rule", start.cast("long").alias("start"), (start + _blanks(F.col("text"))).cast("long").alias("finish"), F.when(F.col("text").isNotNull(), F.col("_label")).alias("label"), F.col("_priority").alias("priority"), F.col("_base").alias("base"))

    earlier = Window.partitionBy("row").orderBy("start", F.desc("finish"), F.desc("priority"), "_rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") >= p, F.col("finish"))).over(earlier) for p in PRIORITIES]
    held = F.element_at(F.array(*reach), F.col("priority"))
    return spans.withColumn("kept", F.when(F.col("label").isNotNull(), F.coalesce(held < F.col("finish"), F.lit(True)))).drop("_rule")


def scan_licenses(docs: DataFrame, rules: Iterable[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row for every row of ``docs``.

    ``n_base`` counts the places of base rules, ``first_word`` and ``last_word`` are the
    least and greatest of their starts; ``labels`` are those of all kept spans and of all
    base ones; both lists are distinct, in order of code points, joined by commas. ``score``
    is the sureness of the strongest kept span, 0 without any. Null and empty texts have no words.
    """
    base, kept = F.col("base") & F.col("label").isNotNull(), F.col("kept")
    listed = lambda where: F.array_join(F.array_sort(F.collect_set(F.when(where, F.col("label")))), ",")
    sure = F.max(F.when(kept, F.element_at(F.create_map(*[F.lit(x) for kv in SURENESS.items() for x in kv]), F.col("priority"))))
    found = _spans(docs, rules, id_col, text_col).groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(base | kept).alias("labels"), F.coalesce(sure, F.lit(0.0)).alias("score"),
    )
    return found.drop("row").withColumnRenamed("id", id_col)
