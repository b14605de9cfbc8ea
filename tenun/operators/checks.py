"""Data contracts checked in one pass: every rule is a counter of violations."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenun.functions import moments
from tenun.functions.text import is_true, strip

SOURCE_COLUMNS = ("conversation_id_str", "created_at", "favorite_count", "full_text", "id_str", "lang", "quote_count", "reply_count", "retweet_count", "tweet_url")
COUNT_COLUMNS = {"reply_count": "reply_count", "retweet_count": "retweet_count", "favorite_count": "like_count", "quote_count": "quote_count"}
TRAINING_COLUMNS = ("tweet_id", "conversation_id", "split_group_id", "target_program", "model_text", "sentiment_label", "annotation_source", "human_reviewed", "approved_for_training", "ai_training_candidate", "quality_status", "relevance_review")
LABELS = ("negative", "neutral", "positive")
PSEUDO_LABEL = "local_transformer_pseudo_label"


class ContractError(ValueError):
    """Data that must not be processed further."""


@dataclass(frozen=True)
class Rule:
    """A name and the condition of a row that breaks the rule."""

    name: str
    broken: Column


def require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ContractError(f"missing columns: {', '.join(missing)}")


def violations(df: DataFrame, rules: list[Rule], id_col: str | None = None, examples: int = 10) -> DataFrame:
    """``(rule, rows, examples)``: how many rows break each rule and, with ``id_col``, the smallest such ids.

    One aggregation over one scan. Only a bounded number of ids is kept: the first
    few of each task's partial result.
    """
    counters = [F.sum(F.coalesce(r.broken.cast("long"), F.lit(1))).alias(f"n{k}") for k, r in enumerate(rules)]
    if id_col:
        counters += [F.min(F.when(F.coalesce(r.broken, F.lit(True)), F.col(id_col).cast("string"))).alias(f"e{k}") for k, r in enumerate(rules)]
    row = df.agg(F.count("*").alias("total"), *counters)
    parts = [F.struct(F.lit(r.name).alias("rule"), F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("rows"), (F.col(f"e{k}") if id_col else F.lit(None).cast("string")).alias("example")) for k, r in enumerate(rules)]
    return row.select("total", F.explode(F.array(*parts)).alias("r")).select("r.rule", "r.rows", "r.example", "total")


def enforce(df: DataFrame, rules: list[Rule], id_col: str | None = None, allow_empty: bool = False) -> int:
    """The number of rows, if there are any and none breaks a rule; else an error that names the rules."""
    found = violations(df, rules, id_col).collect()
    total = found[0]["total"] if found else df.count()
    if not total and not allow_empty:
        raise ContractError("there are no rows")
    if broken := [r for r in found if r["rows"]]:
        raise ContractError("; ".join(f"{r['rule']}: {r['rows']} rows" + (f", such as {r['example']}" if r["example"] else "") for r in broken))
    return total


def blank(column: Column) -> Column:
    return strip(F.coalesce(column, F.lit(""))) == ""


def source_rules() -> list[Rule]:
    """What raw posts must hold before they are prepared."""
    counts = [Rule(f"{c} is no whole number of 0 or more", moments.count_value(F.col(c)).isNull()) for c in COUNT_COLUMNS]
    return [
        Rule("full_text is blank", blank(F.col("full_text"))),
        Rule("full_text has a replacement character", F.coalesce(F.contains("full_text", F.lit("�")), F.lit(False))),
        Rule("id_str is blank", blank(F.col("id_str"))),
        Rule("created_at is no time stamp", moments.parse_published(F.col("created_at")).isNull()),
        *counts,
    ]


def collection_rules(start: date, end: date) -> list[Rule]:
    """What a collected file must hold: ids, texts, and time stamps inside the local window."""
    published = moments.parse_published(F.col("created_at"))
    inside = moments.in_window(published, F.lit(start), F.lit(end))
    return [
        Rule("id or text is blank", blank(F.col("id_str")) | blank(F.col("full_text"))),
        Rule("created_at is no time stamp", published.isNull()),
        Rule("outside the requested window", F.coalesce(~inside, F.lit(False))),
    ]


def validate_collection(posts: DataFrame, start: date, end: date, limit: int) -> dict:
    """Accept a collected file whole or reject it whole; returns its summary."""
    if type(limit) is not int or limit < 1:
        raise ContractError("the limit must be a positive whole number")
    require_columns(posts, ("id_str", "full_text", "created_at"))
    total = enforce(posts, collection_rules(start, end), "id_str")
    if total > limit:
        raise ContractError(f"{total} rows exceed the limit of {limit}")
    published = moments.parse_published(F.col("created_at"))
    low, high = moments.window_bounds(F.lit(start), F.lit(end))
    shown = [moments.iso_utc(c) for c in (F.min(published), F.max(published), F.min(low), F.min(high))]
    first, last, lower, upper = posts.agg(*shown).first()
    return {"status": "passed", "validation_version": 1, "timezone": moments.LOCAL_ZONE, "rows": total, "outside_window_rows": 0, "requested_limit": limit, "start_inclusive_utc": lower, "end_exclusive_utc": upper, "published_at_min": first, "published_at_max": last}


def select_posts(posts: DataFrame, start: date, end: date, remaining: int, seen: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """The first ``remaining`` posts of the window, by ``order``: of equal ids the first, and none of ``seen``.

    Posts without an id are all kept.
    """
    inside = posts.where(moments.in_window(moments.parse_published(F.col("created_at")), F.lit(start), F.lit(end)))
    named = ~blank(F.col("id_str"))
    firsts = inside.where(named).groupBy("id_str").agg(F.min(order).alias(order))
    kept = inside.where(named).join(firsts, ["id_str", order], "left_semi")
    if seen is not None:
        kept = kept.join(seen.select("id_str"), "id_str", "left_anti")
    return kept.select(*posts.columns).unionByName(inside.where(~named)).orderBy(order).limit(max(0, remaining))


def training_rules(columns: list[str], allow_provisional: bool) -> list[Rule]:
    """What labelled rows must hold before anything is trained on them."""
    approved = is_true(F.col("human_reviewed")) & is_true(F.col("approved_for_training"))
    provisional = (F.col("annotation_source") == "ai") & is_true(F.col("ai_training_candidate"))
    rules = [
        Rule("label is unknown", ~F.col("sentiment_label").isin(*LABELS)),
        Rule("text is blank", blank(F.col("model_text"))),
        Rule("an identity field is empty", F.greatest(*[(F.coalesce(F.col(c), F.lit("")) == "").cast("int") for c in ("tweet_id", "target_program", "split_group_id")]) == 1),
        Rule("preprocessing flags are unresolved", F.col("quality_status") != "accepted"),
        Rule("the target is not relevant", F.col("relevance_review") != "relevant"),
        Rule("the label is not approved", ~(approved | provisional) if allow_provisional else ~approved),
    ]
    if "annotation_method" in columns:
        rules.append(Rule("an unreviewed teacher proposal", F.coalesce(provisional & (F.col("annotation_method") == PSEUDO_LABEL), F.lit(False))))
    return rules


def validate_training(rows: DataFrame, allow_provisional: bool = False) -> None:
    """Training data of exactly the three labels, with unique keys and approved rows only."""
    require_columns(rows, TRAINING_COLUMNS)
    enforce(rows, training_rules(rows.columns, allow_provisional), "tweet_id")
    if rows.select("sentiment_label").distinct().count() != len(LABELS):
        raise ContractError("not all labels are present")
    unique_keys(rows, ("target_program", "tweet_id"))


def repeated_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def unique_keys(df: DataFrame, keys: tuple[str, ...]) -> None:
    if not repeated_keys(df, keys).isEmpty():
        raise ContractError(f"repeated keys: {', '.join(keys)}")
