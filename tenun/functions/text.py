"""Text preparation that keeps what carries sentiment, as column functions.

Built-in expressions do the pattern work. Three things have no built-in (HTML
entities, NFKC and case folding), and run in Arrow batches; columns that need
both are arranged so that a text crosses to Python as few times as possible.

Word characters are written ``[\\p{L}\\p{N}_]``: that is what they are here,
while Java's own word class differs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Results must agree on them.
HASHTAG_PREFIXES = ("tolak", "dukung", "stop", "evaluasi", "anti", "pro", "kontra")
JOINERS = (0x200C, 0x200D)
EMOJI_TAGS = range(0xE0020, 0xE0080)
URL_END_MARKS = r".,!?;:)\]}\"'\x{201d}\x{2019}"
URL_STOPS = r"\s\x{2600}-\x{27ff}\x{1f000}-\x{1ffff}"
# End of the fixed values.

WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
_URL = rf"(?iU)(?:www(?=\.[{URL_END_MARKS}]+(?:[{URL_STOPS}]|\z))|(?:https?://|www\.)(?=[^{URL_STOPS}])[^{URL_STOPS}]*?)([{URL_END_MARKS}]*)(?=[{URL_STOPS}]|\z)"
_CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
_HASHTAG = rf"{NOT_AFTER_WORD}#({WORD}+)"
_WORDS = re.compile(r"\w+")


class _Controls(dict):
    """Translation of code points: controls, formats and unassigned ones are blanks."""

    def __missing__(self, point: int) -> int:
        kept = point in JOINERS or point in EMOJI_TAGS or unicodedata.category(chr(point))[0] != "C"
        self[point] = point if kept else 0x20
        return self[point]


_CONTROLS = _Controls()


def _unify(text: str | None) -> str | None:
    if text is None:
        return None
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text if text.isprintable() else text.translate(_CONTROLS)


@F.pandas_udf(StringType())
def unify(texts: pd.Series) -> pd.Series:
    """Entities resolved, compatibility forms unified, control characters blanked."""
    return texts.map(_unify)


@F.pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def strip(text: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def optional(text: Column) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(strip(F.coalesce(text, F.lit(""))), F.lit(""))


def _tidy(unified: Column) -> Column:
    linkless = F.regexp_replace(unified, _URL, " $1")
    return strip(collapse(F.regexp_replace(linkless, rf"{NOT_AFTER_WORD}@{WORD}+", " ")))


def prepare_text(text: Column) -> Column:
    """Links and mentions removed, white space collapsed; case, hashtags, emoji and punctuation kept."""
    return _tidy(unify(text))


def clean_text(text: Column) -> Column:
    """The prepared text case-folded, hashtags as plain words."""
    return casefold(F.regexp_replace(prepare_text(text), _HASHTAG, "$1"))


def duplicate_key(text: Column) -> Column:
    """The cleaned text without a leading repost mark; equal keys are equal posts."""
    return strip(F.regexp_replace(clean_text(text), r"(?U)^rt\s+", ""))


def key_fingerprint(key: Column) -> Column:
    return F.sha2(key, 256)


def text_fingerprint(text: Column) -> Column:
    return key_fingerprint(duplicate_key(text))


def review_hash(text: Column) -> Column:
    """Hash of the text itself, as reviews cite it."""
    return F.sha2(text, 256)


def execution_key(run_id: Column) -> Column:
    return F.substring(F.sha2(run_id, 256), 1, 24)


def language_code(lang: Column) -> Column:
    """Stripped lower-case code, ``in`` being an old code of ``id``; null is empty."""
    code = F.lower(strip(F.coalesce(lang, F.lit(""))))
    return F.when(code == "in", "id").otherwise(code)


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(text.cast("string")) == "true", F.lit(False))


def fold_keyword(keyword: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", keyword).casefold().split())


class KeywordIndex:
    """Keywords by the word they begin with: a text's words are looked up once, however many keywords there are."""

    def __init__(self, keywords: Sequence[str]):
        self.names = list(keywords)
        self.words: dict[str, list[tuple[int, str]]] = {}
        self.marks: list[tuple[int, str]] = []
        self.tags: dict[str, int] = {}
        for k, folded in enumerate(map(fold_keyword, keywords)):
            if not folded:
                continue
            if begin := _WORDS.match(folded):
                self.words.setdefault(begin[0], []).append((k, folded))
            else:
                self.marks.append((k, folded))
            for prefix in ("", *HASHTAG_PREFIXES):
                self.tags.setdefault(prefix + folded.replace(" ", ""), k)

    def first(self, plain: str, tags: Sequence[str]) -> str | None:
        """The first keyword that stands alone in ``plain`` or that a whole tag spells."""
        none = best = len(self.names)
        best = min((self.tags[t] for t in tags if t in self.tags), default=best)
        for found in _WORDS.finditer(plain) if self.words else ():
            for k, keyword in self.words.get(found[0], ()):
                if k < best and plain.startswith(keyword, found.start()) and not _is_word(plain, found.start() + len(keyword)):
                    best = k
        for k, keyword in self.marks:
            at = plain.find(keyword) if k < best else -1
            while at >= 0 and (_is_word(plain, at - 1) or _is_word(plain, at + len(keyword))):
                at = plain.find(keyword, at + 1)
            best = k if at >= 0 else best
        return None if best == none else self.names[best]


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def match_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first of ``keywords`` that ``text`` names, else null.

    A keyword is named by its words standing alone, also as parts of a hashtag in
    camel case, or by a whole hashtag that is the keyword without blanks, with or
    without one of the fixed prefixes. Parts of longer words don't count.
    """
    index = KeywordIndex(keywords)
    if not index.tags:
        return F.lit(None).cast("string")

    def marked(prepared: Column) -> Column:
        """The text with hashtags taken apart, and after a mark the hashtags as they are: one string crosses to Python."""
        spread = F.regexp_replace(prepared, _HASHTAG, " \u0001$1\u0001 ")
        pieces = F.transform(F.split(spread, "\u0001"), lambda part, i: F.when(i % 2 == 1, F.regexp_replace(part, _CAMEL, " ")).otherwise(part))
        tags = F.array_join(F.regexp_extract_all(prepared, F.lit(_HASHTAG), F.lit(1)), " ")
        return F.concat(F.array_join(pieces, ""), F.lit("\u0002"), tags)

    def named(given: str | None) -> str | None:
        if given is None:
            return None
        plain, _, tags = unicodedata.normalize("NFKC", given).casefold().partition("\u0002")
        return index.first(" ".join(plain.split()), tags.split())

    @F.pandas_udf(StringType())
    def matched(texts: pd.Series) -> pd.Series:
        return texts.map(named)

    return matched(_let(prepare_text(text), marked))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
