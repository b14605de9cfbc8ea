import hashlib
import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tenun.functions import text as T

CASES = [
    ("@akun MBG NGGAK bagus!!! #TolakMBG https://t.co/link", "MBG NGGAK bagus!!! #TolakMBG", "mbg nggak bagus!!! tolakmbg"),
    ("MBG https://t.co/link!!!", "MBG !!!", "mbg !!!"),
    ("MBG https://t.co/link?!", "MBG ?!", "mbg ?!"),
    ("MBG https://t.co/link:)", "MBG :)", "mbg :)"),
    ("MBG https://t.co/link😢", "MBG 😢", "mbg 😢"),
    ("MBG https://t.co/link!!!😢", "MBG !!!😢", "mbg !!!😢"),
    ("MBG‮ bagus\x00!", "MBG bagus !", "mbg bagus !"),
    ("MBG &amp; CKG &lt;3", "MBG & CKG <3", "mbg & ckg <3"),
    ("  @Warga MBG bagus! 😊 https://t.co/example #Sehat\n", "MBG bagus! 😊 #Sehat", "mbg bagus! 😊 sehat"),
    ("", "", ""),
    (None, None, None),
]
MATCHES = [
    ("#TolakMBG", "mbg", True), ("#tolakmbg", "mbg", True), ("#DukungCKG", "ckg", True), ("#CekKesehatanGratis", "cek kesehatan gratis", True), ("#MBGBagus", "mbg", True), ("MBG, ya", "mbg", True),
    ("#mbgossip", "mbg", False), ("#notmbg", "mbg", False), ("@mbg", "mbg", False), ("https://example.test/mbg", "mbg", False), ("sambg", "mbg", False), ("", "mbg", False),
]
ATOMS = ["MBG", " ", "\n", "@a_b", "#TagName", "#x", "https://t.co/a.", "www.", "www.a.b!", "!", ")", "’", "😊", "‍", "‮", "&amp;", "&amp;amp;", "&lt;", "ﬁ", "ß", "İ", "é", "é", "½", " ", "　", "rt ", "RT ", "_", "9", "\x07", "HTTP://X", "\U000e0041", "͸"]


def plain_prepare(t):
    t = unicodedata.normalize("NFKC", html.unescape(t))
    t = "".join(c if c in "‌‍" or 0xE0020 <= ord(c) <= 0xE007F or unicodedata.category(c)[0] != "C" else " " for c in t)
    link = re.compile("(?:https?://|www\\.)[^\\s☀-⟿\U0001f000-\U0001ffff]+", re.I)
    t = link.sub(lambda m: " " + m[0][len(m[0].rstrip(".,!?;:)]}\"'”’")) :], t)
    return " ".join(re.sub(r"(?<!\w)@\w+", " ", t).split())


def plain_key(t):
    t = re.sub(r"(?<!\w)#(\w+)", r"\1", plain_prepare(t)).casefold()
    return re.sub(r"^rt\s+", "", t).strip()


def column(spark, values, of):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", of(F.col("t")).alias("v"))
    return [r.v for r in rows.orderBy("k").collect()]


def test_golden(spark):
    given = [c[0] for c in CASES]
    assert column(spark, given, T.prepare_text) == [c[1] for c in CASES]
    assert column(spark, given, T.clean_text) == [c[2] for c in CASES]


def test_random_texts_equal_plain_python(spark):
    rng = random.Random(1)
    given = ["".join(rng.choices(ATOMS, k=rng.randrange(12))) for _ in range(3000)]
    for t, got, key in zip(given, column(spark, given, T.prepare_text), column(spark, given, T.duplicate_key)):
        assert (got, key) == (plain_prepare(t), plain_key(t)), repr(t)


@pytest.mark.parametrize("given, keyword, hit", MATCHES)
def test_keywords(spark, given, keyword, hit):
    assert column(spark, [given], lambda c: T.match_keyword(c, [keyword])) == [keyword if hit else None]


def test_first_keyword_in_order_wins(spark):
    assert column(spark, ["b and a", "A", None], lambda c: T.match_keyword(c, ["", "a", "b"])) == ["a", "a", None]
    assert column(spark, ["x"], lambda c: T.match_keyword(c, [])) == [None]
    assert column(spark, ["c++ (x)", "\\E.*"], lambda c: T.match_keyword(c, ["\\E.*", "c++"])) == ["c++", "\\E.*"]


def test_fingerprints(spark):
    a, b, c, d, e, f = column(spark, ["@a MBG bagus https://a.test", "@b mbg bagus https://b.test", "MBG tidak bagus", "!", "?", "RT MBG bagus"], T.text_fingerprint)
    assert a == b == f != c and d != e and a == hashlib.sha256(b"mbg bagus").hexdigest()


def test_codes(spark):
    assert column(spark, [" IN ", "id", "EN", None, "und"], T.language_code) == ["id", "id", "en", "", "und"]
    assert column(spark, ["True", "TRUE", "false", None, ""], T.is_true) == [True, True, False, False, False]
    assert column(spark, ["run"], T.execution_key) == [hashlib.sha256(b"run").hexdigest()[:24]]
    assert column(spark, ["　 ", " a "], T.optional) == [None, "a"]


def plain_match(text, keywords):
    """A pattern for each keyword, in order, over folded text without hashtags."""
    folded = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    for k in keywords:
        word = " ".join(unicodedata.normalize("NFKC", k).casefold().split())
        if word and re.search(r"(?<!\w)" + re.escape(word) + r"(?!\w)", folded):
            return k
    return None


def test_many_keywords_at_once(spark):
    rng = random.Random(9)
    part = lambda: rng.choice(["mbg", "makan", "gizi", "c++", "+1", "a", "ß", "é", "x_y", "2024", "(", "mb", "bg", "ﬁ"])
    keywords = [rng.choice([" ", "", "-", "  "]).join(part() for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["", "  "]
    texts = [rng.choice([" ", "", ", "]).join(part() for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    index = T.KeywordIndex(keywords)
    for t in texts:
        folded = " ".join(unicodedata.normalize("NFKC", t).casefold().split())
        assert index.first(folded, []) == plain_match(t, keywords), t
    many = [f"word{k} of many" for k in range(10_000)] + ["last one"]
    assert column(spark, ["it has word7777 of many", "the last one", "word1 of  MANY x", "#Last", "#DukungLastOne"], lambda c: T.match_keyword(c, many)) == ["word7777 of many", "last one", "word1 of many", None, "last one"]
