"""Small tables with every awkward case, and word material."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, label int, row string, class_id long"


def words(rng: random.Random, n: int, kinds: int = 4000) -> list[str]:
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def text(rng: random.Random, n: int, kinds: int = 4000, per_line: int = 12) -> str:
    given = words(rng, n, kinds)
    return "\n".join(" ".join(given[i : i + per_line]) for i in range(0, n, per_line))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "k", 0.5, 1, "r", 3)


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(5)
    long_text = text(rng, 60_000)
    same = text(rng, 60)
    return [
        row(1, None, None, None), row(2, ""), row(3, "   \n\t\n"), row(4, "!!! ??? 123"), row(5, long_text), row(6, long_text), row(7, same), row(7, same), row(8, same),
        row(None, "a text without an id"), row(None, None), row(9, "one"), row(10, "é" * 5000), row(11, "a\n\nb\n\nc"), row(12, "x" * 300_000), row(13, "emoji 😀 und größe ñandú"),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
