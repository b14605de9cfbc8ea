import random
from collections import Counter

import numpy as np

from tenun.llm.language import Profiles, _code_points, _grams, identify_languages, learn_profiles, ranked, ranked_of
from tests.llm.fixtures import edge_docs, no_docs

SOUNDS = {"aa": "ka ta na ma la", "bb": "str zwo ich pfe aus", "cc": "eau oui ère que ment"}


def sample(rng, lang, n=40):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def plain_grams(text):
    import re

    t = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n] != " "]


def packed(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_grams_equal_plain_ones():
    for t in ("Ab, c1d!", "é", "größe  ÑANDÚ x", "a" * 9):
        assert Counter(_grams(_code_points(t), (1, 2, 3)).tolist()) == Counter(packed(g) for g in plain_grams(t))


def test_rank_order_with_ties():
    counts = Counter(packed(g) for g in plain_grams("abab cab"))
    want = sorted(counts, key=lambda g: (-counts[g], g))
    got = ranked(_grams(_code_points("abab cab"), (1, 2, 3)), 5).tolist()
    assert got == want[:5]


def test_distance_is_out_of_place():
    profiles = {"x": [packed(g) for g in ("a", "b", "ab")], "y": [packed("z")]}
    found = Profiles(profiles, 3)
    own = [packed(g) for g in [" a"] and plain_grams("ab")]
    order = ranked(np.array(own, np.uint64), 3).tolist()
    want = [sum(abs(p.index(g) - k) if g in p else 3 for k, g in enumerate(order)) / (len(order) * 3) for p in profiles.values()]
    assert np.allclose(found.distances("ab"), want)


def test_profiles_count_all_rows_and_predict(spark):
    rng = random.Random(6)
    rows = [(k, sample(rng, lang), lang) for k, lang in enumerate(["aa", "aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = learn_profiles(docs.where("doc_id < 160"))
    assert learned.names == ["aa", "bb", "cc"]
    for lang in learned.names:
        counts = Counter(packed(g) for k, t, x in rows if k < 160 and x == lang for g in plain_grams(t))
        top = sorted(counts, key=lambda g: (-counts[g], g))[: learned.size]
        have = {int(g): int(r) for g, r in zip(learned.grams, learned.ranks[learned.names.index(lang)]) if r >= 0}
        assert have == {g: k for k, g in enumerate(top)}
    got = {r.doc_id: r for r in identify_languages(docs, learned).collect()}
    assert all(got[k].lang_pred == x and 0 <= got[k].score <= 1 for k, _, x in rows if k >= 160)


def test_only_letters_are_letters():
    found = Profiles({"x": [packed(g) for g in ("a", "b")], "y": [packed("z")]}, 3)
    for t in ("\u00bd \u00b2 \u2460", "123 _", "!?", "", None):
        assert found.identify(t) == ("und", 0.0)
    assert found.identify("\u00bd a")[0] == "x"
    same = Profiles({"x": [packed("a")], "y": [packed("a")]}, 1)
    assert same.identify("a") == ("x", 0.0)


def test_predictions_equal_plain_loops(spark):
    rng = random.Random(16)
    rows = [(k, sample(rng, lang, rng.choice([1, 3, 40])), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 50
    profiles = {}
    for lang in ("aa", "bb", "cc"):
        counts = Counter(packed(g) for k, t, x in rows if k < 60 and x == lang for g in plain_grams(t))
        profiles[lang] = sorted(counts, key=lambda g: (-counts[g], g))[:size]
    got = {r.doc_id: r for r in identify_languages(docs, learn_profiles(docs.where("doc_id < 60"), size=size)).collect()}
    for k, t, _ in rows:
        counts = Counter(packed(g) for g in plain_grams(t))
        own = sorted(counts, key=lambda g: (-counts[g], g))[:size]
        far = {x: sum(min(abs(p.index(g) - i), size) if g in p else size for i, g in enumerate(own)) / (len(own) * size) for x, p in profiles.items()}
        near = sorted(far, key=lambda x: (far[x], x))
        assert got[k].lang_pred == near[0] and abs(got[k].score - (1 - far[near[0]] / far[near[1]])) < 1e-9


def test_edges(spark):
    docs = edge_docs(spark)
    learned = learn_profiles(docs)
    rows = identify_languages(docs, learned).collect()
    assert len(rows) == docs.count()
    for r, t in zip(sorted(rows, key=lambda r: (r.doc_id or 0)), sorted(docs.collect(), key=lambda r: (r.doc_id or 0))):
        assert r.lang_pred == ("en" if t.text and any(c.isalpha() for c in t.text) else "und") and 0 <= r.score <= 1
    assert identify_languages(no_docs(spark), learned).count() == 0
    nothing = learn_profiles(no_docs(spark))
    assert {(r.lang_pred, r.score) for r in identify_languages(docs, nothing).collect()} == {("und", 0.0)}


def test_counting_in_bins_ranks_as_sorting_does():
    rng = random.Random(12)
    texts = [sample(rng, lang, n) for lang in SOUNDS for n in (1, 40, 900)] + ["a", "ab " * 700, "größe 12 " * 60, "中文 " * 400, "\U00010400b" * 300, " 1 "]
    for t in texts:
        for orders in ((1, 2, 3), (2,), (1, 3)):
            for most in (3, 400):
                assert ranked_of(_code_points(t), orders, most).tolist() == ranked(_grams(_code_points(t), orders), most).tolist()
