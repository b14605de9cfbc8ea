import random
import re

import pytest

from tenun.llm.license_rules import AFTER, BASE_PHRASES, BEFORE, Rule, all_rules, phrase_rule, signature_rules
from tenun.llm.license_scan import SURENESS, license_spans, plain_lower, scan_licenses, whole_words
from tests.llm.fixtures import edge_docs, edge_rows, no_docs, text

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spans_of(text, rules):
    """Plain loops: ``(start, finish, label, priority, base, kept)`` of every span."""
    words = words_of(text)
    spans = []
    for i, word in enumerate(words):
        for k, r in enumerate(rules):
            if r.keyword == word:
                around = "".join(w + " " for w in words[max(i - BEFORE, 0) : i]) + "@" + " ".join(words[i : i + AFTER]) + " "
                if m := re.search(whole_words(r.pattern), around):
                    start = i - m[1].split("@")[0].count(" ")
                    spans.append((start, start + m[1].count(" "), r.label, r.priority, r.base, k))

    def beaten(d):
        return any(e[0] <= d[0] and e[1] >= d[1] and e[3] >= d[3] and (e[1] - e[0] > d[1] - d[0] or e[3] > d[3] or e[5] < d[5]) for e in spans)

    return [(*d[:5], not beaten(d)) for d in spans]


def digest(text, rules):
    spans = spans_of(text, rules)
    base = [s[0] for s in spans if s[4]]
    listed = lambda found: ",".join(sorted(set(found)))
    return (
        len(words_of(text)), len(base), min(base, default=None), max(base, default=None), listed(s[2] for s in spans if s[4]),
        listed(s[2] for s in spans if s[4] or s[5]), max((SURENESS[s[3]] for s in spans if s[5]), default=0.0),
    )


def rows_of(df):
    return sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in df.collect()), key=repr)


SAYINGS = [
    "Licensed under CC BY-NC 4.0.", "CC BY", "cc-by\ncc by", "This work is licensed under the GNU General Public License, version 3", "General Public License", "All rights reserved.", "ALL RIGHTS  RESERVED!",
    "Released under the MIT License", "mit Lizenz", "Licensed under the Apache License, Version 2.0", "https://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "GPL-3.0-or-later",
    "GNU Lesser General Public License v2.1", "Redistributions of source code must retain the above copyright notice", "Copyright (c) 2024", "public domain", "released into the public domain", "Tous droits réservés",
    "licence", "open source licence", "Creative Commons", "all rights", "rights reserved", "copyright 19", "K", "CC0 1.0 Universal", "creativecommons.org/licenses/by-sa/4.0/",
]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice([*SAYINGS, text(rng, 3, 50)]) for _ in range(rng.randrange(1, 12)))) for i in range(300)]
    rules = all_rules()
    got = rows_of(scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    assert got == sorted(((i, digest(t, rules)) for i, t in docs), key=repr)


def test_spans(spark):
    docs = [(1, "x GNU General Public License version 3 of y"), (2, "nothing")]
    got = {(r.id, r.start, r.finish, r.label, r.kept) for r in license_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 2, 4, "gpl", False), (1, 1, 6, "gpl-3.0", True), (1, 1, 4, "gpl-any", False)}


def test_every_rule_can_find_something(spark):
    """Each expression compiles, holds its mark and its keyword, and gates on one word."""
    rules = all_rules()
    assert len(rules) > 250 and len({r.pattern for r in signature_rules()}) > 240
    for r in rules:
        assert re.fullmatch(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.keyword) and "@" in r.pattern and "," not in r.label and r.priority in SURENESS
        assert re.compile(whole_words(r.pattern))
        assert any(re.search(r"(?:^|[^a-z])" + re.escape(r.keyword) + r"(?:$|[^a-z])|" + re.escape(r.keyword[:5]), part) for part in r.pattern.split("@")[1:]), r


def test_priority_and_containment(spark):
    rules = [Rule("weak-long", 1, "b", "a @b c"), Rule("strong", 3, "b", "@b"), Rule("same", 3, "b", "@b"), Rule("mid", 2, "c", "b @c"), phrase_rule("b c", "base")]
    got = {(r.label, r.kept) for r in license_spans(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), rules).collect()}
    assert got == {("weak-long", True), ("strong", True), ("same", False), ("mid", True), ("base", False)}
    assert rows_of(scan_licenses(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), rules)) == [(1, (3, 1, 1, 1, "base", "base,mid,strong,weak-long", 1.0))]


def test_many_spans_in_one_text(spark):
    said = "cc by " * 30_000 + "all rights reserved"
    assert rows_of(scan_licenses(spark.createDataFrame([(1, said)], "doc_id long, text string"))) == [(1, (60_003, 30_001, 0, 60_000, "cc-by,reserved", "cc-by,reserved", 0.4))]


def test_only_ascii_is_lowered(spark):
    row = spark.createDataFrame([("AZ É \u212a İ",)], "t string").select(plain_lower("t")).first()
    assert row[0] == "az É \u212a İ"
    assert rows_of(scan_licenses(spark.createDataFrame([(1, "TOUS DROITS RÉSERVÉS tous droits réservés")], "doc_id long, text string")))[0][1][5] == "reserved"


def test_edge_cases(spark):
    rules = all_rules()
    assert rows_of(scan_licenses(edge_docs(spark))) == sorted(((i, digest(t, rules)) for i, t, *_ in edge_rows()), key=repr)
    assert scan_licenses(no_docs(spark)).count() == 0
    clash = spark.createDataFrame([(1, "cc by", "x", 1, "y", "z")], "doc_id long, text string, label string, row int, words string, keyword string")
    assert rows_of(scan_licenses(clash)) == [(1, (2, 1, 0, 0, "cc-by", "cc-by", 0.4))]
    assert [p for p, _ in BASE_PHRASES] == ["cc by", "general public license", "all rights reserved"]


def test_no_python_in_the_plan(spark):
    plan = scan_licenses(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("said, label", [("Apache License, Version 2.0", "apache-2.0"), ("under GPLv3", "gpl-3.0"), ("CC0", "cc0"), ("the Expat license", "mit"), ("© Alle Rechte vorbehalten", "reserved"), ("Mozilla Public License Version 2.0", "mpl-2.0")])
def test_labels(spark, said, label):
    assert label in rows_of(scan_licenses(spark.createDataFrame([(1, said)], "doc_id long, text string")))[0][1][5].split(",")
