import random

from tenun.llm.queries import ALLOWED, BLOCKED
from tenun.llm.url_filter import Bloom, Cascade, _candidates, _hashes, build_cascade, judge_urls
from tenun.sources.shared import Workspace


def brute(url, block, allow):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, rules in (("block", block), ("allow", allow)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def urls(rng, n):
    hosts = ["example.com", "EXAMPLE.com", "www.example.net", "m.a.b.org", "com", "net", "notcom", "example.com.", "x.io", "ex\u00c9.com", "a..com"]
    paths = ["", "/", "/en/7", "/en/71/x", "/en/", "/en", "/de/8", "/de/8?x=/en/", "/es/#/en/", "?a=://", "#x", "/EN/7", "/en/7?u=http://b.net/de/"]
    return [rng.choice(["http://", "https://", "", "://", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(n)]


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [*enumerate(urls(rng, 600)), (700, None), (701, ""), (701, ""), (None, "http://example.com/en/7"), (702, "http://" + "a." * 3000 + "com/en/" + "x" * 50_000)]
    given = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in rows], "page_id long, url string, host string, path string, rule string")
    got = sorted((tuple(r) for r in judge_urls(given, BLOCKED, ALLOWED).collect()), key=str)
    assert got == sorted(((i, *brute(u, BLOCKED, ALLOWED)) for i, u in rows), key=str)
    assert judge_urls(given.limit(0), BLOCKED, ALLOWED).count() == 0
    assert {r.verdict for r in judge_urls(given, [], []).collect()} == {"allow"}


def test_cascade_is_exact_over_the_universe(spark):
    rng = random.Random(5)
    universe = [f"{rng.randrange(10**9)}.example/{k}" for k in range(30_000)]
    listed = universe[:700] + [f"absent{k}" for k in range(50)]
    table = spark.createDataFrame([(universe[k : k + 20],) for k in range(0, len(universe), 20)], "keys array<string>")
    cascade = build_cascade(listed, table, Workspace(spark, "cascade"), "t")
    assert len(cascade.levels) > 2
    assert cascade.has(universe).tolist() == [True] * 700 + [False] * (len(universe) - 700)
    assert all(cascade.has(listed)) and not Cascade().has(["x"]).any()


def test_bloom_has_no_false_negatives():
    keys = [f"k{k}" for k in range(5000)]
    level = Bloom(5000, 0.01, 3)
    level.add(_hashes(keys))
    assert level.has(_hashes(keys)).all() and level.has(_hashes([f"z{k}" for k in range(5000)])).mean() < 0.03


def test_candidates_start_at_labels():
    assert _candidates({4, 2}, [1, 3])("a.bc", "/x") == ["a.bc/", "bc/"] and _candidates({1}, [1])("", "/") == []
    assert _candidates({2}, [1])("a." * 50_000 + "bc", "/") == ["bc/"]


def test_more_rules_than_a_cascade_holds(spark, monkeypatch):
    monkeypatch.setattr("tenun.llm.url_filter.RULES_PER_CASCADE", 2)
    rng = random.Random(6)
    rows = [*enumerate(urls(rng, 200))]
    given = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(tuple(r) for r in judge_urls(given, BLOCKED, ALLOWED).collect())
    assert got == sorted((i, *brute(u, BLOCKED, ALLOWED)) for i, u in rows)
