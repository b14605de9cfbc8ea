"""Every query against its SQL on the smallest tables, where they are there."""

import difflib
import math
import os
import re

import duckdb
import pytest

from tenun import oracles, queries
from tenun.functions.text import duplicate_key

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = oracles.oracles(queries.KEYWORDS, queries.START.isoformat(), queries.END.isoformat())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return found


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


def same(spark_df, relation):
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    place = [relation.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in spark_df.collect())
    want = sorted(repr([plain(r[k]) for k in place]) for r in relation.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck.sql(ORACLES[name]))


def test_flagship(spark):
    rows = queries.flagship(spark, SF).collect()
    assert sum(r.n_rows for r in rows) == 200 and {r.quality_status for r in rows} >= {"accepted"}


def test_similar_posts(spark, duck):
    """Against all pairs, one after the other."""
    said = duck.sql("SELECT conv_id, text FROM conversations").fetchall()
    texts = [t for _, t in said] + [re.sub(r"^\S+", "edited", t) for c, t in said if c % 5 == 0]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = sorted({r.k for r in table.select(duplicate_key("t").alias("k")).collect() if r.k})
    want = {}
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if min(len(a), len(b)) < 40 or min(len(a), len(b)) / max(len(a), len(b)) < 0.85:
                continue
            if difflib.SequenceMatcher(None, a, b, autojunk=False).quick_ratio() >= 0.9:
                best = max(difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in ((a, b), (b, a)))
                if best >= 0.92:
                    want[b, a] = round(best, 6)
    assert len(want) > 5
    assert {(r.text_a, r.text_b): r.similarity for r in queries.similar_posts(spark, SF).collect()} == want
