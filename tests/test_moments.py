from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenun.functions import moments as M
from tenun.plans import search
from tests.test_text import column

DAYS = date(2026, 10, 4), date(2026, 10, 10)


def iso(c):
    return M.iso_utc(M.parse_published(c))


def test_parse_and_render(spark):
    given = ["Mon Sep 21 11:15:29 +0000 2026", "2026-09-30T18:00:00Z", "2026-09-30T18:00:00.5+07:00", "2026-09-30 18:00:00", "nonsense", "", None]
    assert column(spark, given, iso) == ["2026-09-21T11:15:29Z", "2026-09-30T18:00:00Z", "2026-09-30T11:00:00.500000Z", "2026-09-30T18:00:00Z", None, None, None]


def test_local_buckets(spark):
    given = ["2026-09-30T18:00:00Z", "2026-12-31T20:00:00Z", "2026-12-31T16:59:59Z", "2024-12-30T00:00:00Z"]
    assert column(spark, given, lambda c: M.year_month(M.parse_published(c))) == ["2026-10", "2027-01", "2026-12", "2024-12"]
    assert column(spark, given, lambda c: M.year_week(M.parse_published(c))) == ["2026-W40", "2026-W53", "2026-W53", "2025-W01"]


def test_window_is_half_open(spark):
    given = ["2026-10-03T17:00:00Z", "2026-10-10T16:59:59Z", "2026-10-03T16:59:59Z", "2026-10-10T17:00:00Z"]
    assert column(spark, given, lambda c: M.in_window(M.parse_published(c), *map(F.lit, DAYS))) == [True, True, False, False]


def test_previous_days(spark):
    moment = "2026-10-12T16:59:00Z"
    got = column(spark, [moment], lambda c: F.concat_ws(" ", *M.previous_days(M.parse_published(c))))
    assert got == ["2026-10-05 2026-10-11"]
    assert search.scheduled_window(datetime(2026, 10, 12, 16, 59, tzinfo=UTC)) == (date(2026, 10, 5), date(2026, 10, 11))
    with pytest.raises(ValueError):
        search.scheduled_window(datetime(2026, 10, 12))


def test_counts(spark):
    assert column(spark, ["3", "0", "3.0", "-1", "1.5", "x", "", None, "nan"], M.count_value) == [3, 0, 3, None, None, None, None, None, None]


def test_weekly_runs():
    monday = datetime(2026, 10, 5, 16, 59, tzinfo=UTC)  # 23:59 in Jakarta
    assert search.last_due(1, monday) == monday and search.last_due(1, monday - timedelta(seconds=1)) == monday - timedelta(days=7)
    assert search.last_due(7, monday) == monday - timedelta(days=1) and search.last_due(2, monday) == monday - timedelta(days=6)
    days = {"a": 1, "b": 2}
    assert set(search.due_runs(days, {}, monday)) == {"a", "b"}
    assert search.due_runs(days, {"a": monday, "b": monday - timedelta(days=20)}, monday) == {"b": monday - timedelta(days=6)}
    for bad in (lambda: search.last_due(0, monday), lambda: search.last_due(1, datetime(2026, 10, 5))):
        with pytest.raises(ValueError):
            bad()


def test_search_plans():
    assert search.search_query(["a", " b c ", ""], "id", ['say "x"']) == '(a OR "b c") ("say \\"x\\"") lang:id'
    assert search.parse_window("01-10-2026", "07-10-2026") == (date(2026, 10, 1), date(2026, 10, 7))
    assert search.outer_window(date(2026, 10, 1), date(2026, 10, 7)) == (date(2026, 9, 30), date(2026, 10, 8))
    assert search.output_name("p", date(2026, 10, 1), date(2026, 10, 7)) == "p_2026-10-01_2026-10-07"
    assert search.backfill_window(date(2026, 10, 7), date(2026, 10, 8)) == (date(2026, 10, 1), date(2026, 10, 7))
    for bad in (lambda: search.search_query([" "]), lambda: search.search_query(["a"], "ID"), lambda: search.parse_window("02-10-2026", "01-10-2026"), lambda: search.parse_window("2026-10-01", "01-10-2026"), lambda: search.backfill_window(date(2026, 10, 8), date(2026, 10, 8))):
        with pytest.raises(ValueError):
            bad()
