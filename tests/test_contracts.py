"""Manifests, quarantine, batches, splits, lineage and staged writes."""

import hashlib
import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tenun.functions import moments
from tenun.operators import audit, checks, evaluation, labeling, manifests
from tenun.operators.checks import ContractError
from tenun.operators.preprocess import quality_report, report_document
from tenun.sources import posts as P
from tests.test_moments import iso

RUN = "raw/collected_date=2026-09-21/program=mbg/run_id=20260921T182524+0700"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def problem_of(spark, files=(), current=None, required=True, **changes):
    said = {"from_date": "2026-10-04", "to_date": "2026-10-10", "limit": 5, "input_sha256": sha("data"), "config_sha256": sha("now")} | changes
    text = json.dumps({k: v for k, v in said.items() if v is not ...}) if changes.get("manifest", "") is not None else None
    runs = spark.createDataFrame([("run", sha("data"), text)], "run string, sha256 string, manifest string")
    kept = spark.createDataFrame([*files], "folder string, name string, sha256 string")
    found = manifests.manifest_problems(runs, kept, current, required).collect()
    return found[0].problem if found else None


def test_manifests(spark):
    now = sha("now")
    assert problem_of(spark, current=now) is None
    assert problem_of(spark, [("history", now + ".yaml", now)]) is None
    assert problem_of(spark, [("run", "c.yaml", now)], config_snapshot="c.yaml") is None
    assert problem_of(spark, [("history", now + ".yaml", "x")]) == problem_of(spark) == "configuration changed"
    assert problem_of(spark, [("other", "c.yaml", now)], now, config_snapshot="c.yaml") == "configuration changed"
    for name in ("../c.yaml", "a/c.yaml", "..", "", 7, None, "a\\c"):
        assert problem_of(spark, [("run", str(name), now)], now, config_snapshot=name) == "configuration outside the run"
    for bad in ({"limit": "5"}, {"limit": 0}, {"limit": True}, {"limit": 1.5}, {"limit": ...}, {"from_date": "04-10-2026"}, {"from_date": 3}, {"to_date": "2026-10-03"}, {"to_date": "2026-13-01"}, {"input_sha256": ...}, {"input_sha256": 5}):
        assert problem_of(spark, current=now, **bad) == "invalid", bad
    assert problem_of(spark, current=now, input_sha256=sha("other")) == "data changed"
    for bad in (..., "zz", 5):
        assert problem_of(spark, config_sha256=bad) == "invalid configuration checksum"
    assert problem_of(spark, manifest=None) == "missing" and problem_of(spark, manifest=None, required=False) is None


def test_a_run_is_accepted_whole(spark):
    posts = spark.createDataFrame([("1", "text", "2026-10-05T00:00:00Z")], "id_str string, full_text string, created_at string")
    said = {"from_date": "2026-10-04", "to_date": "2026-10-10", "limit": 5, "input_sha256": sha("data"), "config_sha256": sha("now")}
    run = spark.createDataFrame([("run", sha("data"), json.dumps(said))], "run string, sha256 string, manifest string")
    none = spark.createDataFrame([], "folder string, name string, sha256 string")
    assert manifests.validate_run(posts, run, none, sha("now"))["rows"] == 1
    with pytest.raises(ContractError, match="configuration changed"):
        manifests.validate_run(posts, run, none, sha("later"))
    with pytest.raises(ContractError):
        manifests.validate_run(posts.withColumn("created_at", F.lit("2026-10-11T00:00:00Z")), run, none, sha("now"))


def test_quarantine(spark, tmp_path):
    root, away = tmp_path / "processed", tmp_path / "quarantine"
    for name in ("p=1/run=a", "p=1/run=b"):
        (root / name).mkdir(parents=True)
        (root / name / "data").write_text(name)
    schema = "run_path string, reasons array<string>"
    found = spark.createDataFrame([("p=1/run=a", ["manifest_invalid"])], schema)
    assert [x.rsplit("/", 1)[1] for x in audit.quarantine_runs(found, str(root), str(away))] == ["run=a"]
    assert not (root / "p=1/run=a").exists() and (root / "p=1/run=b/data").exists()
    assert json.loads((away / "p=1/run=a/quarantine.json").read_text())["reasons"] == ["manifest_invalid"]
    (root / "p=1/run=a").mkdir()
    for bad in ("p=1/run=a", "../x", "/etc", "p=1/./run=b"):
        with pytest.raises(ContractError):
            audit.quarantine_runs(spark.createDataFrame([("p=1/run=b", []), (bad, [])], schema), str(root), str(away))
        assert (root / "p=1/run=b/data").exists()


def test_batches_and_lookup(spark):
    a = spark.createDataFrame([("m", "1", "x"), ("m", "2", None)], "target_program string, tweet_id string, label string")
    b = spark.createDataFrame([("m", "3", "n")], "target_program string, tweet_id string, note string")
    rows = [tuple(r) for r in labeling.stack_batches(a, b).orderBy("batch", "tweet_id").select("tweet_id", "label", "note", "batch").collect()]
    assert rows == [("1", "x", "", 0), ("2", "", "", 0), ("3", "", "n", 1)]
    wanted = spark.createDataFrame([("m", "2", 0), ("m", "1", 1)], "target_program string, tweet_id string, pos int")
    assert [r.tweet_id for r in labeling.lookup_in_order(wanted, a, "pos").collect()] == ["2", "1"]
    for table in (a.where("tweet_id = '1'"), a.unionByName(a)):
        with pytest.raises(ContractError):
            labeling.lookup_in_order(wanted, table, "pos")


def test_split_problems(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert labeling.split_problems(ids(1, 2, 3), ids(1, 3), ids(2), "id").count() == 0
    got = dict(map(tuple, labeling.split_problems(ids(1, 2, 3, 4), ids(1, 2, 4, 4), ids(2, 9), "id").collect()))
    assert got == {2: "in both", 3: "in neither", 4: "repeated", 9: "unknown"}


def test_training_manifest(spark):
    rows = spark.createDataFrame([("True", "true"), ("True", "False")], "human_reviewed string, approved_for_training string")
    manifest = {"raw_md5": "a", "label_status": "provisional_ai", "deployment_approved": False, "preprocessing_version": "3", "rows": 2}
    labeling.check_training_manifest(rows, manifest, {"raw_md5": "a"}, "3")
    labeling.check_training_manifest(rows.limit(1), manifest | {"label_status": "human_approved", "rows": 1}, {}, "3")
    for bad in ({"raw_md5": "b"}, {"label_status": "human_approved"}, {"deployment_approved": True}, {"preprocessing_version": "2"}, {"rows": 3}):
        with pytest.raises(ContractError):
            labeling.check_training_manifest(rows, manifest | bad, {"raw_md5": "a"}, "3")
    with pytest.raises(ContractError, match="preprocessing_version.*rows"):
        labeling.check_training_manifest(rows, manifest | {"rows": 5, "preprocessing_version": "9"}, {"raw_md5": "a"}, "3")
    table = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    assert [tuple(r) for r in labeling.lineage_differences(table({"a": "1", "b": "2"}), table({"a": "1", "b": "3", "c": None, "d": "4"})).orderBy("key").collect()] == [("b", "2", "3"), ("d", None, "4")]


def test_staged_writes(spark, tmp_path):
    rows = spark.createDataFrame([("m", "2", 'a "q"\nb'), ("m", "1", None)], "target_program string, tweet_id string, text string")
    target = str(tmp_path / "labels")
    for _ in range(2):
        assert P.write_once(rows, target) == target
    with pytest.raises(P.ZoneError):
        P.write_once(rows.limit(1), target)
    assert [r.tweet_id for r in P.read_text_csv(spark, target).collect()] == ["1", "2"]
    assert P.write_snapshot(rows, str(tmp_path / "snap"), 2).endswith("version=2")
    with pytest.raises(P.ZoneError):
        P.write_snapshot(rows, str(tmp_path / "snap"), 2)
    P.publish_raw(rows, str(tmp_path / RUN))
    for bad in (lambda: P.publish_raw(rows, str(tmp_path / RUN)), lambda: P.publish_raw(rows.limit(0), str(tmp_path / RUN.replace("T18", "T19"))), lambda: P.publish_raw(rows, str(tmp_path / "other"))):
        with pytest.raises(P.ZoneError):
            bad()
    assert not [x for _, names, _ in os.walk(tmp_path) for x in names if x.startswith(".publish")]


def test_a_dead_writers_lock_is_taken_away(spark, tmp_path):
    zone = P.Zone(spark, str(tmp_path))
    (tmp_path / ".lock").touch()
    with pytest.raises(P.ZoneError):
        with zone.lock(0.5):
            pass
    os.utime(tmp_path / ".lock", (0, 0))
    with zone.lock(0.5):
        assert (tmp_path / ".lock").exists()
    assert not (tmp_path / ".lock").exists()


def test_report(spark):
    schema = "published_at string, language string, quality_status string, is_duplicate boolean, is_duplicate_across_runs boolean, is_empty_cleaned_text boolean, is_duplicate_text boolean, is_near_duplicate boolean, language_needs_review boolean, is_eligible_for_labeling boolean"
    flags = (False,) * 6 + (True,)
    rows = [("2026-01-02T00:00:00Z", "id", "accepted", *flags), ("2026-01-01T00:00:00.500000Z", None, "accepted", *flags), ("2026-01-02T00:00:00Z", "id", "duplicate", True, *(False,) * 6)]
    records = spark.createDataFrame(rows, schema)
    got = {(r.metric, r.key): r.value for r in quality_report(records).collect()}
    assert got["published_at_min", "2026-01-01T00:00:00.500000Z"] == 1 and got["published_at_max", "2026-01-02T00:00:00Z"] == 2
    document = report_document(records, 3)
    assert document["language"] == {"id": 2, "unknown": 1} and document["quality_status"] == {"accepted": 2, "duplicate": 1} and document["duplicate_tweet_ids"] == 1
    assert document["published_at_min"] == "2026-01-01T00:00:00.500000Z" and document["eligible_for_labeling"] == 2
    with pytest.raises(ContractError):
        report_document(records, 4)
    assert quality_report(records.limit(0)).where("metric like 'published%'").count() == 0


def test_reports_of_unknown_labels_and_slices(spark):
    rows = spark.createDataFrame([("negative", "junk", "a"), ("negative", "negative", "a"), ("odd", "neutral", "b"), ("positive", None, "b")], "t string, p string, g string")
    got = {r.label: (r.support, round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in evaluation.label_report(rows, "t", "p").collect()}
    assert got == {"negative": (2, 1.0, 0.5, 0.667), "neutral": (0, 0.0, 0.0, 0.0), "positive": (1, 0.0, 0.0, 0.0)}
    slices = {r.g: r for r in evaluation.slice_metrics(rows, "g", "t", "p").collect()}
    assert {g: r.rows for g, r in slices.items()} == {"a": 2, "b": 2}
    assert round(slices["a"].macro_f1, 4) == 0.2222 and round(slices["a"].weighted_f1, 4) == 0.6667 and slices["a"].recall_negative == 0.5 and slices["b"].macro_f1 == 0
    assert {tuple(r) for r in evaluation.split_counts(rows, "g", "t").collect()} == {("a", "negative", 2), ("b", "odd", 1), ("b", "positive", 1)}
    top = evaluation.rank_within(spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 9)], "k string, s int"), ["k"], "s", 2)
    assert sorted(map(tuple, top.collect())) == [("a", 2, 2), ("a", 3, 1), ("b", 9, 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_times_do_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        given = ["2026-01-01T00:00:00", "2026-03-08 07:30:00", "2026-03-08T02:30:00", "2026-01-01", "2026-09-30T18:00:00.5+07:00", "Mon Sep 21 11:15:29 +0000 2026", "2026-1-1", "x"]
        table = spark.createDataFrame([(g,) for g in given], "c string")
        assert [r.c for r in table.select(iso(F.col("c")).alias("c")).collect()] == ["2026-01-01T00:00:00Z", "2026-03-08T07:30:00Z", "2026-03-08T02:30:00Z", "2026-01-01T00:00:00Z", "2026-09-30T11:00:00.500000Z", "2026-09-21T11:15:29Z", None, None]
        at = moments.parse_published(F.col("c"))
        row = table.where("c = '2026-01-01T00:00:00'").select(moments.year_week(at).alias("w"), moments.local_date(at).alias("d"), *[moments.iso_utc(b).alias(k) for k, b in zip("lh", moments.window_bounds(F.lit(date(2026, 3, 8)), F.lit(date(2026, 3, 8))))]).first()
        assert tuple(row) == ("2026-W01", date(2026, 1, 1), "2026-03-07T17:00:00Z", "2026-03-08T17:00:00Z")
        posts = spark.createDataFrame([("1", "t", "2026-03-07T17:00:00Z"), ("2", "t", "2026-03-08T16:59:59Z")], "id_str string, full_text string, created_at string")
        assert checks.validate_collection(posts, date(2026, 3, 8), date(2026, 3, 8), 2)["published_at_max"] == "2026-03-08T16:59:59Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
