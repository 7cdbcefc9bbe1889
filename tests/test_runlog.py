"""Task metrics and the result log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark.operators import runlog
from evalspark.sources.readers import read_result_log

MET = "task string, pos int, metric string, value double"


def test_primary_metric_preferences(spark):
    rows = [
        ("hs", 0, "alias", None), ("hs", 1, "acc,none", 0.495), ("hs", 2, "acc_stderr,none", 0.0354),
        ("hs", 3, "acc_norm,none", 0.63), ("hs", 4, "acc_norm_stderr,none", 0.0342),
        ("qa", 0, "exact_match,none", 0.42), ("qa", 1, "exact_match_stderr,none", 0.05),
        ("wt", 0, "alias", None), ("wt", 1, "word_perplexity,none", 12.0), ("wt", 2, "byte_perplexity,none", 1.5),
        ("empty", 0, "alias", None),
    ]
    m = spark.createDataFrame(rows, MET)
    out = {r["task"]: r for r in runlog.primary_metric(m).collect()}
    assert (out["hs"]["metric"], out["hs"]["value"], out["hs"]["stderr"]) == ("acc_norm,none", 0.63, 0.0342)
    assert (out["qa"]["metric"], out["qa"]["stderr"]) == ("exact_match,none", 0.05)
    assert (out["wt"]["metric"], out["wt"]["stderr"]) == ("word_perplexity,none", None)
    assert "empty" not in out
    assert [r["task"] for r in runlog.tasks_without_metric(m).collect()] == ["empty"]


def _log(spark, ids):
    from evalspark import schemas
    rows = [(i, None, "c", "m", "t", "x", None, None, 42, "acc", 0.5, None, None, None, None, 1.0, False, "")
            for i in ids]
    return spark.createDataFrame(rows, schemas.RESULT_LOG)


def test_append_numbers_after_max(spark):
    new = spark.createDataFrame([("t1", "acc", 0.5), ("t2", "acc", 0.25)], "task string, metric string, value double")
    rows = runlog.log_rows(new.withColumn("stderr", F.lit(None).cast("double")), {"model": "m", "method": "x",
                                                                                  "seed": 42, "notes": "a\nb"})
    app = runlog.append_results(_log(spark, [1, 2, 3]), rows, ["task"], commit="abc").orderBy("run_id").collect()
    assert [r["run_id"] for r in app] == [4, 5] and app[0]["notes"] == "a b"
    first = runlog.append_results(_log(spark, []), rows, ["task"]).orderBy("run_id").collect()
    assert [r["run_id"] for r in first] == [1, 2]


def test_csv_roundtrip_and_view(spark, scratch):
    log = _log(spark, [1]).withColumn("delta", F.lit(0.05)).withColumn("ci95_low", F.lit(-0.01)) \
        .withColumn("ci95_high", F.lit(0.11)).withColumn("timestamp", F.lit("2026-04-19 23:43:50").cast("timestamp"))
    runlog.write_result_log(log, f"{scratch}/log")
    back = read_result_log(spark, f"{scratch}/log").first()
    assert back["run_id"] == 1 and back["delta"] == pytest.approx(0.05) and back["stderr"] is None
    v = runlog.result_log_view(back and log).first()
    assert (v["value"], v["delta"], v["ci95"], v["limit"], v["mock"]) == \
        ("0.5000", "+0.0500", "[-0.010000, 0.110000]", "full", "no")
    assert v["when"] == "2026-04-19T23:43:50"


def test_leaderboard_last_non_null(spark):
    rows = [(1, "t", "m", 0.5, 1.0), (2, "t", "m", 0.7, 3.0), (3, "t", "m", None, 2.0)]
    df = spark.createDataFrame(rows, "run_id long, task string, method string, value double, wall_s double")
    r = runlog.leaderboard(df).first()
    assert (r["n_runs"], r["last_value"], r["mean_wall_s"]) == (3, 0.7, 2.0)
