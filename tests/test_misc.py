"""Unit cases for the smaller operators (limits, gates, params, roll-ups, log views, levers)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark.functions import logprob as LP
from evalspark.operators import compare, extras, perf, prep, runlog

REQ = "idx long, prompt_kind string, mode string, wall_s double, ttft_s double, output_tokens int, status string, " \
      "started_at double, ended_at double"


def test_limit_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "task string, pos int")
    out = prep.limit_items(df, 4, by="task", order="pos").groupBy("task").agg(F.max("pos").alias("m"), F.count("*").alias("n"))
    assert {r["task"]: (r["n"], r["m"]) for r in out.collect()} == {"a": (4, 3), "b": (3, 2)}
    assert [r["pos"] for r in prep.limit_items(df.filter("task = 'a'"), 2, order="pos").collect()] == [0, 1]


def test_gates(spark):
    items = spark.createDataFrame([("syn-1",), ("x",)], "ind string")
    assert prep.synthetic_ids(items).first()["synthetic"] == 1
    res = spark.createDataFrame([("v", True), ("v", True), ("w", True), ("w", False)], "variant string, correct boolean")
    flags = {r["variant"]: r["degenerate"] for r in prep.degenerate_accuracy(res).collect()}
    assert flags == {"v": True, "w": False}


def test_effective_params_and_total_tokens(spark):
    df = spark.createDataFrame([(None, None, 5, 7), (0.7, 0.2, 1, 2), (None, 0.3, 0, 0)],
                               "over double, task double, p int, c int")
    rows = df.select(LP.effective("over", "task", 0.0).alias("t"), LP.total_tokens("p", "c").alias("n")).collect()
    assert [(r["t"], r["n"]) for r in rows] == [(0.0, 12), (0.7, 3), (0.3, 0)]


def test_summary_long_keeps_numeric_in_order(spark):
    m = spark.createDataFrame([("t", 0, "alias", None), ("t", 2, "b", 2.0), ("t", 1, "a", 1.0)], "task string, pos int, metric string, value double")
    assert [r["metric"] for r in runlog.summary_long(m).collect()] == ["a", "b"]


def test_unmatched_ids(spark):
    b = spark.createDataFrame([("1",), ("2",)], "ind string")
    v = spark.createDataFrame([("2",), ("3",)], "ind string")
    assert sorted((r["ind"], r["side"]) for r in compare.unmatched(b, v).collect()) == [("1", "baseline"), ("3", "variant")]


def _req(spark):
    rows = [(1, "s", "generate", 1.0, None, 5, "ok", 0.0, 1.0), (2, "s", "generate", 2.0, None, 5, "error", 1.0, 3.0),
            (3, "s", "stream", 0.5, 0.1, 5, "ok", 0.0, 0.5), (4, "s", "stream", 0.7, 0.1, 5, "ok", 0.2, 0.9)]
    return spark.createDataFrame(rows, REQ)


def test_run_rollup_and_speedup(spark):
    r = perf.run_rollup(_req(spark), "mode").orderBy("mode").collect()
    assert [(x["mode"], x["n"], x["ok"], x["failed"], x["wall_s"]) for x in r] == [
        ("generate", 2, 1, 1, 3.0), ("stream", 2, 2, 0, 0.9)]
    sp = {x["mode"]: x for x in perf.speedup(_req(spark), "mode", "generate", "stream").collect()}
    assert sp["generate"]["speedup"] == pytest.approx(3.0 / 0.9)
    assert sp["stream"]["max_wall_s"] == 0.7


def test_box_and_hist(spark):
    box = perf.latency_box(_req(spark), "wall_s", keys=["mode"]).orderBy("mode").collect()
    assert (box[0]["n"], box[0]["min"], box[0]["max"]) == (1, 1.0, 1.0)  # error row excluded
    assert box[1]["median"] == pytest.approx(0.6)
    hist = perf.latency_hist(_req(spark), "wall_s", 0.5, keys=["prompt_kind"]).orderBy("bin").collect()
    assert [(h["bin"], h["n"]) for h in hist] == [(1, 2), (2, 1)]


def _log(spark):
    from evalspark import schemas
    rows = [
        (1, "2026-01-01 00:00:00", "c", "m", "t", "x", None, None, 42, "acc", 0.5, None, 0.1, 0.0, 0.2, 1.0, False, ""),
        (2, "2026-01-02 00:00:00", "c", "m", "t", "x", None, None, 42, "acc", 0.6, None, None, None, None, 2.0, True, ""),
        (3, "2026-01-02 00:00:00", "c", "m", "t", "x", None, None, 42, "acc", None, None, 0.3, 0.1, 0.4, 3.0, False, ""),
    ]
    df = spark.createDataFrame([(r[0], None) + r[2:] for r in rows], schemas.RESULT_LOG)
    return df.withColumn("timestamp", F.when(F.col("run_id") == 1, F.lit("2026-01-01")).otherwise(F.lit("2026-01-02"))
                         .cast("timestamp"))


def test_latest_runs_ties_by_run_id(spark):
    r = runlog.latest_runs(_log(spark)).first()
    assert (r["run_id"], r["value"], r["delta"]) == (3, 0.6, 0.3)


def test_value_over_time_delta_errors_smoke(spark):
    assert [r["run_id"] for r in runlog.value_over_time(_log(spark)).collect()] == [1, 2, 3]
    e = {r["run_id"]: r for r in runlog.delta_errors(_log(spark)).collect()}
    assert set(e) == {1, 3} and e[3]["err_low"] == pytest.approx(0.2) and e[3]["err_high"] == pytest.approx(0.1)
    assert sorted(r["run_id"] for r in runlog.exclude_smoke(_log(spark)).collect()) == [1, 3]


def test_ensemble_and_extraction(spark):
    scores = spark.createDataFrame([("q", 0, -1.0), ("q", 0, -3.0), ("q", 1, -2.0), ("q", 1, -2.0)],
                                   "ind string, option int, score double")
    assert extras.ensemble_scores(scores).first()["predicted"] == 0  # means -2.0 vs -2.0: first option
    df = spark.createDataFrame([("The answer is: Paris.",), ("",)], "t string")
    got = [r[0] for r in df.select(extras.extract_answer("t", r"answer is:\s*([A-Za-z]+)")).collect()]
    assert got == ["Paris", ""]


def test_row_index_contiguous_across_partitions(spark):
    from evalspark.functions.indexing import with_row_index
    df = spark.range(5000).repartition(7).select((F.col("id") * 7919 % 5000).alias("k"))
    rows = with_row_index(df, [F.desc("k")], "i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(5000))
    assert [r["k"] for r in rows] == sorted(range(5000), reverse=True)
