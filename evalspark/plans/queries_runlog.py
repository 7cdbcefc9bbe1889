"""Registered queries: task metrics and the result log."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import runlog
from evalspark.plans import views as V
from evalspark.plans.registry import finish, register

_PM_SQL = """pm AS (
  SELECT task,
    coalesce(
      arg_min(metric, pref) FILTER (WHERE pref IS NOT NULL),
      arg_min(metric, pos)) AS metric,
    coalesce(arg_min(value, pref) FILTER (WHERE pref IS NOT NULL), arg_min(value, pos)) AS value,
    CASE WHEN min(pref) IS NOT NULL THEN arg_min(value, spref) FILTER (WHERE spref IS NOT NULL) END AS stderr
  FROM (
    SELECT *, list_position(['acc_norm,none', 'acc,none', 'exact_match,exact_match', 'exact_match,none',
                             'acc_norm', 'acc', 'exact_match'], metric) AS pref,
              list_position(['acc_norm_stderr,none', 'acc_stderr,none', 'exact_match_stderr,exact_match',
                             'exact_match_stderr,none', 'acc_norm_stderr', 'acc_stderr', 'exact_match_stderr'], metric) AS spref
    FROM task_metrics WHERE value IS NOT NULL AND NOT isnan(value))
  GROUP BY task)"""


@register("a4_primary_metric", f"""
WITH {_PM_SQL}
SELECT task, metric, round(value, 9) AS value, round(stderr, 9) AS stderr FROM pm""", ["task_metrics"])
def a4_primary_metric(spark, sf):
    return finish(runlog.primary_metric(V.task_metrics(spark, sf)))


@register("a5_summary_long", """
SELECT task, CAST(pos AS BIGINT) AS pos, metric, round(value, 9) AS value FROM task_metrics WHERE value IS NOT NULL""",
          ["task_metrics"])
def a5_summary_long(spark, sf):
    return finish(runlog.summary_long(V.task_metrics(spark, sf)))


_META = {"model": "m-eval", "method": "harness", "limit": 200, "num_fewshot": 0, "seed": 42, "wall_s": 575.6,
         "mock_backend": False, "notes": "three-task\nrun"}


@register("a6_s7_append_results", f"""
WITH {_PM_SQL}
SELECT CAST((SELECT max(run_id) FROM runs) + row_number() OVER (ORDER BY task) AS BIGINT) AS run_id,
  'abc1234' AS commit, 'm-eval' AS model, task, 'harness' AS method, CAST(200 AS BIGINT) AS "limit",
  CAST(0 AS BIGINT) AS num_fewshot, CAST(42 AS BIGINT) AS seed, metric, round(value, 9) AS value,
  round(stderr, 9) AS stderr, round(575.6, 9) AS wall_s, false AS mock_backend, 'three-task run' AS notes
FROM pm""", ["task_metrics", "runs"])
def a6_s7_append_results(spark, sf):
    rows = runlog.log_rows(runlog.primary_metric(V.task_metrics(spark, sf)), _META)
    app = runlog.append_results(V.runs(spark, sf), rows, ["task"], commit="abc1234",
                                timestamp=F.lit("2026-01-01 00:00:00"))
    return finish(app.drop("timestamp", "delta", "ci95_low", "ci95_high"))


@register("s8_result_log_view", """
SELECT run_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS "when", commit, task, method,
  coalesce(CAST("limit" AS VARCHAR), 'full') AS "limit", metric, coalesce(printf('%.4f', value), '') AS value,
  CASE WHEN delta IS NULL THEN '' ELSE (CASE WHEN delta >= 0 THEN '+' ELSE '' END) || printf('%.4f', delta) END
    AS delta,
  CASE WHEN ci95_low IS NOT NULL AND ci95_high IS NOT NULL
       THEN '[' || printf('%.6f', ci95_low) || ', ' || printf('%.6f', ci95_high) || ']' ELSE '' END AS ci95,
  CASE WHEN wall_s IS NULL THEN '' ELSE printf('%.1f', wall_s) || 's' END AS wall,
  CASE WHEN mock_backend THEN 'yes' ELSE 'no' END AS mock
FROM runs""", ["runs"])
def s8_result_log_view(spark, sf):
    return finish(runlog.result_log_view(V.runs(spark, sf)))


@register("r1_leaderboard", """
SELECT task, method, count(run_id) AS n_runs, round(arg_max(value, run_id) FILTER (WHERE value IS NOT NULL), 9) AS last_value,
       round(avg(wall_s), 9) AS mean_wall_s
FROM runs GROUP BY task, method""", ["runs"])
def r1_leaderboard(spark, sf):
    return finish(runlog.leaderboard(V.runs(spark, sf)))


@register("r2_latest_runs", """
SELECT task, method,
  arg_max(run_id, (timestamp, run_id)) AS run_id,
  round(arg_max(value, (timestamp, run_id)) FILTER (WHERE value IS NOT NULL), 9) AS value,
  round(arg_max(wall_s, (timestamp, run_id)) FILTER (WHERE wall_s IS NOT NULL), 9) AS wall_s,
  round(arg_max(delta, (timestamp, run_id)) FILTER (WHERE delta IS NOT NULL), 9) AS delta
FROM runs GROUP BY task, method""", ["runs"])
def r2_latest_runs(spark, sf):
    return finish(runlog.latest_runs(V.runs(spark, sf)))


@register("r3_value_over_time", """
SELECT task, method, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, run_id, round(value, 9) AS value FROM runs""",
          ["runs"])
def r3_value_over_time(spark, sf):
    v = runlog.value_over_time(V.runs(spark, sf))
    return finish(v.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


@register("r4_delta_errors", """
SELECT run_id, task, method, round(delta, 9) AS delta, round(abs(delta - ci95_low), 9) AS err_low,
       round(abs(ci95_high - delta), 9) AS err_high
FROM runs WHERE delta IS NOT NULL AND ci95_low IS NOT NULL AND ci95_high IS NOT NULL""", ["runs"])
def r4_delta_errors(spark, sf):
    return finish(runlog.delta_errors(V.runs(spark, sf)))


@register("r5_exclude_smoke", """
SELECT task, method, count(*) AS n, round(avg(value), 9) AS mean_value FROM runs WHERE NOT mock_backend GROUP BY task, method""",
          ["runs"])
def r5_exclude_smoke(spark, sf):
    r = runlog.exclude_smoke(V.runs(spark, sf))
    return finish(r.groupBy("task", "method").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))
