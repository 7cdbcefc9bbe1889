"""Registered queries: request-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.joins import join_keys
from evalspark.functions.quantiles import exact_percentiles, percentile_names
from evalspark.operators import perf
from evalspark.plans import views as V
from evalspark.plans.registry import finish, register

R6 = "round({0}, 9) AS {1}"

_TPOT_SQL = """CASE WHEN output_tokens <= 0 OR wall_s <= 0 THEN 0.0
  WHEN ttft_s > 0 AND ttft_s < wall_s THEN output_tokens / (wall_s - ttft_s)
  ELSE output_tokens / wall_s END"""


@register("m2_tpot", f"""
SELECT idx, round({_TPOT_SQL}, 9) AS tpot FROM requests""", ["requests"])
def m2_tpot(spark, sf):
    return finish(V.requests(spark, sf).select("idx", perf.tpot().alias("tpot")))


def _q(expr: str, p: float, where: str) -> str:
    return f"round(coalesce(quantile_cont({expr}, {p}) FILTER (WHERE {where}), 0.0), 9)"


_OKW = "status = 'ok' AND wall_s IS NOT NULL AND NOT isnan(wall_s)"
_OKT = "status = 'ok' AND ttft_s IS NOT NULL AND NOT isnan(ttft_s)"
_OKP = "status = 'ok' AND tpot IS NOT NULL AND NOT isnan(tpot) AND NOT isinf(tpot)"

SUMMARY_SQL = f"""
SELECT prompt_kind, mode, count(*) AS n,
  count(*) FILTER (WHERE status = 'ok') AS ok,
  count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') AS errors,
  round(count(*) FILTER (WHERE status IS DISTINCT FROM 'ok') / count(*), 9) AS error_rate,
  {_q('wall_s', 0.5, _OKW)} AS wall_s_p50, {_q('wall_s', 0.95, _OKW)} AS wall_s_p95,
  {_q('wall_s', 0.99, _OKW)} AS wall_s_p99,
  {_q('ttft_s', 0.5, _OKT)} AS ttft_s_p50, {_q('ttft_s', 0.95, _OKT)} AS ttft_s_p95,
  {_q('ttft_s', 0.99, _OKT)} AS ttft_s_p99,
  round(coalesce(avg(tpot) FILTER (WHERE {_OKP}), 0.0), 9) AS tpot_mean,
  {_q('tpot', 0.5, _OKP)} AS tpot_p50,
  round(CASE WHEN max(ended_at) FILTER (WHERE status = 'ok') - min(started_at) FILTER (WHERE status = 'ok') > 0
        THEN count(*) FILTER (WHERE status = 'ok')
             / (max(ended_at) FILTER (WHERE status = 'ok') - min(started_at) FILTER (WHERE status = 'ok')) END, 9)
    AS throughput_rps
FROM (SELECT *, {_TPOT_SQL} AS tpot FROM requests)
GROUP BY prompt_kind, mode
"""


@register("m3_request_summary", SUMMARY_SQL, ["requests"])
def m3_request_summary(spark, sf):
    return finish(perf.summarise_requests(V.requests(spark, sf)))


@register("m1_ttft_percentiles", """
SELECT round(coalesce(quantile_cont(ttft_s, 0.5), 0.0), 9) AS p50,
       round(coalesce(quantile_cont(ttft_s, 0.95), 0.0), 9) AS p95,
       round(coalesce(quantile_cont(ttft_s, 0.99), 0.0), 9) AS p99
FROM requests WHERE ttft_s IS NOT NULL AND NOT isnan(ttft_s)""", ["requests"])
def m1_ttft_percentiles(spark, sf):
    return finish(perf.percentiles(V.requests(spark, sf), "ttft_s"))


@register("m1_wall_percentiles_banded", """
SELECT prompt_kind, round(quantile_cont(wall_s, 0.5), 9) AS p50, round(quantile_cont(wall_s, 0.95), 9) AS p95,
       round(quantile_cont(wall_s, 0.99), 9) AS p99
FROM requests WHERE wall_s IS NOT NULL AND NOT isnan(wall_s) GROUP BY prompt_kind""", ["requests"])
def m1_wall_percentiles_banded(spark, sf):
    """Several rounds of refinement: few sub-intervals, and little that may be collected."""
    return finish(exact_percentiles(V.requests(spark, sf), ["prompt_kind"], "wall_s", [0.5, 0.95, 0.99], limit=8, cells=16))


def _box_sql(col: str, where: str) -> str:
    qs = ", ".join(f"round(quantile_cont({col}, {p}), 9) AS {n}" for p, n in
                   [(0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max")])
    return f"SELECT prompt_kind, count({col}) AS n, {qs} FROM requests WHERE {where} GROUP BY prompt_kind"


@register("m6_wall_box", _box_sql("wall_s", "status = 'ok' AND wall_s IS NOT NULL"), ["requests"])
def m6_wall_box(spark, sf):
    return finish(perf.latency_box(V.requests(spark, sf), "wall_s"))


@register("m6_ttft_box", _box_sql("ttft_s", "status = 'ok' AND mode = 'stream' AND ttft_s IS NOT NULL"), ["requests"])
def m6_ttft_box(spark, sf):
    return finish(perf.latency_box(V.requests(spark, sf), "ttft_s", stream_only=True))


@register("m6_wall_hist", """
SELECT prompt_kind, CAST(floor(wall_s / 1.0) AS BIGINT) AS bin, round(CAST(floor(wall_s / 1.0) AS BIGINT) * 1.0, 9) AS bin_start,
       count(*) AS n
FROM requests WHERE status = 'ok' AND wall_s IS NOT NULL GROUP BY ALL""", ["requests"])
def m6_wall_hist(spark, sf):
    return finish(perf.latency_hist(V.requests(spark, sf), "wall_s", 1.0))


@register("m7_gpu_join", """
SELECT r.idx, count(g.timestamp) AS n_samples, round(avg(g.util_gpu), 9) AS util_mean, round(max(g.util_gpu), 9) AS util_max
FROM requests r LEFT JOIN gpu g ON g.timestamp >= r.started_at AND g.timestamp <= r.ended_at
GROUP BY r.idx""", ["requests", "gpu"])
def m7_gpu_join(spark, sf):
    return finish(perf.join_gpu(V.requests(spark, sf), V.gpu(spark, sf), 60.0))


@register("m8_speedup", """
WITH per AS (
  SELECT mode, count(*) AS n, max(ended_at) - min(started_at) AS pass_wall_s,
         avg(wall_s) AS mean_wall_s, max(wall_s) AS max_wall_s
  FROM requests GROUP BY mode)
SELECT mode, n, round(pass_wall_s, 9) AS pass_wall_s, round(mean_wall_s, 9) AS mean_wall_s,
       round(max_wall_s, 9) AS max_wall_s,
       round((SELECT pass_wall_s FROM per WHERE mode = 'generate') / (SELECT pass_wall_s FROM per WHERE mode = 'stream'), 9)
         AS speedup
FROM per""", ["requests"])
def m8_speedup(spark, sf):
    return finish(perf.speedup(V.requests(spark, sf), "mode", "generate", "stream"))


@register("a14_run_rollup", """
SELECT prompt_kind, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS ok,
       count(*) FILTER (WHERE status <> 'ok') AS failed,
       round(max(ended_at) - min(started_at), 9) AS wall_s,
       round(CASE WHEN max(ended_at) - min(started_at) > 0 THEN count(*) / (max(ended_at) - min(started_at)) END, 9)
         AS throughput_rps
FROM requests GROUP BY prompt_kind""", ["requests"])
def a14_run_rollup(spark, sf):
    return finish(perf.run_rollup(V.requests(spark, sf), "prompt_kind"))


_CHUNKS_SQL = """data_lines AS (
  SELECT request_id, ts, seq, trim(substr(value, 7)) AS p,
         min(CASE WHEN trim(substr(value, 7)) = '[DONE]' THEN {'t': ts, 's': seq} END) OVER (PARTITION BY request_id) AS done_at
  FROM sse_lines WHERE starts_with(value, 'data: ')),
chunks AS (
  SELECT request_id, ts, seq, coalesce(json_extract_string(p, '$.choices[0].text'), '') AS delta
  FROM data_lines WHERE done_at IS NULL OR {'t': ts, 's': seq} < done_at)"""


@register("l13_fold_chunks", f"""
, {_CHUNKS_SQL}
SELECT request_id, round(min(ts), 9) AS started_at, round(max(ts), 9) AS ended_at,
  round(min(ts) FILTER (WHERE delta <> '') - min(ts), 9) AS ttft_s,
  round(max(ts) - min(ts), 9) AS wall_s,
  CAST(coalesce(sum(CASE WHEN delta <> '' THEN greatest(1, len(list_filter(regexp_split_to_array(delta, '\\s+'), lambda x: x <> ''))) ELSE 0 END), 0) AS BIGINT) AS output_tokens,
  count(*) AS n_chunks
FROM chunks GROUP BY request_id""", ["sse_lines"])
def l13_fold_chunks(spark, sf):
    chunks = perf.parse_sse_lines(V.sse_lines(spark, sf), arrival="seq")
    return finish(perf.fold_chunks(chunks))


@register("z2_windowed_summary", """
SELECT CAST(floor(started_at / 3600) * 3600 AS BIGINT) AS window_start, prompt_kind, count(*) AS n,
  count(*) FILTER (WHERE status = 'ok') AS ok,
  round(coalesce(quantile_cont(wall_s, 0.5) FILTER (WHERE status = 'ok'), 0.0), 9) AS wall_s_p50,
  round(coalesce(quantile_cont(wall_s, 0.95) FILTER (WHERE status = 'ok'), 0.0), 9) AS wall_s_p95,
  round(coalesce(quantile_cont(wall_s, 0.99) FILTER (WHERE status = 'ok'), 0.0), 9) AS wall_s_p99
FROM requests GROUP BY ALL""", ["requests"])
def z2_windowed_summary(spark, sf):
    from evalspark.streaming.requests import windowed_summary

    return finish(windowed_summary(V.requests(spark, sf), 3600, ["prompt_kind"]))


@register("z2_sliding_summary", """
SELECT CAST(floor(started_at / 900) * 900 - 900 * k AS BIGINT) AS window_start, prompt_kind, count(*) AS n,
  count(*) FILTER (WHERE status = 'ok') AS ok,
  round(coalesce(quantile_cont(wall_s, 0.5) FILTER (WHERE status = 'ok'), 0.0), 9) AS wall_s_p50,
  round(coalesce(quantile_cont(wall_s, 0.95) FILTER (WHERE status = 'ok'), 0.0), 9) AS wall_s_p95,
  round(coalesce(quantile_cont(wall_s, 0.99) FILTER (WHERE status = 'ok'), 0.0), 9) AS wall_s_p99
FROM (SELECT *, unnest(range(4)) AS k FROM requests) GROUP BY ALL""", ["requests"])
def z2_sliding_summary(spark, sf):
    """Hour windows that start every quarter."""
    from evalspark.streaming.requests import windowed_summary

    return finish(windowed_summary(V.requests(spark, sf), 3600, ["prompt_kind"], slide_s=900))


@register("z2_rollup_sliding", """
SELECT CAST(floor(started_at / 900) * 900 - 900 * k AS BIGINT) AS window_start, prompt_kind, count(*) AS n,
  count(*) FILTER (WHERE status = 'ok') AS ok, true AS ranks_close
FROM (SELECT *, unnest(range(4)) AS k FROM requests) GROUP BY ALL""", ["requests"])
def z2_rollup_sliding(spark, sf):
    """Hour windows that start every quarter, merged from stored sketches of a minute.

    ``ranks_close``: each percentile lies between the exact values at ranks
    2 % (and one row) to either side.
    """
    from evalspark.streaming.requests import latency_rollup, rollup_windows, windowed_summary

    log = V.requests(spark, sf)
    rollup = latency_rollup(log).checkpoint()       # what a job would store
    got = rollup_windows(rollup, 3600, 900)
    near = []
    for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        near.append((name, max(0.0, p - 0.02), min(1.0, p + 0.02)))
    ps = sorted({x for _, lo, hi in near for x in (lo, hi)})
    exact = windowed_summary(log, 3600, ["prompt_kind"], slide_s=900, ps=ps, prefix="at_").drop("n", "ok")
    both = join_keys(got, exact, ["window_start", "prompt_kind"])
    label = lambda x: percentile_names([x], "at_")[0]
    few = F.col("ok") < 50      # a rank of a small window is more than 2 % of it
    close = F.lit(True)
    for name, lo, hi in near:
        x = F.col(f"wall_s_{name}")
        close &= few | x.isNull() | ((x >= F.col(f"`{label(lo)}`")) & (x <= F.col(f"`{label(hi)}`")))
    return finish(both.select("window_start", "prompt_kind", "n", "ok", close.alias("ranks_close")))


def _raw_requests(spark, sf):
    """The request log as text fields (as read from CSV), with some corrupt numbers."""
    r = V.requests(spark, sf)
    s = lambda c: F.col(c).cast("string")
    return r.select(
        s("idx").alias("idx"), "prompt_kind", s("prompt_chars").alias("prompt_chars"),
        s("max_tokens").alias("max_tokens"), "mode",
        F.when(F.col("idx") % 97 == 0, F.lit("oops")).otherwise(s("wall_s")).alias("wall_s"),
        F.coalesce(s("ttft_s"), F.lit("")).alias("ttft_s"),
        F.when(F.col("idx") % 89 == 0, F.lit("")).otherwise(s("output_tokens")).alias("output_tokens"),
        "status", "error", s("started_at").alias("started_at"), s("ended_at").alias("ended_at"))


@register("m5_coerce_requests", """
SELECT idx, round(CASE WHEN idx % 97 = 0 THEN NULL ELSE wall_s END, 9) AS wall_s, round(ttft_s, 9) AS ttft_s,
  CAST(CASE WHEN idx % 89 = 0 THEN 0 ELSE output_tokens END AS BIGINT) AS output_tokens
FROM requests""", ["requests"])
def m5_coerce_requests(spark, sf):
    from evalspark.sources.readers import coerce_requests

    c = coerce_requests(_raw_requests(spark, sf))
    return finish(c.select("idx", "wall_s", "ttft_s", "output_tokens"))


def _gpu_lines(spark, sf):
    from evalspark.sources.readers import read_table

    ev = read_table(spark, sf, "events")
    v = F.col("value").cast("string")
    util = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(v)
    line = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.concat_ws(
        ", ", (F.col("user_id") % 4).cast("string"), util, (F.col("value") / 2).cast("string"),
        (F.col("event_id") % 16000).cast("string"), F.lit("16000"), (40 + F.col("user_id") % 50).cast("string"),
        (F.col("value") * 0.5).cast("string")))
    return ev.select("event_id", line.alias("value"))


@register("s10_gpu_text", """
WITH l AS (
  SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE concat_ws(', ', CAST(user_id % 4 AS VARCHAR),
    CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END, CAST(value / 2 AS VARCHAR),
    CAST(event_id % 16000 AS VARCHAR), '16000', CAST(40 + user_id % 50 AS VARCHAR), CAST(value * 0.5 AS VARCHAR)) END AS line
  FROM events),
p AS (SELECT event_id, string_split(trim(line), ',') AS f FROM l WHERE trim(line) <> '')
SELECT event_id, CAST(TRY_CAST(trim(f[1]) AS INTEGER) AS BIGINT) AS "index",
  round(TRY_CAST(trim(f[2]) AS DOUBLE), 9) AS util_gpu, round(TRY_CAST(trim(f[3]) AS DOUBLE), 9) AS util_mem,
  round(TRY_CAST(trim(f[4]) AS DOUBLE), 9) AS mem_used, round(TRY_CAST(trim(f[5]) AS DOUBLE), 9) AS mem_total,
  round(TRY_CAST(trim(f[6]) AS DOUBLE), 9) AS temp, round(TRY_CAST(trim(f[7]) AS DOUBLE), 9) AS power
FROM p""")
def s10_gpu_text(spark, sf):
    from evalspark.sources.readers import parse_gpu_samples

    return finish(parse_gpu_samples(_gpu_lines(spark, sf), keep=["event_id"]))


_GAP_S = 12 * 3600


@register("z1_session_fold", f"""
WITH data_lines AS (
  SELECT request_id, event_ts, ts, seq, trim(substr(value, 7)) AS p,
         min(CASE WHEN trim(substr(value, 7)) = '[DONE]' THEN {{'t': ts, 's': seq}} END) OVER (PARTITION BY request_id) AS done_at
  FROM sse_lines WHERE starts_with(value, 'data: ')),
chunks AS (
  SELECT request_id, epoch_us(event_ts) AS us, coalesce(json_extract_string(p, '$.choices[0].text'), '') AS delta
  FROM data_lines WHERE done_at IS NULL OR {{'t': ts, 's': seq}} < done_at),
s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY request_id ORDER BY us) < CAST({_GAP_S} AS BIGINT) * 1000000 THEN 0 ELSE 1 END
                AS new_s FROM chunks),
t AS (SELECT *, sum(new_s) OVER (PARTITION BY request_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT request_id, round(min(us) / 1e6, 9) AS started_at, round(max(us) / 1e6, 9) AS ended_at,
  round((min(us) FILTER (WHERE delta <> '') - min(us)) / 1e6, 9) AS ttft_s, round((max(us) - min(us)) / 1e6, 9) AS wall_s,
  CAST(coalesce(sum(CASE WHEN delta <> '' THEN greatest(1, len(list_filter(regexp_split_to_array(delta, '\\s+'), lambda x: x <> ''))) ELSE 0 END), 0) AS BIGINT) AS output_tokens,
  count(*) AS n_chunks
FROM t GROUP BY request_id, sid""", ["sse_lines"])
def z1_session_fold(spark, sf):
    """Z1's session-window fold run as a batch query (the streaming form is tested in tests/)."""
    from evalspark.streaming.requests import fold_chunk_stream

    chunks = perf.parse_sse_lines(V.sse_lines(spark, sf), arrival="seq").select(
        "request_id", F.col("event_ts").alias("ts"), "delta")
    return finish(fold_chunk_stream(chunks, gap=f"{_GAP_S} seconds", watermark="1 hour"))


@register("m6_tpot_box", f"""
WITH t AS (SELECT prompt_kind, status, {_TPOT_SQL} AS tpot FROM requests)
SELECT prompt_kind, count(tpot) AS n, round(quantile_cont(tpot, 0.0), 9) AS min, round(quantile_cont(tpot, 0.25), 9) AS q1,
  round(quantile_cont(tpot, 0.5), 9) AS median, round(quantile_cont(tpot, 0.75), 9) AS q3,
  round(quantile_cont(tpot, 1.0), 9) AS max
FROM t WHERE status = 'ok' AND tpot IS NOT NULL GROUP BY prompt_kind""", ["requests"])
def m6_tpot_box(spark, sf):
    d = V.requests(spark, sf).withColumn("tpot", perf.tpot())
    return finish(perf.latency_box(d, "tpot"))
