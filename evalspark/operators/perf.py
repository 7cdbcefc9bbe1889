"""Request-log analytics.

Every function takes a request log with the D13 columns (``idx, prompt_kind,
prompt_chars, max_tokens, mode, wall_s, ttft_s, output_tokens, status, error,
started_at, ended_at``) and returns a DataFrame. Aggregations are single
``groupBy`` shuffles with partial (map-side) aggregation; percentiles go
through :func:`evalspark.functions.quantiles.exact_percentiles`, which never
gathers a whole group into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.joins import join_keys
from evalspark.functions.quantiles import exact_percentiles

LATENCY_PS = (0.5, 0.95, 0.99)
BOX_PS = (0.0, 0.25, 0.5, 0.75, 1.0)


def tpot(wall_s: Column | str = "wall_s", ttft_s: Column | str = "ttft_s",
         output_tokens: Column | str = "output_tokens") -> Column:
    """M2: tokens per decode second.

    ``tokens / (wall - ttft)`` when ``0 < ttft < wall``, else ``tokens / wall``;
    0.0 when tokens <= 0 or wall <= 0. A NaN wall propagates as NaN.
    """
    w = F.col(wall_s) if isinstance(wall_s, str) else wall_s
    t = F.col(ttft_s) if isinstance(ttft_s, str) else ttft_s
    k = (F.col(output_tokens) if isinstance(output_tokens, str) else output_tokens).cast("double")
    decode = (t > 0) & (t < w)
    return (
        F.when((k <= 0) | (w <= 0), F.lit(0.0))
        .when(decode & t.isNotNull(), k / (w - t))
        .otherwise(k / w)
    )


def percentiles(df: DataFrame, value: str, keys: Sequence[str] = (), ps: Sequence[float] = LATENCY_PS,
                prefix: str = "") -> DataFrame:
    """M1: exact P50/P95/P99 (linear interpolation), null and NaN ignored, empty → 0.0.

    With no keys the result is exactly one row, also for an empty input.
    """
    got = exact_percentiles(df, keys, value, ps, prefix=prefix)
    if keys:
        return got
    # At most one row; a global aggregate turns "no row" into one row of zeros.
    return got.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in got.columns])


def _ok(status: str = "status") -> Column:
    return F.col(status) == "ok"


def summarise_requests(df: DataFrame, keys: Sequence[str] = ("prompt_kind", "mode"), exact: bool = True,
                       accuracy: int = 10_000) -> DataFrame:
    """M3 + M4: per (prompt_kind, mode) request summary, sorted by the keys.

    n, ok, errors (every non-ok status, timeouts included), error_rate; wall and
    TTFT percentiles over ok rows; TPOT mean and median over ok rows (infinite
    and NaN values ignored); throughput = ok / (max end - min start) over ok rows
    within the group, null when that window is not positive. Without keys the
    result is one row, also for an empty log (error_rate null).

    ``exact=False`` computes the percentiles with ``percentile_approx`` in the
    same single aggregation (one scan, rank error ``n / accuracy``).
    """
    keys = list(keys)
    d = df.withColumn("_tpot", tpot())
    ok = _ok()
    finite_tpot = F.when(~F.isnan("_tpot") & (F.abs("_tpot") != F.lit(float("inf"))), F.col("_tpot"))
    if not exact:
        return _summary_approx(d, keys, ok, finite_tpot, accuracy)
    counts = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok | F.col("status").isNull()).alias("errors"),
        F.avg(F.when(ok, finite_tpot)).alias("tpot_mean"),
        F.max(F.when(ok, F.col("ended_at"))).alias("_end"),
        F.min(F.when(ok, F.col("started_at"))).alias("_start"),
    )
    # Long form (group, metric, x) over ok rows so one percentile pass covers all three metrics.
    okrows = d.filter(ok).select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit("wall_s").alias("metric"), F.col("wall_s").cast("double").alias("x")),
            F.struct(F.lit("ttft_s").alias("metric"), F.col("ttft_s").cast("double").alias("x")),
            F.struct(F.lit("tpot").alias("metric"), finite_tpot.alias("x")),
        )).alias("_m"),
    ).select(*keys, "_m.metric", "_m.x")
    pct = exact_percentiles(okrows, keys + ["metric"], "x", LATENCY_PS)
    wide = pct.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}")
          for m in ("wall_s", "ttft_s") for p in ("p50", "p95", "p99")],
        F.max(F.when(F.col("metric") == "tpot", F.col("p50"))).alias("tpot_p50"),
    )
    joined = join_keys(counts, wide, keys, "left")
    window = F.col("_end") - F.col("_start")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return joined.select(
        *keys,
        "n", "ok", "errors",
        F.try_divide("errors", "n").alias("error_rate"),
        z("wall_s_p50"), z("wall_s_p95"), z("wall_s_p99"),
        z("ttft_s_p50"), z("ttft_s_p95"), z("ttft_s_p99"),
        z("tpot_mean"), z("tpot_p50"),
        F.when(window > 0, F.col("ok") / window).alias("throughput_rps"),
    ).orderBy(*(keys or ["n"]))


def _summary_approx(d: DataFrame, keys: list[str], ok: Column, finite_tpot: Column, accuracy: int) -> DataFrame:
    ps = list(LATENCY_PS)

    def nan_free(c: Column) -> Column:
        return F.when(ok & c.isNotNull() & ~F.isnan(c), c)

    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok | F.col("status").isNull()).alias("errors"),
        F.percentile_approx(nan_free(F.col("wall_s")), ps, accuracy).alias("_w"),
        F.percentile_approx(nan_free(F.col("ttft_s")), ps, accuracy).alias("_t"),
        F.avg(F.when(ok, finite_tpot)).alias("tpot_mean"),
        F.percentile_approx(F.when(ok, finite_tpot), 0.5, accuracy).alias("tpot_p50"),
        F.max(F.when(ok, F.col("ended_at"))).alias("_end"),
        F.min(F.when(ok, F.col("started_at"))).alias("_start"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    window = F.col("_end") - F.col("_start")
    return g.select(
        *keys, "n", "ok", "errors", F.try_divide("errors", "n").alias("error_rate"),
        *[z(F.col("_w")[i]).alias(f"wall_s_{n}") for i, n in enumerate(("p50", "p95", "p99"))],
        *[z(F.col("_t")[i]).alias(f"ttft_s_{n}") for i, n in enumerate(("p50", "p95", "p99"))],
        z(F.col("tpot_mean")).alias("tpot_mean"), z(F.col("tpot_p50")).alias("tpot_p50"),
        F.when(window > 0, F.col("ok") / window).alias("throughput_rps"),
    ).orderBy(*(keys or ["n"]))


def latency_box(df: DataFrame, value: str = "wall_s", keys: Sequence[str] = ("prompt_kind",),
                stream_only: bool = False) -> DataFrame:
    """M6: box statistics (min, q1, median, q3, max) of a latency column per key, ok rows only.

    ``stream_only`` keeps streamed rows with a non-null value (the TTFT box).
    """
    d = df.filter(_ok())
    if stream_only:
        d = d.filter((F.col("mode") == "stream") & F.col(value).isNotNull())
    got = exact_percentiles(d, list(keys), value, BOX_PS)
    n = d.groupBy(*keys).agg(F.count(F.col(value)).alias("n"))
    return join_keys(n, got, keys).select(
        *keys, "n",
        F.col("p0").alias("min"), F.col("p25").alias("q1"), F.col("p50").alias("median"),
        F.col("p75").alias("q3"), F.col("p100").alias("max"),
    )


def latency_hist(df: DataFrame, value: str = "wall_s", width: float = 1.0,
                 keys: Sequence[str] = ("prompt_kind",)) -> DataFrame:
    """M6: histogram of a latency column in fixed-width bins per key (ok rows)."""
    b = F.floor(F.col(value) / F.lit(float(width))).cast("bigint")
    return (
        df.filter(_ok() & F.col(value).isNotNull())
        .groupBy(*keys, b.alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(*keys, "bin", (F.col("bin") * F.lit(float(width))).alias("bin_start"), "n")
    )


def _cover(first: Column, last: Column, levels: int) -> Column:
    """array<struct<level, node>>: aligned blocks of 2^level bins that make up the bins ``first``..``last``.

    At most two blocks per level: the range's left and right rest.
    """
    def at(level: Column) -> Column:
        step = F.pow(F.lit(2.0), level).cast("long")
        lo, hi = F.ceil(first / step), F.floor((last + 1) / step)
        block = lambda node: F.struct(level.alias("level"), node.cast("long").alias("node"))
        open_ = lo < hi
        return F.array(F.when(open_ & (F.pmod(lo, F.lit(2)) == 1), block(lo)), F.when(open_ & (F.pmod(hi, F.lit(2)) == 1), block(hi - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)))


def join_gpu(requests: DataFrame, samples: DataFrame, bin_s: float = 60.0) -> DataFrame:
    """M7: attach GPU samples taken while each request ran.

    Range join ``started_at <= ts <= ended_at`` over a dyadic cover of time
    bins: samples are added up per bin and per aligned block of 2, 4, 8, ...
    bins; a request reads the blocks that make up its inner bins (at most two
    per doubling of its length) and compares single samples only in its first
    and last bin. Returns one row per request row (rows that repeat an ``idx``
    each get their own): sample count (0 if no sample fell into it), mean and
    max utilisation.
    """
    b = F.lit(float(bin_s))
    span = ["started_at", "ended_at"]
    bins = [F.floor(F.col(c) / b).cast("bigint").alias(n) for c, n in zip(span, ("_a", "_b"))]
    spans = requests.select(*span).distinct().filter("started_at <= ended_at").select(*span, *bins)
    smp = samples.select(F.col("timestamp").alias("_ts"), F.col("util_gpu").cast("double").alias("_u"),
                         F.floor(F.col("timestamp") / b).cast("bigint").alias("_bin")).filter("_ts is not null")
    measures = [F.sum("_n").alias("_n"), F.sum("_c").alias("_c"), F.sum("_s").alias("_s"), F.max("_m").alias("_m")]
    one = [F.lit(1).alias("_n"), F.col("_u").isNotNull().cast("int").alias("_c"), F.col("_u").alias("_s"), F.col("_u").alias("_m")]
    longest = spans.agg(F.max(F.col("_b") - F.col("_a"))).first()[0] or 0
    levels = max(0, int(longest).bit_length())
    per_bin = smp.select("_bin", *one).groupBy("_bin").agg(*measures)
    blocks = (per_bin.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels))))
              .groupBy(F.col("_l").alias("_level"), F.floor(F.col("_bin") / F.pow(F.lit(2.0), F.col("_l"))).cast("bigint").alias("_node")).agg(*measures))
    inner = (spans.withColumn("_t", F.explode(_cover(F.col("_a") + 1, F.col("_b") - 1, levels)))
             .select(*span, F.col("_t.level").alias("_level"), F.col("_t.node").alias("_node")).join(blocks, ["_level", "_node"])
             .select(*span, "_n", "_c", "_s", "_m"))
    ends = (spans.withColumn("_bin", F.explode(F.array_distinct(F.array("_a", "_b")))).join(smp, "_bin")
            .filter((F.col("_ts") >= F.col("started_at")) & (F.col("_ts") <= F.col("ended_at"))).select(*span, *one))
    got = inner.unionByName(ends).groupBy(*span).agg(*measures).select(
        *span, F.col("_n").alias("n_samples"), (F.col("_s") / F.nullif("_c", F.lit(0))).alias("util_mean"), F.col("_m").alias("util_max"))
    out = join_keys(requests.select("idx", *span), got, span, "left")
    return out.select("idx", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "util_mean", "util_max")


def speedup(df: DataFrame, pass_col: str, sequential: str, concurrent: str) -> DataFrame:
    """M8: wall per pass (max end - min start), mean / max per-request wall, speed-up.

    ``speedup`` = sequential pass wall / concurrent pass wall, on every row.
    """
    per = df.filter(F.col(pass_col).isin(sequential, concurrent)).groupBy(pass_col).agg(
        F.count("*").alias("n"),
        (F.max("ended_at") - F.min("started_at")).alias("pass_wall_s"),
        F.avg("wall_s").alias("mean_wall_s"),
        F.max("wall_s").alias("max_wall_s"),
    ).checkpoint()
    # Two rows (one per pass): the ratio is computed from their two walls.
    walls = {r[pass_col]: r["pass_wall_s"] for r in per.select(pass_col, "pass_wall_s").collect()}
    seq, con = walls.get(sequential), walls.get(concurrent)
    ratio = seq / con if seq is not None and con else None
    return per.withColumn("speedup", F.lit(ratio).cast("double"))


def run_rollup(df: DataFrame, run_col: str) -> DataFrame:
    """Per run: requests, ok, failed, wall (max end - min start), requests per second."""
    wall = F.max("ended_at") - F.min("started_at")
    return df.groupBy(run_col).agg(
        F.count("*").alias("n"),
        F.count_if(_ok()).alias("ok"),
        F.count_if(~_ok()).alias("failed"),
        wall.alias("wall_s"),
        F.when(wall > 0, F.count("*") / wall).alias("throughput_rps"),
    )


def fold_chunks(chunks: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Fold stream chunk events ``(request_id, ts, delta)`` into one request row.

    TTFT = first non-empty delta - start, tokens = sum of max(1, words(delta))
    over non-empty deltas, text = deltas concatenated in time order, wall = last
    chunk - start. ``start`` is taken from ``starts(request_id, started_at)``
    when given, else the first chunk's time.
    """
    nonempty = F.col("delta").isNotNull() & (F.col("delta") != "")
    words = F.size(F.filter(F.split(F.col("delta"), r"\s+"), lambda x: x != ""))
    g = chunks.groupBy("request_id").agg(
        F.min("ts").alias("_first_ts"),
        F.max("ts").alias("ended_at"),
        F.min(F.when(nonempty, F.col("ts"))).alias("_first_tok"),
        F.sum(F.when(nonempty, F.greatest(F.lit(1), words)).otherwise(0)).cast("bigint").alias("output_tokens"),
        F.count("*").alias("n_chunks"),
    )
    if starts is not None:
        g = g.join(starts, "request_id", "left").withColumn(
            "started_at", F.coalesce(F.col("started_at"), F.col("_first_ts")))
    else:
        g = g.withColumn("started_at", F.col("_first_ts"))
    return g.select(
        "request_id", "started_at", "ended_at",
        (F.col("_first_tok") - F.col("started_at")).alias("ttft_s"),
        (F.col("ended_at") - F.col("started_at")).alias("wall_s"),
        "output_tokens", "n_chunks",
    )


def fold_text(chunks: DataFrame, arrival: str | None = None) -> DataFrame:
    """L13 text: deltas concatenated in time order per request.

    Chunks of one time follow the column ``arrival`` (their sequence number
    in the stream); without one their order is by text.

    Text is the one output that needs every delta of a request together; a
    request's chunk count is bounded by its max_tokens, so the list is small.
    """
    return chunks.groupBy("request_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("ts", *([arrival] if arrival else []), F.coalesce("delta", F.lit("")).alias("_d")))),
                        lambda s: s.getField("_d")), "").alias("text")
    )


def parse_sse_lines(lines: DataFrame, text_col: str = "value", request: str = "request_id",
                    order: str = "ts", arrival: str | None = None) -> DataFrame:
    """L13 input: server-sent-event lines → chunk rows.

    Keeps lines starting with ``data: `` that arrive before the request's
    first ``[DONE]`` marker, and parses ``choices[0].text`` /
    ``finish_reason``. Lines arrive in ``order``, those of one time by the
    column ``arrival`` (their number in the stream); without one, a chunk at the
    marker's time counts as before it. Other columns are carried along.
    Marker times are a partial aggregate over the marker lines only, joined
    back by request.
    """
    payload = F.trim(F.substring(F.col(text_col), 7, F.lit(1 << 30)))
    d = lines.filter(F.col(text_col).startswith("data: ")).withColumn("_p", payload)
    place = F.struct(order, arrival) if arrival else F.struct(order)
    done = d.filter(F.col("_p") == "[DONE]").groupBy(request).agg(F.min(place).alias("_done"))
    d = join_keys(d, done, [request], "left").filter(F.col("_p") != "[DONE]")
    before = place < F.col("_done") if arrival else place <= F.col("_done")
    d = d.filter(F.col("_done").isNull() | before).drop("_done")
    return d.withColumn("delta", F.coalesce(F.get_json_object("_p", "$.choices[0].text"), F.lit(""))) \
            .withColumn("finish_reason", F.get_json_object("_p", "$.choices[0].finish_reason")).drop("_p")
