"""Streaming forms of the request-log operators.

All run on Structured Streaming sources (files, Kafka, ...) with event-time
watermarks, so state is bounded: a session or window is finalised and
dropped once the watermark passes it, and chunks later than the watermark
are discarded. Batch equivalents share the column logic.

Latency over time reads mergeable sketches: :func:`latency_rollup` stores one
KLL sketch per minute and key, :func:`rollup_windows` merges them to windows of
any length, so overlapping windows and later questions don't read the log
again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evalspark.functions.quantiles import exact_percentiles, percentile_names
from evalspark.functions.joins import join_keys

CHUNK_SCHEMA = "request_id bigint, ts timestamp, delta string"


def _nonempty():
    return F.col("delta").isNotNull() & (F.col("delta") != "")


def _words(c: str):
    return F.size(F.filter(F.split(F.col(c), r"\s+"), lambda x: x != ""))


def fold_chunk_stream(chunks: DataFrame, gap: str = "30 seconds", watermark: str = "2 minutes") -> DataFrame:
    """Token-chunk events → one row per request session (append mode).

    A request's chunks form a session (no gap longer than ``gap``); its row is
    emitted once the watermark passes the session end. Columns match the
    batch fold (L13): start = first chunk, TTFT to the first non-empty delta,
    tokens = sum of max(1, words) over non-empty deltas, wall = last - first.
    """
    epoch = lambda c: F.unix_micros(F.col(c)) / F.lit(1e6)
    agg = (
        chunks.withWatermark("ts", watermark)
        .groupBy("request_id", F.session_window("ts", gap).alias("session"))
        .agg(
            F.min("ts").alias("_first"),
            F.max("ts").alias("_last"),
            F.min(F.when(_nonempty(), F.col("ts"))).alias("_first_tok"),
            F.sum(F.when(_nonempty(), F.greatest(F.lit(1), _words("delta"))).otherwise(0)).cast("bigint")
            .alias("output_tokens"),
            F.count("*").alias("n_chunks"),
        )
    )
    return agg.select(
        "request_id",
        epoch("_first").alias("started_at"),
        epoch("_last").alias("ended_at"),
        (epoch("_first_tok") - epoch("_first")).alias("ttft_s"),
        (epoch("_last") - epoch("_first")).alias("wall_s"),
        "output_tokens", "n_chunks",
    )


EVENT_SCHEMA = "request_id bigint, ts timestamp, seq bigint, delta string, done boolean"
PART_SCHEMA = ("request_id bigint, part bigint, text string, final boolean, started_at double, ended_at double, "
               "ttft_s double, wall_s double, output_tokens bigint, n_chunks bigint")


def chunk_events(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Server-sent-event lines (request_id, ts timestamp, seq, text) as events of :func:`fold_stream`, markers included."""
    payload = F.trim(F.substring(F.col(text_col), 7, F.lit(1 << 30)))
    return lines.filter(F.col(text_col).startswith("data: ")).select(
        "request_id", "ts", "seq", F.coalesce(F.get_json_object(payload, "$.choices[0].text"), F.lit("")).alias("delta"),
        (payload == "[DONE]").alias("done"))


class ChunkFold(StatefulProcessor):
    """Folds one request's chunks in (ts, seq) order as the watermark passes them.

    ``waiting`` holds what is newer than the watermark, keyed by (ts, seq), so a
    replayed chunk is stored once; one older than the watermark is dropped by
    the watermark itself. A timer folds what the watermark has passed: numbers
    are added up and the text leaves as a part. State is therefore the chunks of
    one watermark delay and eight numbers, however long a request runs.
    """

    NUMBERS = ["first", "last", "first_token", "tokens", "chunks", "parts", "done", "seen"]

    def __init__(self, gap_ms: int) -> None:
        self.gap_us = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us bigint, seq bigint", "delta string, done boolean")
        self.sums = handle.getValueState("sums", ", ".join(f"{n} bigint" for n in self.NUMBERS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums = self._load()
        for frame in rows:
            us = frame["ts"].astype("datetime64[us]").astype("int64")
            for t, seq, delta, done in zip(us, frame["seq"], frame["delta"], frame["done"]):
                self.waiting.updateValue((int(t), int(seq)), (delta or "", bool(done)))
                sums["seen"] = max(sums["seen"] or 0, int(t))
        self._store(sums)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        first = min(k[0] for k in self.waiting.keys())
        self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        sums, text = self._load(), []
        ready = sorted(k for k in self.waiting.keys() if k[0] <= now)
        for place in ready:
            delta, done = self.waiting.getValue(place)
            self.waiting.removeKey(place)
            if sums["done"]:
                continue
            if done:
                sums["done"] = 1
                continue
            sums["first"] = place[0] if sums["first"] is None else sums["first"]
            sums["last"] = place[0]
            sums["chunks"] = (sums["chunks"] or 0) + 1
            if delta:
                sums["first_token"] = place[0] if sums["first_token"] is None else sums["first_token"]
                sums["tokens"] = (sums["tokens"] or 0) + max(1, len(delta.split()))
                text.append(delta)
        left = sorted(k[0] for k in self.waiting.keys())
        idle = not left and now >= (sums["seen"] or 0) + self.gap_us
        over = idle and sums["done"] != 2 or (sums["done"] == 1)
        out = [self._row(key[0], sums, "".join(text), over)] if (text or over) and sums["first"] is not None else []
        sums["parts"] = (sums["parts"] or 0) + len(out)
        if sums["done"]:
            sums["done"] = 2        # reported; kept until the gap has passed, so that late chunks don't start anew
        if idle:
            self.waiting.clear()
            self.sums.clear()
        else:
            self._store(sums)
            self.handle.registerTimer((left[0] if left else sums["seen"] + self.gap_us) // 1000 + 1)
        return iter(out)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        return dict(zip(self.NUMBERS, self.sums.get())) if self.sums.exists() else dict.fromkeys(self.NUMBERS)

    def _store(self, sums: dict) -> None:
        self.sums.update(tuple(sums[n] for n in self.NUMBERS))

    def _row(self, request, sums: dict, text: str, final: bool) -> pd.DataFrame:
        sec = lambda us: us / 1e6
        numbers = [None] * 6
        if final:
            first, last, token = sums["first"], sums["last"], sums["first_token"]
            numbers = [sec(first), sec(last), None if token is None else sec(token) - sec(first), sec(last) - sec(first), sums["tokens"] or 0, sums["chunks"]]
        row = [request, sums["parts"] or 0, text, final, *numbers]
        frame = pd.DataFrame([row], columns=[c.split()[0] for c in PART_SCHEMA.split(", ")])
        return frame.astype({"output_tokens": "Int64", "n_chunks": "Int64", "ttft_s": "float64", "started_at": "float64", "ended_at": "float64", "wall_s": "float64"})


def fold_stream(events: DataFrame, gap: str = "30 seconds", watermark: str = "2 minutes") -> DataFrame:
    """Chunk events → text parts as they come, and one final row per request (keyed state, append mode).

    ``events`` has the columns of EVENT_SCHEMA (see :func:`chunk_events`). A
    request ends at its ``[DONE]`` event, later chunks are ignored, or when
    ``gap`` has passed since its last chunk. Rows (request_id, part, text, final, ...):
    the parts' texts in order of ``part`` are the request's text; the row
    with ``final`` also has the numbers of the batch fold (L13). Chunks of
    one time go by ``seq``; a replayed (ts, seq) counts once. Needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    return (events.withWatermark("ts", watermark).groupBy("request_id")
            .transformWithStateInPandas(ChunkFold(gap_ms), PART_SCHEMA, outputMode="append", timeMode="eventTime"))


def live_summary(requests: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes",
                 keys: Sequence[str] = ("prompt_kind", "mode"), ts: str = "ts", accuracy: int = 10_000,
                 slide: str | None = None) -> DataFrame:
    """Per window and key, request counts and approximate latency percentiles.

    Windows are tumbling, or sliding by ``slide``.

    Streams keep bounded state per window, hence ``approx_percentile``; the
    batch form :func:`windowed_summary` computes exact percentiles.
    """
    ok = F.col("status") == "ok"
    return (
        requests.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window, slide).alias("w"), *keys)
        .agg(
            F.count("*").alias("n"),
            F.count_if(ok).alias("ok"),
            F.percentile_approx(F.when(ok, F.col("wall_s")), [0.5, 0.95, 0.99], accuracy).alias("_p"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "n", "ok",
                F.col("_p")[0].alias("wall_s_p50"), F.col("_p")[1].alias("wall_s_p95"),
                F.col("_p")[2].alias("wall_s_p99"))
    )


def windowed_summary(requests: DataFrame, window_s: int = 3600, keys: Sequence[str] = ("prompt_kind",),
                     slide_s: int | None = None, ps: Sequence[float] = (0.5, 0.95, 0.99), prefix: str = "wall_s_") -> DataFrame:
    """Z2 batch form: per window of ``started_at`` (epoch s) and key, exact percentiles.

    Windows start at multiples of ``slide_s`` (the window length if not given);
    a request counts in each window that covers its start.
    """
    step = slide_s or window_s
    last = (F.floor(F.col("started_at") / F.lit(step)) * F.lit(step)).cast("bigint")
    first = ((F.floor((F.col("started_at") - window_s) / F.lit(step)) + 1) * F.lit(step)).cast("bigint")
    d = requests.withColumn("window_start", last if step == window_s else F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))))
    k = ["window_start", *keys]
    ok = F.col("status") == "ok"
    counts = d.groupBy(*k).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    names = percentile_names(ps, prefix)
    out = join_keys(counts, exact_percentiles(d.filter(ok), k, "wall_s", ps, prefix=prefix), k, "left")
    return out.select(*k, "n", "ok", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names])


def latency_rollup(requests: DataFrame, value: str = "wall_s", keys: Sequence[str] = ("prompt_kind",), step_s: int = 60,
                   k: int = 800) -> DataFrame:
    """Z2 roll-up: (minute, keys, n, ok, sketch): counts and a KLL sketch of the ok rows' latency per step of ``step_s``.

    Sketches merge, so the table can be stored, added to and read for any
    window that is a multiple of the step. Its rows don't grow with the
    number of requests. Null and NaN latencies count in n and ok only.
    """
    ok = F.col("status") == "ok"
    x = F.col(value).cast("double")
    minute = (F.floor(F.col("started_at") / F.lit(step_s)) * F.lit(step_s)).cast("bigint")
    return requests.groupBy(minute.alias("minute"), *keys).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("ok"),
        F.kll_sketch_agg_double(F.when(ok & ~F.isnan(x), x), F.lit(k)).alias("sketch"))


def rollup_windows(rollup: DataFrame, window_s: int = 3600, slide_s: int | None = None, keys: Sequence[str] = ("prompt_kind",),
                   ps: Sequence[float] = (0.5, 0.95, 0.99), prefix: str = "wall_s_", k: int = 800) -> DataFrame:
    """Z2 from the roll-up: per window and key the counts and approximate percentiles, merged from stored sketches.

    Windows start at multiples of ``slide_s`` (the window length if not
    given), which is a multiple of the roll-up's step. A window without
    a latency has null percentiles.
    """
    step = slide_s or window_s
    last = (F.floor(F.col("minute") / F.lit(step)) * F.lit(step)).cast("bigint")
    first = ((F.floor((F.col("minute") - window_s) / F.lit(step)) + 1) * F.lit(step)).cast("bigint")
    merged = (rollup.withColumn("window_start", F.explode(F.sequence(first, last, F.lit(step).cast("bigint"))))
              .groupBy("window_start", *keys).agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")))
    some = F.kll_sketch_get_n_double("sketch") > 0
    return merged.select("window_start", *keys, "n", "ok",
                         *[F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(f"{prefix}p{p * 100:g}".replace(".", "_")) for p in ps])
