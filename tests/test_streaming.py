"""Streaming forms produce the batch results on the same rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import perf
from evalspark.streaming import requests as Z


def test_chunk_stream_equals_batch_fold(spark, scratch):
    rows = []
    for rid in range(20):
        base = 1_000 + rid * 7.0
        for j in range(5):
            rows.append((rid, base + j * 0.5, "" if j == 0 else f"tok{j} x"))
    rows.append((999, 10_000.0, "sentinel"))  # pushes the watermark past every real session
    df = spark.createDataFrame(rows, "request_id long, t double, delta string") \
        .select("request_id", F.timestamp_seconds("t").alias("ts"), "delta")
    src = f"{scratch}/chunks"
    df.repartition(3).write.parquet(src)

    stream = spark.readStream.schema(Z.CHUNK_SCHEMA).parquet(src)
    q = (Z.fold_chunk_stream(stream, gap="3 seconds", watermark="1 second")
         .writeStream.outputMode("append").format("memory").queryName("z1_out")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["request_id"]: r for r in spark.table("z1_out").collect()}

    batch_in = df.filter("request_id <> 999").select("request_id", (F.unix_micros("ts") / 1e6).alias("ts"), "delta")
    want = {r["request_id"]: r for r in perf.fold_chunks(batch_in).collect()}
    assert set(want) <= set(got)
    for rid, w in want.items():
        g = got[rid]
        assert g["output_tokens"] == w["output_tokens"]
        assert g["ttft_s"] == pytest.approx(w["ttft_s"])
        assert g["wall_s"] == pytest.approx(w["wall_s"])


def test_live_summary_counts_match_batch(spark, scratch):
    rows = [(i, 1_700_000_000.0 + i * 20.0, "short" if i % 2 else "long", "stream", 0.1 * (i % 7),
             "ok" if i % 5 else "error") for i in range(60)]
    df = spark.createDataFrame(rows, "idx long, t double, prompt_kind string, mode string, wall_s double, status string") \
        .select("*", F.timestamp_seconds("t").alias("ts"))
    src = f"{scratch}/req"
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (Z.live_summary(stream, "5 minutes", "0 seconds")
         .writeStream.outputMode("update").format("memory").queryName("z2_out")
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("z2_out").groupBy().agg(F.sum("n").alias("n"), F.sum("ok").alias("ok")).first()
    assert (got["n"], got["ok"]) == (60, 48)


def chunk_log(seed=3):
    """(request, seconds, seq, delta, done): requests of many shapes, with ties, replays and chunks after the marker."""
    rng, rows = random.Random(seed), []
    for request in range(25):
        t = 1000 + rng.random() * 20
        for seq in range(rng.randint(1, 12)):
            t += rng.choice([0.0, 0.25, 0.5])
            rows.append((request, round(t, 3), seq, rng.choice(["", "a b ", "c", None, "\u00e9 d\n"]), False))
        if request % 3:
            rows.append((request, round(t, 3), 50, "", True))
            if request % 2:
                rows.append((request, round(t, 3), 51, "after the end", False))
        rows += [r for r in rows if r[0] == request and rng.random() < 0.3]     # replays
    return rows


def test_keyed_state_equals_the_batch_fold(spark, scratch):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = chunk_log()
    rng = random.Random(1)
    pace = sorted(rows, key=lambda r: r[1] + rng.random() * 2)      # up to two seconds out of order
    kind = "request_id long, t double, seq long, delta string, done boolean"
    src, n = f"{scratch}/events", len(pace)
    late = [(1, 1000.0, 99, "far too late", False)]
    batches = [pace[:n // 3], pace[n // 3:2 * n // 3], pace[2 * n // 3:], [(999, 5000.0, 0, "x", False)], late, [(999, 9000.0, 1, "y", False)], [(999, 9500.0, 2, "z", False)]]
    stream = spark.readStream.schema(Z.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).select("request_id", F.timestamp_seconds("t").alias("ts"), "seq", "delta", "done").coalesce(1).write.parquet(f"{src}/{i:02d}")
        q = (Z.fold_stream(stream, gap="30 seconds", watermark="4 seconds").writeStream.outputMode("append").format("parquet")
             .option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
        q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/out").filter("request_id <> 999").collect()
    once = spark.createDataFrame(sorted({r for r in rows if not r[4]}, key=str), kind).withColumnRenamed("t", "ts")
    ends = {r[0]: r[1:3] for r in rows if r[4]}
    kept = once.filter("seq < 50")
    want = {r.request_id: r for r in perf.fold_chunks(kept).collect()}
    texts = {r.request_id: r.text for r in perf.fold_text(kept, "seq").collect()}
    final = {r.request_id: r for r in out if r.final}
    assert set(final) == set(want) and len([r for r in out if r.final]) == len(final) and ends
    for request, w in want.items():
        g = final[request]
        assert (g.output_tokens, g.n_chunks) == (w.output_tokens, w.n_chunks)
        assert (g.started_at, g.ended_at, g.wall_s) == pytest.approx((w.started_at, w.ended_at, w.wall_s))
        assert g.ttft_s == (w.ttft_s if w.ttft_s is None else pytest.approx(w.ttft_s))
        parts = sorted((r.part, r.text) for r in out if r.request_id == request)
        assert [p for p, _ in parts] == list(range(len(parts))) and "".join(t for _, t in parts) == texts[request]


def test_rollup_windows_are_close_to_exact_ranks(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(0, 4 * 3600), rng.choice("pq"), rng.choice(["ok"] * 9 + ["error"]), rng.choice([None, float("nan"), rng.expovariate(1), rng.expovariate(1)]))
            for _ in range(6000)]
    log = spark.createDataFrame(rows, "started_at double, prompt_kind string, status string, wall_s double")
    rollup = Z.latency_rollup(log).checkpoint()
    assert rollup.count() <= 2 * 240
    for window, slide in ((3600, None), (1800, 600)):
        got = Z.rollup_windows(rollup, window, slide).collect()
        for r in got:
            own = [x for x in rows if r.window_start <= x[0] < r.window_start + window and x[1] == r.prompt_kind]
            walls = sorted(x[3] for x in own if x[2] == "ok" and x[3] is not None and x[3] == x[3])
            assert (r.n, r.ok) == (len(own), sum(x[2] == "ok" for x in own))
            for p, v in ((0.5, r.wall_s_p50), (0.95, r.wall_s_p95), (0.99, r.wall_s_p99)):
                rank = sum(w <= v for w in walls) / len(walls)
                assert abs(rank - p) <= 0.02 + 1 / len(walls)
        step = slide or window
        assert {r.window_start for r in got} == {w for x in rows for w in range(int(x[0] // step) * step, int(x[0] - window) - 1, -step) if w <= x[0] < w + window}
