"""Keyed response cache."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.operators import cache as C

REQ = "model string, prompt string, p struct<temperature:double, max_tokens:int, stop:array<string>>"


def _requests(spark, rows, version=C.CACHE_VERSION):
    df = spark.createDataFrame(rows, REQ)
    df = df.withColumn("params", C.canonical_params(df, "p")).drop("p")
    return df.withColumn("key", C.cache_key("model", "prompt", "params", version))


def _cache_rows(spark, req, response, created, batch):
    return req.select("key", "model", "prompt", "params", F.lit(response).alias("response"),
                      F.lit(float(created)).alias("created_at"), F.lit(batch).cast("bigint").alias("batch_id"))


def test_key_is_canonical_and_versioned(spark):
    a = _requests(spark, [("m", "hi", (0.0, 16, ["\n"]))])
    b = _requests(spark, [("m", "hi", (0.0, 16, ["\n"]))])
    c = _requests(spark, [("m", "hi", (0.0, 16, ["\n"]))], version="v2")
    assert a.first()["params"] == "max_tokens=16;stop=[\n];temperature=0.0"
    assert a.first()["key"] == b.first()["key"] != c.first()["key"]


def test_roundtrip_lookup_miss_and_replace(spark, scratch):
    req = _requests(spark, [("m", "a", (0.0, 8, [])), ("m", "b", (0.0, 8, [])), ("m", "b", (0.0, 8, []))])
    cache = _cache_rows(spark, req.filter(F.col("prompt") == "a"), '{"text": "old"}', 1, 0)
    hits = {r["prompt"]: r["hit"] for r in C.lookup(req, cache).collect()}
    assert hits == {"a": True, "b": True} or hits == {"a": True, "b": False}
    assert C.misses(req, cache).count() == 1  # one per distinct key
    new = _cache_rows(spark, req.filter(F.col("prompt") == "a"), '{"text": "new"}', 2, 1)
    merged = C.upsert(cache, new).collect()
    assert len(merged) == 1 and json.loads(merged[0]["response"])["text"] == "new"
    C.write_snapshot(C.upsert(cache, new), f"{scratch}/snap1")
    back = C.read_snapshot(spark, f"{scratch}/snap1", ["m"]).collect()
    assert len(back) == 1 and back[0]["model"] == "m"


def test_corrupt_entries(spark):
    rows = [("k1", "m", "p", "", '{"text": "ok"}', 1.0, 0), ("k2", "m", "p", "", '{"text": ', 1.0, 0)]
    cache = spark.createDataFrame(rows, schemas.CACHE)
    assert [r["key"] for r in C.corrupt_entries(cache).collect()] == ["k2"]
    s = C.cache_stats(cache).first()
    assert (s["size"], s["corrupt"]) == (2, 1)



def _model(batches):
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "response": [json.dumps({"text": p.upper()}) for p in pdf["prompt"]]})


def test_score_with_cache_computes_each_miss_once(spark):
    req = _requests(spark, [("m", "a", (0.0, 8, [])), ("m", "b", (0.0, 8, [])), ("m", "b", (0.0, 8, []))])
    cache = _cache_rows(spark, req.filter(F.col("prompt") == "a").limit(1), '{"text": "cached"}', 1, 0)
    results, new_cache = C.score_with_cache(req, cache, _model, batch_id=1, created_at=F.lit(2.0))
    got = sorted((r["prompt"], r["source"], json.loads(r["response"])["text"]) for r in results.collect())
    assert got == [("a", "cache", "cached"), ("b", "computed", "B"), ("b", "computed", "B")]
    assert new_cache.count() == 2


def _rows(spark, versions):
    """Cache rows of (key, created_at, batch_id, text)."""
    return spark.createDataFrame([(k, "m", "p" + k, "", json.dumps({"text": t}), float(c), b) for k, c, b, t in versions], schemas.CACHE)


def _asked(spark, keys):
    return spark.createDataFrame([(i, k, "m", "p" + k, "") for i, k in enumerate(keys)], "i int, key string, model string, prompt string, params string")


def test_lookup_takes_the_newest_version_once_per_request(spark):
    cache = _rows(spark, [("a", 1, 0, "old"), ("a", 3, 0, "new"), ("a", 3, 0, "new"), ("b", 1, 1, "first"), ("b", 1, 2, "second")])
    got = sorted((r.i, r.hit, r.response and json.loads(r.response)["text"]) for r in C.lookup(_asked(spark, ["a", "b", "a", "z"]), cache).collect())
    assert got == [(0, True, "new"), (1, True, "second"), (2, True, "new"), (3, False, None)]


def test_layers_read_like_one_table(spark, scratch):
    store = C.LayeredCache(spark, f"{scratch}/cache", buckets=4)
    asked = _asked(spark, ["a", "b", "c", "zz", "a"])
    assert store.read().count() == 0 and not any(r.hit for r in store.lookup(asked).collect()) and store.misses(asked).count() == 4
    deltas = [[(k, 1, 0, "base") for k in "abcdefgh"], [("a", 5, 1, "a5"), ("x", 5, 1, "x5")], [("a", 2, 2, "a2"), ("b", 9, 2, "b9"), ("b", 8, 2, "b8")]]
    for d in deltas:
        store.write_delta(_rows(spark, d))
    flat = [v for d in deltas for v in d]
    want = {k: max((c, b, t) for q, c, b, t in flat if q == k)[2] for k in {v[0] for v in flat}}

    def seen(cache):
        assert {r.key: json.loads(r.response)["text"] for r in cache.read().collect()} == want and cache.read().count() == len(want)
        got = sorted((r.i, r.hit, r.response and json.loads(r.response)["text"]) for r in cache.lookup(asked).collect())
        assert got == [(0, True, "a5"), (1, True, "b9"), (2, True, "base"), (3, False, None), (4, True, "a5")]
        assert [r.key for r in cache.misses(asked).collect()] == ["zz"]

    seen(store)
    assert [x.count() for x in store.layers()] == [8, 2, 2]
    store.compact()
    assert len(store.layers()) == 1
    seen(C.LayeredCache(spark, f"{scratch}/cache"))       # another reader finds buckets and layers in the manifest
    store.write_delta(_rows(spark, [("a", 4, 3, "late")]))
    seen(store)


def test_a_lookup_shuffles_the_requests_only(spark, scratch):
    store = C.LayeredCache(spark, f"{scratch}/cache", buckets=4)
    for c in (1, 2):
        store.write_delta(_rows(spark, [(f"k{i}", c, c, "t") for i in range(50)]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.lookup(_asked(spark, ["k1", "k2"]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2


def _fragile(batches):
    for pdf in batches:
        if any("bad" in p for p in pdf["prompt"]):
            raise ValueError("no such prompt")
        if any("flaky" in p for p in pdf["prompt"]):
            pdf = pdf[~pdf["prompt"].str.contains("flaky")]
        yield pd.DataFrame({"key": pdf["key"], "response": [json.dumps({"text": p.upper()}) for p in pdf["prompt"]]})


def test_a_failing_request_stands_alone(spark, scratch):
    asked = _requests(spark, [("m", p, (0.0, 8, [])) for p in ["bad one", "a", "b", "bad two", "c", "flaky", "a"]]).coalesce(1)
    store = C.LayeredCache(spark, f"{scratch}/cache", buckets=2)
    empty = spark.createDataFrame([], schemas.CACHE)
    for cache in (empty, store):
        results, stored = C.score_with_cache(asked, cache, _fragile, batch_id=1, created_at=F.lit(1.0), retries=2)
        got = sorted((r.prompt, r.source, r.response and json.loads(r.response)["text"], r.error, r.attempts) for r in results.collect())
        assert got == [("a", "computed", "A", None, 1), ("a", "computed", "A", None, 1), ("b", "computed", "B", None, 1),
                       ("bad one", "failed", None, "ValueError: no such prompt", 3), ("bad two", "failed", None, "ValueError: no such prompt", 3),
                       ("c", "computed", "C", None, 1), ("flaky", "failed", None, "the model gave no response", 1)]
        assert sorted(r.prompt for r in stored.collect()) == ["a", "b", "c"]      # failures aren't cached
    again, _ = C.score_with_cache(asked, store, _model, batch_id=2, created_at=F.lit(2.0))
    assert {(r.prompt, r.source) for r in again.collect()} == {("a", "cache"), ("b", "cache"), ("c", "cache"), ("bad one", "computed"), ("bad two", "computed"), ("flaky", "computed")}


def test_failing_requests_make_no_frames_of_their_own():
    """A batch comes back as one frame, however often it was halved."""
    def model(batches):
        for pdf in batches:
            if any(int(k) % 18 == 5 for k in pdf["key"]):
                raise RuntimeError("out of memory")
            yield pd.DataFrame({"key": pdf["key"], "response": [None if k == "7" else "r" + k for k in pdf["key"]]})

    asked = pd.DataFrame({"key": [str(i) for i in range(100)], "model": "m", "prompt": "p", "params": "x"}, index=range(50, 150))
    parts = list(C.isolated(model, asked, retries=2))
    assert len(parts) == 1
    got = {r.key: (r.response, r.error, r.attempts) for r in parts[0].itertuples()}
    fails = {str(i): (None, "RuntimeError: out of memory", 3) for i in range(5, 100, 18)}
    assert got == {str(i): ("r" + str(i), None, 1) for i in range(100)} | {"7": (None, "the model gave no response", 1)} | fails
