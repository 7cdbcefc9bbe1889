"""Registered queries: keyed response cache.

The current run requests one generation per (conversation, user turn) with
per-model decoding overrides; the cache holds a previous run's responses made
without overrides, so only requests whose effective parameters did not change
hit it.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from evalspark.functions import logprob as LP
from evalspark.operators import cache as C
from evalspark.plans import views as V
from evalspark.plans.queries_scoring import QA_STOPS
from evalspark.plans.registry import finish, register
from evalspark.session import ensure_checkpoint_dir


def _params_sql(with_override: bool) -> str:
    t_over = "CASE WHEN model = 'model-1' THEN 0.9 END, " if with_override else ""
    p_over = "CASE WHEN model = 'model-2' THEN 0.95 END, " if with_override else ""
    return ("'max_tokens=' || CAST(coalesce(CASE WHEN conv_id % 5 = 0 THEN 16 END, 256) AS VARCHAR)"
            " || ';stop=[' || chr(10) || ',.,?]'"
            f" || ';temperature=' || CAST(CAST(coalesce({t_over}CASE WHEN conv_id % 2 = 1 THEN 0.2 END, 0.0) AS DOUBLE) AS VARCHAR)"
            f" || ';top_p=' || CAST(CAST(coalesce({p_over}1.0) AS DOUBLE) AS VARCHAR)")


_REQ_SQL = f"""req AS (
  SELECT conv_id, turn, model, prompt, output, {_params_sql(True)} AS params FROM generations),
keyed AS (SELECT *, sha256(concat_ws(chr(31), 'v1', model, params, prompt)) AS key FROM req),
prev AS (
  SELECT sha256(concat_ws(chr(31), 'v1', model, {_params_sql(False)}, prompt)) AS key, model, prompt,
         json_object('text', output)::VARCHAR AS response, 1.0 AS created_at, 0 AS batch_id
  FROM generations)"""


def _requests(spark, sf, with_override: bool = True):
    g = V.generations(spark, sf)
    null_d = F.lit(None).cast("double")
    params = F.struct(
        LP.effective(F.lit(None).cast("int"), F.when(F.col("conv_id") % 5 == 0, 16), 256).alias("max_tokens"),
        F.array(*[F.lit(s) for s in QA_STOPS]).alias("stop"),
        LP.effective(F.when(F.col("model") == "model-1", 0.9) if with_override else null_d,
                     F.when(F.col("conv_id") % 2 == 1, 0.2), 0.0).alias("temperature"),
        LP.effective(F.when(F.col("model") == "model-2", 0.95) if with_override else null_d, null_d, 1.0
                     ).alias("top_p"),
    )
    r = g.withColumn("p", params)
    r = r.withColumn("params", C.canonical_params(r, "p")).drop("p")
    return r.withColumn("key", C.cache_key("model", "prompt", "params"))


def _prev_cache(spark, sf):
    r = _requests(spark, sf, with_override=False)
    return r.select("key", "model", "prompt", "params",
                    F.to_json(F.struct(F.col("output").alias("text"))).alias("response"),
                    F.lit(1.0).alias("created_at"), F.lit(0).cast("bigint").alias("batch_id"))


@register("c1_cache_key", f"""
WITH {_REQ_SQL}
SELECT conv_id, turn, params, key FROM keyed""", ["generations"])
def c1_cache_key(spark, sf):
    return finish(_requests(spark, sf).select("conv_id", "turn", "params", "key"))


@register("c2_cache_lookup", f"""
WITH {_REQ_SQL}
SELECT conv_id, turn, key IN (SELECT key FROM prev) AS hit FROM keyed""", ["generations"])
def c2_cache_lookup(spark, sf):
    prev = _prev_cache(spark, sf)
    versions = prev.unionByName(prev.withColumn("created_at", F.lit(0.5)))      # an older version of every key
    hits = C.lookup(_requests(spark, sf), versions)
    return finish(hits.select("conv_id", "turn", "hit"))


def _layered(spark, sf):
    """The previous run's responses as a base, every third again with a newer text, and later an older version."""
    store = C.LayeredCache(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/cache-{uuid.uuid4().hex}", buckets=8)
    prev = C.compact(_prev_cache(spark, sf))
    picked = prev.filter(F.ascii(F.substring("key", 1, 1)) % 3 == 0)
    store.write_delta(prev)
    store.compact()
    store.write_delta(picked.withColumn("response", F.lit('{"text":"newer"}')).withColumn("created_at", F.lit(2.0)))
    store.write_delta(picked.withColumn("response", F.lit('{"text":"older"}')).withColumn("created_at", F.lit(0.5)))
    return store


_LAYERED_SQL = f"""{_REQ_SQL},
latest AS (SELECT key, CASE WHEN ascii(substr(key, 1, 1)) % 3 = 0 THEN 'newer' ELSE 'first' END AS version FROM (SELECT DISTINCT key FROM prev))"""


@register("c2_layered_lookup", f"""
WITH {_LAYERED_SQL}
SELECT conv_id, turn, version IS NOT NULL AS hit, version FROM keyed LEFT JOIN latest USING (key)""", ["generations"])
def c2_layered_lookup(spark, sf):
    """C2 over a base and two deltas with several versions of a key."""
    hits = _layered(spark, sf).lookup(_requests(spark, sf))
    text = F.get_json_object("response", "$.text")
    version = F.when(text == "newer", text).when(F.col("response") == '{"text":"older"}', "older").when(F.col("hit"), "first")
    return finish(hits.select("conv_id", "turn", "hit", version.alias("version")))


@register("c4_layered_write_back", f"""
WITH {_LAYERED_SQL},
fresh AS (SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM latest))
SELECT key, 'computed' AS version, true AS in_last_layer FROM fresh UNION ALL SELECT key, version, false FROM latest""", ["generations"])
def c4_layered_write_back(spark, sf):
    """C4 and C6 over the layered store: the write-back's layer holds the new keys only; the read merges all."""
    store = _layered(spark, sf)
    _, merged = C.score_with_cache(_requests(spark, sf), store, _word_count_model, batch_id=1, created_at=F.lit(3.0))
    last = store.layers()[-1].select(F.col("key").alias("k"), F.lit(True).alias("in_last_layer"))
    text = F.get_json_object("response", "$.text")
    version = F.when(F.col("batch_id") == 1, "computed").when(F.col("created_at") == 2.0, text).when(F.col("created_at") == 1.0, "first")
    out = merged.join(last, F.col("key") == F.col("k"), "left")
    return finish(out.select("key", version.alias("version"), F.coalesce("in_last_layer", F.lit(False)).alias("in_last_layer")))


@register("c3_cache_misses", f"""
WITH {_REQ_SQL}
SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM prev)""", ["generations"])
def c3_cache_misses(spark, sf):
    return finish(C.misses(_requests(spark, sf), _prev_cache(spark, sf)).select("key"))


@register("c4_cache_upsert", f"""
WITH {_REQ_SQL},
both_ AS (SELECT key, batch_id, created_at FROM prev
          UNION ALL SELECT key, 1 AS batch_id, 2.0 AS created_at FROM keyed)
SELECT key, CAST(arg_max(batch_id, (created_at, batch_id)) AS BIGINT) AS batch_id FROM both_ GROUP BY key""",
          ["generations"])
def c4_cache_upsert(spark, sf):
    new = _requests(spark, sf).select(
        "key", "model", "prompt", "params", F.lit('{"text":"v2"}').alias("response"),
        F.lit(2.0).alias("created_at"), F.lit(1).cast("bigint").alias("batch_id"))
    return finish(C.upsert(_prev_cache(spark, sf), new).select("key", "batch_id"))


@register("c5_cache_stats", f"""
WITH {_REQ_SQL},
stored AS (SELECT model, CASE WHEN length(response) % 7 = 0 THEN substr(response, 1, length(response) - 1)
                              ELSE response END AS response FROM prev)
SELECT model, count(*) AS size, count(*) FILTER (WHERE NOT json_valid(response)) AS corrupt FROM stored GROUP BY model""",
          ["generations"])
def c5_cache_stats(spark, sf):
    c = _prev_cache(spark, sf)
    r = F.col("response")
    c = c.withColumn("response", F.when(F.length(r) % 7 == 0, F.expr("substring(response, 1, length(response) - 1)"))
                     .otherwise(r))
    return finish(C.cache_stats(c))


def _word_count_model(batches):
    """A stand-in model: the response text is the prompt's whitespace word count."""
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"],
                            "response": [json.dumps({"text": str(len(p.split()))}) for p in pdf["prompt"]]})


@register("c6_cached_scoring", f"""
WITH {_REQ_SQL},
prev1 AS (SELECT key, arg_max(response, (created_at, batch_id)) AS response FROM prev GROUP BY key)
SELECT k.conv_id, k.turn,
  CASE WHEN p.key IS NOT NULL THEN 'cache' ELSE 'computed' END AS source,
  CASE WHEN p.key IS NOT NULL THEN json_extract_string(p.response, '$.text')
       ELSE CAST(len(list_filter(regexp_split_to_array(k.prompt, '\\s+'), lambda w: w <> '')) AS VARCHAR) END AS value
FROM keyed k LEFT JOIN prev1 p ON k.key = p.key""", ["generations"])
def c6_cached_scoring(spark, sf):
    prev = C.compact(_prev_cache(spark, sf))
    results, _ = C.score_with_cache(_requests(spark, sf), prev, _word_count_model, batch_id=1,
                                    created_at=F.lit(2.0))
    return finish(results.select("conv_id", "turn", "source",
                                 F.get_json_object("response", "$.text").alias("value")))
