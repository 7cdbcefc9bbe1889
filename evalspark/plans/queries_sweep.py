"""Registered queries: decoding sweeps and answer-level levers."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions import logprob as LP
from evalspark.functions.text import truncate_at_stops, words
from evalspark.operators import cache as C
from evalspark.operators import extras, scoring, sweep
from evalspark.plans import sql_fragments as Q
from evalspark.plans import views as V
from evalspark.plans.queries_compare import _PRED_SQL, _results
from evalspark.plans.queries_scoring import _ABL_SQL, QA_STOPS, _trunc_sql
from evalspark.plans.registry import finish, register

# The default sweep grid: 3 temperatures × 3 nucleus thresholds × top-k off.
GRID = {"temperatures": "0.0,0.3,0.7", "top_ps": "0.9,0.95,1.0", "top_ks": "0"}
PREFIX = "Repeat: "
FAILING = (0.7, 0.95)


def _repeat_model(batches):
    """Stand-in generator: repeats the first words of the text after the prefix.

    Fewer words at higher temperature (``max(1, 3 - floor(3t))``); a trailing
    period when ``top_p < 1``. Reads the decoding params from the request. In
    one cell it fails on every text of odd length, and takes its whole batch along.
    """
    for pdf in batches:
        out = []
        for prompt, params in zip(pdf["prompt"], pdf["params"]):
            kv = dict(x.split("=", 1) for x in params.split(";"))
            t, p = float(kv["temperature"]), float(kv["top_p"])
            if (t, p) == FAILING and len(prompt) % 2:
                raise RuntimeError("out of memory")
            n = max(1, 3 - math.floor(t * 3))
            text = " ".join(prompt[len(PREFIX):].split()[:n]) + ("." if p < 1 else "")
            out.append(json.dumps({"text": text}))
        yield pd.DataFrame({"key": pdf["key"], "response": out})


_CELLS_SQL = """SELECT 'sweep_t' || t || '_p' || p || '_k0' AS cell, t::DOUBLE AS temperature, p::DOUBLE AS top_p, 0 AS top_k
  FROM (VALUES ('0'), ('0.3'), ('0.7')) a(t) CROSS JOIN (VALUES ('0.9'), ('0.95'), ('1')) b(p)"""


@register("w4_sweep", f"""
WITH q AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, output, answer
           FROM generations JOIN qa_items ON CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) = qa_items.qid),
cells AS ({_CELLS_SQL}),
x AS (SELECT q.*, c.* FROM q CROSS JOIN cells c),
gen AS (SELECT *, array_to_string({Q.words('output')}[1:greatest(1, 3 - CAST(floor(temperature * 3) AS INTEGER))], ' ')
                  || CASE WHEN top_p < 1 THEN '.' ELSE '' END AS text FROM x),
res AS (SELECT cell, temperature, top_p, top_k,
               temperature = {FAILING[0]} AND top_p = {FAILING[1]} AND length(output) % 2 = {(1 + len(PREFIX)) % 2} AS lost,
               {Q.normalise_answer(_trunc_sql('text'))} = {Q.normalise_answer('answer')} AS correct FROM gen)
SELECT cell, round(temperature, 9) AS temperature, round(top_p, 9) AS top_p, CAST(top_k AS BIGINT) AS top_k,
  count(*) AS n, count(*) FILTER (WHERE correct AND NOT lost) AS n_correct,
  round(coalesce(avg(CASE WHEN NOT lost THEN CAST(correct AS DOUBLE) END), 0.0), 9) AS accuracy,
  count(*) FILTER (WHERE lost) AS errors, bool_or(lost) AS failed, false AS loglik_only
FROM res GROUP BY ALL""", ["qa_items"])
def w4_sweep(spark, sf):
    sweep.check_task("custom_qa")
    g = V.generations(spark, sf).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"), "output")
    items = g.join(V.qa_items(spark, sf).select("qid", "answer"), "qid")
    x = sweep.with_cells(items, **GRID)
    params = F.struct(F.lit(16).alias("max_tokens"), F.array(*[F.lit(s) for s in QA_STOPS]).alias("stop"),
                      F.col("temperature").alias("temperature"), F.col("top_k").alias("top_k"),
                      F.col("top_p").alias("top_p"))
    r = x.withColumn("p", params)
    r = (r.withColumn("params", C.canonical_params(r, "p")).drop("p")
         .withColumn("model", F.lit("m-sweep")).withColumn("prompt", F.concat(F.lit(PREFIX), "output"))
         .withColumn("key", C.cache_key("model", "prompt", "params")))
    empty = spark.createDataFrame([], schemas.CACHE)
    results, _ = C.score_with_cache(r, empty, _repeat_model, batch_id=1, created_at=F.lit(1.0))
    pred = truncate_at_stops(F.get_json_object("response", "$.text"), F.array(*[F.lit(s) for s in QA_STOPS]))
    scored = results.withColumn("correct", scoring.exact_match(pred, F.col("answer")))
    out = sweep.summarise_cells(scored).withColumn("loglik_only", sweep.is_loglikelihood_only(F.lit("custom_qa")))
    return finish(out)


@register("x1_majority_vote", """
WITH c AS (SELECT prompt, text, count(*) AS votes, min(run) AS first_sample FROM repeats GROUP BY prompt, text)
SELECT prompt, arg_max(text, (votes, -first_sample)) AS answer, max(votes) AS votes, CAST(sum(votes) AS BIGINT) AS n_samples
FROM c GROUP BY prompt""", ["repeats"])
def x1_majority_vote(spark, sf):
    r = V.repeats(spark, sf)
    return finish(extras.majority_vote(r, "prompt", "text", "run"))


@register("x2_prompt_ensemble", f"""
WITH {_ABL_SQL},
ens AS (SELECT ind, option, round((score_sum + score_length_norm + score_byte_norm) / 3.0, 9) AS score FROM modes),
r AS (SELECT *, row_number() OVER (PARTITION BY ind ORDER BY score DESC, option) AS rn FROM ens)
SELECT r.ind, CAST(r.option AS BIGINT) AS predicted, CAST(i.label AS BIGINT) AS label, r.option = i.label AS correct
FROM r JOIN items i ON r.ind = i.ind WHERE rn = 1""", ["lp_tokens"])
def x2_prompt_ensemble(spark, sf):
    s = scoring.option_scores(V.logprob_payloads(spark, sf))
    long = s.select("ind", "option", F.explode(F.array(*[F.col(f"score_{m}") for m in LP.SCORING_MODES])).alias("score"))
    pred = extras.ensemble_scores(long, ("ind", "option"), "score", digits=9)
    out = scoring.mark_correct(pred, V.items(spark, sf).select("ind", "label"))
    return finish(out.select("ind", "predicted", "label", "correct"))


@register("x3_regex_extract", f"""
WITH e AS (
  SELECT g.model, regexp_extract(g.output, '([A-Za-z0-9]+)', 1) AS extracted,
         {Q.words('q.answer')}[1] AS first_word
  FROM generations g JOIN qa_items q ON CAST(g.conv_id AS VARCHAR) || '-' || CAST(g.turn AS VARCHAR) = q.qid)
SELECT model, count(*) AS n,
  count(*) FILTER (WHERE {Q.normalise_answer('extracted')} = {Q.normalise_answer("coalesce(first_word, '')")}) AS hits
FROM e GROUP BY model""", ["qa_items"])
def x3_regex_extract(spark, sf):
    g = V.generations(spark, sf).select(
        "model", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        extras.extract_answer("output", "([A-Za-z0-9]+)").alias("extracted"))
    qa = V.qa_items(spark, sf).select("qid", F.coalesce(F.try_element_at(words("answer"), F.lit(1)), F.lit("")).alias("fw"))
    j = g.join(qa, "qid").withColumn("hit", scoring.exact_match(F.col("extracted"), F.col("fw")))
    return finish(j.groupBy("model").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")))


_CONF_TAIL = """sm AS (SELECT ind, option, exp(score_length_norm - max(score_length_norm) OVER (PARTITION BY ind)) AS e FROM modes),
pr AS (SELECT ind, option, e / sum(e) OVER (PARTITION BY ind) AS p FROM sm),
rk AS (SELECT *, row_number() OVER (PARTITION BY ind ORDER BY p DESC) AS r FROM pr),
conf AS (SELECT ind, max(p) AS p_max, max(p) - coalesce(max(p) FILTER (WHERE r = 2), 0.0) AS margin,
                -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END) AS entropy FROM rk GROUP BY ind)"""
_CONF_SQL = f"{_ABL_SQL},\n{_CONF_TAIL}"


@register("x4_confidence", f"""
WITH {_CONF_SQL}
SELECT ind, round(p_max, 9) AS p_max, round(margin, 9) AS margin, round(entropy, 9) AS entropy FROM conf""",
          ["lp_tokens"])
def x4_confidence(spark, sf):
    s = scoring.option_scores(V.logprob_payloads(spark, sf))
    arr = s.groupBy("ind").agg(F.transform(F.array_sort(F.collect_list(F.struct("option", "score_length_norm"))),
                                           lambda x: x.getField("score_length_norm")).alias("scores"))
    return finish(arr.select("ind", *extras.confidence("scores")))


THRESHOLDS = [0.25, 0.3, 0.4, 0.5]


@register("x4_coverage_curve", f"""
WITH {_PRED_SQL},
{_CONF_TAIL},
preds AS (SELECT * FROM results WHERE variant = 'length_norm'),
j AS (SELECT c.p_max, p.correct FROM conf c JOIN preds p ON c.ind = p.ind),
t AS (SELECT * FROM (VALUES {", ".join(f"({x!r}::DOUBLE)" for x in THRESHOLDS)}) v(threshold))
SELECT threshold, round(avg(CAST(p_max >= threshold AS DOUBLE)), 9) AS coverage,
  round(avg(CASE WHEN p_max >= threshold THEN CAST(correct AS DOUBLE) END), 9) AS accuracy,
  count(*) FILTER (WHERE p_max >= threshold) AS kept
FROM j CROSS JOIN t GROUP BY threshold""", ["lp_tokens"])
def x4_coverage_curve(spark, sf):
    return finish(extras.coverage_curve(_confident(spark, sf), THRESHOLDS))


def _confident(spark, sf):
    """(ind, p_max, margin, entropy, correct): confidence and prediction from one pass over the payloads."""
    s = scoring.option_scores(V.logprob_payloads(spark, sf)).select("ind", "option", "score_length_norm").checkpoint()
    arr = s.groupBy("ind").agg(F.transform(F.array_sort(F.collect_list(F.struct("option", "score_length_norm"))),
                                           lambda x: x.getField("score_length_norm")).alias("scores"))
    conf = arr.select("ind", *extras.confidence("scores"))
    pred = scoring.predict_long(s.withColumnRenamed("score_length_norm", "score"), "score", ["ind"])
    flags = scoring.mark_correct(pred, V.items(spark, sf).select("ind", "label")).select("ind", "correct")
    return conf.join(flags, "ind")


@register("x4_risk_coverage", f"""
WITH {_PRED_SQL},
{_CONF_TAIL},
j AS (SELECT round(c.p_max, 9) AS threshold, count(*) AS n, count(*) FILTER (WHERE p.correct) AS y
      FROM conf c JOIN results p ON c.ind = p.ind WHERE p.variant = 'length_norm' GROUP BY 1),
k AS (SELECT threshold, n, sum(n) OVER w AS kept, sum(y) OVER w AS hits FROM j WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, CAST(kept AS BIGINT) AS kept, round(kept / sum(n) OVER (), 9) AS coverage, round(hits / kept, 9) AS accuracy,
  round(sum(n * (1 - hits / kept)) OVER () / sum(n) OVER (), 9) AS area
FROM k""", ["lp_tokens"])
def x4_risk_coverage(spark, sf):
    """The curve over every distinct confidence, and the area under it."""
    conf = _confident(spark, sf).select(F.round("p_max", 9).alias("p_max"), "correct")
    return finish(extras.risk_coverage(conf))
