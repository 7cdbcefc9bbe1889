"""Registered queries: token and log-prob scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import logprob as LP
from evalspark.functions.text import truncate_at_stops, word_count
from evalspark.operators import scoring
from evalspark.plans import sql_fragments as Q
from evalspark.plans import views as V
from evalspark.plans.registry import finish, register
from evalspark.sources.readers import read_table


@register("l1_word_count", f"""
SELECT doc_id, CAST({Q.word_count('text')} AS BIGINT) AS n_words FROM documents""")
def l1_word_count(spark, sf):
    d = read_table(spark, sf, "documents")
    return finish(d.select("doc_id", word_count("text").alias("n_words")))


_CONT = f"(' ' || {Q.lstrip_ws('o.ending')})"
_SC_SQL = f"""sc AS (
  SELECT o.ind, o.option, {_CONT} AS cont, {Q.word_count('o.ctx')} AS n_ctx,
         {Q.word_count("o.ctx || " + _CONT)} AS n_full
  FROM options o),
lp AS (SELECT s.*, l.pos, l.n_tok, l.lp, l.alt_lp FROM sc s JOIN lp_long l ON s.ind = l.ind AND s.option = l.option)"""


@register("l2_cont_len", f"""
WITH {_SC_SQL}
SELECT ind, CAST(option AS BIGINT) AS option, CAST(n_ctx AS BIGINT) AS n_ctx, CAST(n_full AS BIGINT) AS n_full,
  CAST(greatest(0, n_full - n_ctx) AS BIGINT) AS n_cont_eval,
  CAST(greatest(1, CASE WHEN max(n_tok) > 0 THEN least(max(n_tok), n_full - n_ctx) ELSE n_full - n_ctx END) AS BIGINT)
    AS n_cont_ablation
FROM lp GROUP BY ind, option, n_ctx, n_full""", ["lp_tokens"])
def l2_cont_len(spark, sf):
    p = scoring.with_continuation(V.logprob_payloads(spark, sf))
    return finish(p.select(
        "ind", "option", "n_ctx", "n_full",
        LP.cont_len_eval("n_ctx", "n_full").alias("n_cont_eval"),
        LP.cont_len_ablation("n_ctx", "n_full", F.size("tokens")).alias("n_cont_ablation"),
    ))


@register("l4_l5_loglikelihood", f"""
WITH {_SC_SQL}, x AS (SELECT *, greatest(0, n_full - n_ctx) AS n_cont FROM lp)
SELECT ind, CAST(option AS BIGINT) AS option, CAST(n_cont AS BIGINT) AS n_cont,
  round(CASE WHEN n_cont = 0 THEN 0.0 ELSE coalesce(sum(lp) FILTER (WHERE pos >= n_tok - n_cont), 0.0) END, 9) AS ll,
  CASE WHEN n_cont = 0 THEN true
       ELSE coalesce(bool_and(lp >= alt_lp) FILTER (WHERE pos >= n_tok - n_cont AND pos > 0), true) END AS is_greedy
FROM x GROUP BY ind, option, n_cont""", ["lp_tokens"])
def l4_l5_loglikelihood(spark, sf):
    return finish(scoring.loglikelihood_eval(V.logprob_payloads(spark, sf)))


@register("l6_rolling_loglikelihood", """
SELECT ind, CAST(option AS BIGINT) AS option, round(coalesce(sum(lp), 0.0), 9) AS rolling_ll, count(*) AS n_tokens
FROM lp_long GROUP BY ind, option""", ["lp_tokens"])
def l6_rolling_loglikelihood(spark, sf):
    p = V.logprob_payloads(spark, sf)
    return finish(p.select("ind", "option", LP.rolling_loglikelihood("token_logprobs").alias("rolling_ll"),
                           F.size("tokens").cast("bigint").alias("n_tokens")))


_ABL_SQL = f"""{_SC_SQL},
y AS (SELECT *, greatest(1, CASE WHEN n_tok > 0 THEN least(n_tok, n_full - n_ctx) ELSE n_full - n_ctx END) AS n_cont FROM lp),
scores AS (
  SELECT ind, option, n_cont, cont,
    coalesce(sum(lp) FILTER (WHERE pos >= n_tok - n_cont), 0.0) AS s_sum,
    count(lp) FILTER (WHERE pos >= n_tok - n_cont) AS s_n
  FROM y GROUP BY ind, option, n_cont, cont),
modes AS (
  SELECT ind, option, n_cont, s_sum AS score_sum, s_sum / greatest(1, s_n) AS score_length_norm,
         s_sum / greatest(1, strlen(cont)) AS score_byte_norm
  FROM scores)"""


@register("l7_option_scores", f"""
WITH {_ABL_SQL}
SELECT ind, CAST(option AS BIGINT) AS option, CAST(n_cont AS BIGINT) AS n_cont, round(score_sum, 9) AS score_sum,
       round(score_length_norm, 9) AS score_length_norm, round(score_byte_norm, 9) AS score_byte_norm
FROM modes""", ["lp_tokens"])
def l7_option_scores(spark, sf):
    return finish(scoring.option_scores(V.logprob_payloads(spark, sf)))


@register("l8_l9_predictions", f"""
WITH {_ABL_SQL},
ranked AS (
  SELECT ind, option, m.mode,
    row_number() OVER (PARTITION BY ind, m.mode ORDER BY
      round(CASE m.mode WHEN 'sum' THEN score_sum WHEN 'length_norm' THEN score_length_norm ELSE score_byte_norm END, 9)
      DESC, option) AS rn
  FROM modes CROSS JOIN (VALUES ('sum'), ('length_norm'), ('byte_norm')) m(mode))
SELECT r.ind, r.mode, CAST(r.option AS BIGINT) AS predicted, CAST(i.label AS BIGINT) AS label,
       r.option = i.label AS correct
FROM ranked r JOIN items i ON r.ind = i.ind WHERE rn = 1""", ["lp_tokens"])
def l8_l9_predictions(spark, sf):
    s = scoring.option_scores(V.logprob_payloads(spark, sf))
    long = s.select("ind", "option", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mode"), F.round(F.col(f"score_{m}"), 9).alias("score")) for m in LP.SCORING_MODES
    ])).alias("_m")).select("ind", "option", "_m.mode", "_m.score")
    pred = scoring.predict_long(long, "score", ["ind", "mode"])
    labels = V.items(spark, sf).select("ind", "label")
    out = scoring.mark_correct(pred, labels).select("ind", "mode", "predicted", "label", "correct")
    return finish(out)


# The stop strings of the QA task, applied in this order.
QA_STOPS = ["\n", ".", "?"]


def _trunc_sql(x: str) -> str:
    for s in ["chr(10)", "'.'", "'?'"]:
        x = f"CASE WHEN strpos({x}, {s}) > 0 THEN substr({x}, 1, strpos({x}, {s}) - 1) ELSE {x} END"
    return x


@register("l10_truncate_stops", f"""
SELECT conv_id, turn, {_trunc_sql('output')} AS text FROM generations""", ["generations"])
def l10_truncate_stops(spark, sf):
    g = V.generations(spark, sf)
    stops = F.array(*[F.lit(s) for s in QA_STOPS])
    return finish(g.select("conv_id", "turn", truncate_at_stops("output", stops).alias("text")))


@register("l11_effective_params", """
SELECT conv_id, turn,
  round(coalesce(CASE WHEN model = 'model-1' THEN 0.9 END, CASE WHEN conv_id % 2 = 1 THEN 0.2 END, 0.0), 9) AS temperature,
  round(coalesce(CASE WHEN model = 'model-2' THEN 0.95 END, NULL, 1.0), 9) AS top_p,
  CAST(coalesce(NULL, CASE WHEN conv_id % 5 = 0 THEN 16 END, 256) AS BIGINT) AS max_tokens
FROM generations""", ["generations"])
def l11_effective_params(spark, sf):
    g = V.generations(spark, sf)
    null_d = F.lit(None).cast("double")
    return finish(g.select(
        "conv_id", "turn",
        LP.effective(F.when(F.col("model") == "model-1", 0.9), F.when(F.col("conv_id") % 2 == 1, 0.2),
                     LP.DEFAULT_TEMPERATURE).alias("temperature"),
        LP.effective(F.when(F.col("model") == "model-2", 0.95), null_d, LP.DEFAULT_TOP_P).alias("top_p"),
        LP.effective(F.lit(None).cast("int"), F.when(F.col("conv_id") % 5 == 0, 16),
                     LP.DEFAULT_MAX_TOKENS).alias("max_tokens"),
    ))


@register("l12_total_tokens", f"""
SELECT conv_id, turn, CAST({Q.word_count('prompt')} AS BIGINT) AS prompt_tokens,
  CAST({Q.word_count('output')} AS BIGINT) AS completion_tokens,
  CAST({Q.word_count('prompt')} + {Q.word_count('output')} AS BIGINT) AS total_tokens
FROM generations""", ["generations"])
def l12_total_tokens(spark, sf):
    g = V.generations(spark, sf).select("conv_id", "turn", word_count("prompt").alias("prompt_tokens"),
                                        word_count("output").alias("completion_tokens"))
    return finish(g.withColumn("total_tokens", LP.total_tokens("prompt_tokens", "completion_tokens")))


@register("l14_exact_match", f"""
WITH em AS (
  SELECT g.model, {Q.normalise_answer(_trunc_sql('g.output'))} = {Q.normalise_answer('q.answer')} AS hit
  FROM generations g JOIN qa_items q ON CAST(g.conv_id AS VARCHAR) || '-' || CAST(g.turn AS VARCHAR) = q.qid)
SELECT model, count(*) AS n, round(avg(CAST(hit AS INTEGER)), 9) AS exact_match,
       round(coalesce(stddev_samp(CAST(hit AS INTEGER)) / sqrt(count(*)), 0.0), 9) AS exact_match_stderr
FROM em GROUP BY model""", ["qa_items"])
def l14_exact_match(spark, sf):
    g = V.generations(spark, sf)
    qa = V.qa_items(spark, sf)
    stops = F.array(*[F.lit(s) for s in QA_STOPS])
    pred = g.select("model", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
                    truncate_at_stops("output", stops).alias("prediction"))
    hit = pred.join(qa, "qid").select("model", scoring.exact_match("prediction", "answer").cast("int").alias("hit"))
    return finish(hit.groupBy("model").agg(
        F.count("*").alias("n"),
        F.avg("hit").alias("exact_match"),
        F.coalesce(F.stddev_samp("hit") / F.sqrt(F.count("*")), F.lit(0.0)).alias("exact_match_stderr"),
    ))


@register("l15_perplexity", """
WITH per AS (
  SELECT o.activity_label AS task, coalesce(sum(l.lp), 0.0) AS ll, max(l.n_tok) AS n_words,
         max(strlen(o.ctx || ' ' || o.ending)) AS n_bytes
  FROM lp_long l JOIN options o ON l.ind = o.ind AND l.option = o.option
  GROUP BY o.activity_label, o.ind, o.option)
SELECT task, round(exp(-sum(ll) / sum(n_words)), 9) AS word_perplexity,
       round(exp(-sum(ll) / sum(n_bytes)), 9) AS byte_perplexity,
       round(-sum(ll) / (sum(n_bytes) * ln(2.0)), 9) AS bits_per_byte
FROM per GROUP BY task""", ["lp_tokens"])
def l15_perplexity(spark, sf):
    p = V.logprob_payloads(spark, sf)
    it = V.items(spark, sf).select("ind", F.col("activity_label").alias("task"))
    per = p.join(it, "ind").select(
        "task", LP.rolling_loglikelihood("token_logprobs").alias("ll"), F.size("tokens").alias("n_words"),
        F.octet_length(F.concat_ws(" ", "ctx", "ending")).alias("n_bytes"))
    agg = per.groupBy("task").agg(F.sum("ll").alias("ll"), F.sum("n_words").alias("w"), F.sum("n_bytes").alias("b"))
    return finish(agg.select("task", *LP.perplexities("ll", "w", "b")))



@register("l3_parse_payload", """
SELECT ind, CAST(option AS BIGINT) AS option,
  CAST(CASE WHEN option = 3 THEN 0 ELSE count(*) END AS BIGINT) AS n_tokens,
  round(CASE WHEN option = 3 THEN 0.0 ELSE coalesce(sum(lp), 0.0) END, 9) AS sum_lp,
  CAST(CASE WHEN option = 3 THEN 0 ELSE count(alt_lp) END AS BIGINT) AS n_top
FROM lp_long GROUP BY ind, option""", ["lp_tokens"])
def l3_parse_payload(spark, sf):
    """Raw responses (JSON text) parsed back into payload arrays; option 3 has no log-prob block."""
    p = V.logprob_payloads(spark, sf)
    block = F.struct("tokens", "token_logprobs", "top_logprobs")
    raw = F.when(F.col("option") == 3, F.lit('{"choices": [{"text": ""}]}')).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.lit("").alias("text"), block.alias("logprobs"))).alias("choices"))))
    parsed = p.select("ind", "option", LP.parse_payload(raw).alias("pl"))
    return finish(parsed.select(
        "ind", "option", F.size("pl.tokens").cast("bigint").alias("n_tokens"),
        LP.sum_nonnull("pl.token_logprobs").alias("sum_lp"),
        F.size(F.filter("pl.top_logprobs", lambda m: m.isNotNull())).cast("bigint").alias("n_top")))
