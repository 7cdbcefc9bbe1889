"""Registered queries: evaluation aggregates and variant comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import logprob as LP
from evalspark.functions.text import word_count
from evalspark.operators import compare, prompts, scoring
from evalspark.plans import sql_fragments as Q
from evalspark.plans import views as V
from evalspark.plans.queries_scoring import _ABL_SQL
from evalspark.plans.registry import finish, register


@register("a1_a2_accuracy", """
SELECT lang, count(*) AS n, round(avg(CAST(baseline AS DOUBLE)), 9) AS acc,
       round(coalesce(stddev_samp(CAST(baseline AS DOUBLE)) / sqrt(count(*)), 0.0), 9) AS acc_stderr
FROM pairs GROUP BY lang""", ["pairs"])
def a1_a2_accuracy(spark, sf):
    return finish(compare.accuracy(V.pairs(spark, sf), ["lang"], "baseline"))


@register("a3_group_rollup", """
WITH sub AS (
  SELECT lang, source, count(*) AS n, avg(CAST(improved AS DOUBLE)) AS acc,
         coalesce(stddev_samp(CAST(improved AS DOUBLE)) / sqrt(count(*)), 0.0) AS se
  FROM pairs GROUP BY lang, source)
SELECT lang, source, n, round(acc, 9) AS acc, round(se, 9) AS acc_stderr, 'subtask' AS level FROM sub
UNION ALL
SELECT lang, NULL, CAST(sum(n) AS BIGINT), round(sum(acc * n) / sum(n), 9), round(sqrt(sum(n * n * se * se)) / sum(n), 9),
       'group' FROM sub GROUP BY lang""", ["pairs"])
def a3_group_rollup(spark, sf):
    return finish(compare.group_rollup(V.pairs(spark, sf), "lang", "source", "improved"))


@register("a7_pair_results", """
SELECT baseline, improved, count(*) AS n FROM pairs GROUP BY baseline, improved""", ["pairs"])
def a7_pair_results(spark, sf):
    p = V.pairs(spark, sf)
    b = p.select("ind", F.col("baseline").alias("correct"))
    v = p.select("ind", F.col("improved").alias("correct"))
    paired = compare.pair_results(b, v)
    return finish(paired.groupBy("baseline", "improved").agg(F.count("*").alias("n")))


def _near_analytic(boot):
    """Does the interval agree with the normal approximation, and the p-value with the interval?

    Bounds may be off by 0.15 standard errors (the sampling error of an order
    statistic of 10,000 draws is 0.03) and by one and a half steps of 1/n.
    """
    d, n = F.col("diff_acc"), F.col("n")
    error = F.sqrt((F.col("moved") / n - d * d) / n)
    slack = 0.15 * error + 1.5 / n
    near = (F.abs(F.col("ci_low") - (d - 1.959964 * error)) <= slack) & (F.abs(F.col("ci_high") - (d + 1.959964 * error)) <= slack)
    apart = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    agrees = F.col("p_value").between(0, 1) & F.when(apart, F.col("p_value") <= 0.055).otherwise(F.col("p_value") >= 0.045)
    return boot.withColumn("ci_near", near).withColumn("p_agrees", agrees)


@register("a8_bootstrap", """
SELECT lang, count(*) AS n, round(avg(baseline), 9) AS baseline_acc, round(avg(improved), 9) AS improved_acc,
  round(avg(improved - baseline), 9) AS diff_acc, true AS ci_near, true AS p_agrees, CAST(10000 AS BIGINT) AS resamples
FROM pairs GROUP BY lang""", ["pairs"])
def a8_bootstrap(spark, sf):
    """Scale path (multinomial draws per group), B = 10 000, per language; bounds checked against the normal approximation."""
    pairs = V.pairs(spark, sf)
    moved = pairs.groupBy("lang").agg(F.count_if(F.col("baseline") != F.col("improved")).alias("moved"))
    boot = compare.paired_bootstrap(pairs, ["lang"], 10_000, 42).join(moved, "lang")
    return finish(_near_analytic(boot).drop("moved", "ci_low", "ci_high", "p_value"))


def _portable_sql(pairs_cte: str, key: str, b: int = 200, ci: float = 0.95) -> str:
    alpha = (1.0 - ci) / 2.0
    lo, hi = max(0, int(alpha * b)), min(b - 1, int((1.0 - alpha) * b))
    return f"""{pairs_cte},
c AS (
  SELECT {key}, count(*) AS n,
    count(*) FILTER (WHERE improved - baseline = -1) AS n_minus,
    count(*) FILTER (WHERE improved - baseline = 1) AS n_plus,
    sum(baseline) AS sum_baseline, sum(improved) AS sum_improved
  FROM bpairs GROUP BY {key}),
draws AS (SELECT {key}, n, n_minus, n_plus, r.b, unnest(range((n + 3) // 4)) AS j FROM c CROSS JOIN range({b}) r(b)),
hashed AS (SELECT *, md5('42:' || CAST(b AS VARCHAR) || ':' || CAST(j AS VARCHAR)) AS h FROM draws),
per_b AS (
  SELECT {key}, b, sum(CASE WHEN j * 4 + 0 < n THEN (CASE WHEN CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % n < n_minus THEN -1 WHEN CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % n >= n - n_plus THEN 1 ELSE 0 END) ELSE 0 END + CASE WHEN j * 4 + 1 < n THEN (CASE WHEN CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % n < n_minus THEN -1 WHEN CAST(('0x' || substr(h, 9, 8)) AS BIGINT) % n >= n - n_plus THEN 1 ELSE 0 END) ELSE 0 END + CASE WHEN j * 4 + 2 < n THEN (CASE WHEN CAST(('0x' || substr(h, 17, 8)) AS BIGINT) % n < n_minus THEN -1 WHEN CAST(('0x' || substr(h, 17, 8)) AS BIGINT) % n >= n - n_plus THEN 1 ELSE 0 END) ELSE 0 END + CASE WHEN j * 4 + 3 < n THEN (CASE WHEN CAST(('0x' || substr(h, 25, 8)) AS BIGINT) % n < n_minus THEN -1 WHEN CAST(('0x' || substr(h, 25, 8)) AS BIGINT) % n >= n - n_plus THEN 1 ELSE 0 END) ELSE 0 END) AS s
  FROM hashed GROUP BY {key}, b),
st AS (
  SELECT {key}, list_sort(list(s)) AS ss, count(*) FILTER (WHERE s <= 0) AS le0,
         count(*) FILTER (WHERE s >= 0) AS ge0
  FROM per_b GROUP BY {key}),
boot AS (
  SELECT c.{key}, c.n, c.sum_baseline / c.n AS baseline_acc, c.sum_improved / c.n AS improved_acc,
    (c.n_plus - c.n_minus) / c.n AS diff_acc, st.ss[{lo + 1}] / c.n AS ci_low, st.ss[{hi + 1}] / c.n AS ci_high,
    least(1.0, 2.0 * (CASE WHEN c.n_plus - c.n_minus >= 0 THEN st.le0 ELSE st.ge0 END) / {float(b)}) AS p_value,
    {b} AS resamples
  FROM c JOIN st ON c.{key} = st.{key})"""


_BOOT_COLS = """n, round(baseline_acc, 9) AS baseline_acc, round(improved_acc, 9) AS improved_acc,
  round(diff_acc, 9) AS diff_acc, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high,
  round(p_value, 9) AS p_value, CAST(resamples AS BIGINT) AS resamples"""


@register("a8_bootstrap_portable", f"""
WITH {_portable_sql("bpairs AS (SELECT lang, baseline, improved FROM pairs)", "lang")}
SELECT lang, {_BOOT_COLS} FROM boot""", ["pairs"])
def a8_bootstrap_portable(spark, sf):
    return finish(compare.paired_bootstrap_portable(V.pairs(spark, sf), ["lang"], 200, 42))


# Predictions of the three scoring modes (L8/L9), as a variant result table.
_PRED_SQL = f"""{_ABL_SQL},
ranked AS (
  SELECT ind, option, m.mode,
    row_number() OVER (PARTITION BY ind, m.mode ORDER BY
      round(CASE m.mode WHEN 'sum' THEN score_sum WHEN 'length_norm' THEN score_length_norm ELSE score_byte_norm END, 9)
      DESC, option) AS rn
  FROM modes CROSS JOIN (VALUES ('sum'), ('length_norm'), ('byte_norm')) m(mode)),
results AS (
  SELECT r.ind, CASE r.mode WHEN 'sum' THEN 'baseline' ELSE r.mode END AS variant, r.option AS predicted,
         i.label, r.option = i.label AS correct
  FROM ranked r JOIN items i ON r.ind = i.ind WHERE rn = 1)"""


def _results(spark, sf):
    s = scoring.option_scores(V.logprob_payloads(spark, sf))
    long = s.select("ind", "option", F.explode(F.array(*[
        F.struct(F.lit("baseline" if m == "sum" else m).alias("variant"),
                 F.round(F.col(f"score_{m}"), 9).alias("score")) for m in LP.SCORING_MODES
    ])).alias("_m")).select("ind", "option", "_m.variant", "_m.score")
    pred = scoring.predict_long(long, "score", ["ind", "variant"])
    return scoring.mark_correct(pred, V.items(spark, sf).select("ind", "label"))


_CMP_SQL = f"""{_PRED_SQL},
acc AS (SELECT variant, count(*) AS n, avg(CAST(correct AS DOUBLE)) AS acc,
               coalesce(stddev_samp(CAST(correct AS DOUBLE)) / sqrt(count(*)), 0.0) AS acc_stderr
        FROM results GROUP BY variant),
{_portable_sql('''bpairs AS (
  SELECT v.variant, CAST(b.correct AS INTEGER) AS baseline, CAST(v.correct AS INTEGER) AS improved
  FROM results v JOIN results b ON v.ind = b.ind AND b.variant = 'baseline' WHERE v.variant <> 'baseline')''',
               "variant")},
cmp AS (
  SELECT a.variant, a.n, a.acc, a.acc_stderr, b.diff_acc AS delta, b.ci_low, b.ci_high, b.p_value,
         b.n AS n_paired, b.resamples,
         CASE WHEN b.ci_low IS NULL OR b.ci_high IS NULL THEN 'n/a (baseline)'
              WHEN b.ci_low > 0 THEN 'significantly better (95% CI > 0)'
              WHEN b.ci_high < 0 THEN 'significantly worse (95% CI < 0)'
              ELSE 'not significant (95% CI includes 0)' END AS verdict
  FROM acc a LEFT JOIN boot b ON a.variant = b.variant)"""


@register("a10_compare_variants", f"""
WITH {_CMP_SQL}
SELECT variant, n, round(acc, 9) AS acc, round(acc_stderr, 9) AS acc_stderr, round(delta, 9) AS delta,
  round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_value, 9) AS p_value,
  coalesce(n_paired, 0) AS n_paired, CAST(coalesce(resamples, 0) AS BIGINT) AS resamples, verdict
FROM cmp""", ["lp_tokens"])
def a10_compare_variants(spark, sf):
    out = compare.compare_variants(_results(spark, sf), resamples=200, portable=True)
    # Baseline rows have no pairing: report 0 paired items / resamples.
    return finish(out.fillna(0, ["n_paired", "resamples"]))


@register("a11_flips", f"""
WITH {_PRED_SQL}
SELECT b.ind, CAST(b.label AS BIGINT) AS label, CAST(b.predicted AS BIGINT) AS pred_before,
  b.correct AS correct_before, CAST(a.predicted AS BIGINT) AS pred_after, a.correct AS correct_after,
  CASE WHEN NOT b.correct AND a.correct THEN 'fixed' WHEN b.correct AND NOT a.correct THEN 'broken' ELSE 'same' END
    AS change
FROM results b JOIN results a ON a.ind = b.ind AND b.variant = 'baseline' AND a.variant = 'length_norm'""",
          ["lp_tokens"])
def a11_flips(spark, sf):
    return finish(compare.flips(_results(spark, sf), "baseline", "length_norm"))


@register("a12_token_cost", f"""
WITH usage AS (
  SELECT 'baseline' AS variant, {Q.word_count("ctx || ' ' || ending")} AS tokens FROM options
  UNION ALL
  SELECT 'clean_prompt', {Q.word_count(Q.strip_artifacts('ctx', 'activity_label') + " || ' ' || ending")} FROM options),
tot AS (SELECT variant, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY variant)
SELECT variant, total_tokens,
  round(total_tokens / (SELECT total_tokens FROM tot WHERE variant = 'baseline'), 9) AS cost_multiplier
FROM tot""", ["options"])
def a12_token_cost(spark, sf):
    items = V.items(spark, sf)
    b = prompts.baseline_pairs(items).select(F.lit("baseline").alias("variant"),
                                             word_count(F.concat("prompt", "continuation")).alias("tokens"))
    c = prompts.clean_pairs(items).select(F.lit("clean_prompt").alias("variant"),
                                          word_count(F.concat("prompt", "continuation")).alias("tokens"))
    return finish(compare.token_cost(b.unionByName(c)))


@register("a13_journal", f"""
WITH {_CMP_SQL}
SELECT variant, chr(10) || '## ' || variant || ' — hellaswag' || chr(10)
  || '- **When:** 2026-01-02T03:04+00:00' || chr(10) || '- **Commit:** `abc1234`' || chr(10)
  || '- **Task / limit / seed:** hellaswag / ' || n || ' / 42' || chr(10)
  || '- **Model:** `model-0` (mock_backend=False)' || chr(10)
  || '- **Accuracy:** ' || printf('%.4f', acc) || chr(10)
  || '- **Delta vs baseline:** ' || coalesce(printf('%+.4f', delta), 'n/a (baseline)') || chr(10)
  || '- **95% CI (paired bootstrap, ' || coalesce(CAST(resamples AS VARCHAR), '-') || '):** '
  || CASE WHEN ci_low IS NULL THEN 'n/a (baseline)' ELSE printf('[%+.4f, %+.4f]', ci_low, ci_high) END || chr(10)
  || '- **Two-sided p-value:** ' || coalesce(printf('%.4f', p_value), 'n/a (baseline)') || chr(10)
  || '- **Significance:** ' || verdict || chr(10)
  || '- **Wall time:** 12.5s' || chr(10) || '- **Notes:** (none)' || chr(10) AS entry
FROM cmp""", ["lp_tokens"])
def a13_journal(spark, sf):
    summary = compare.compare_variants(_results(spark, sf), resamples=200, portable=True)
    return finish(compare.journal_entries(summary, when="2026-01-02T03:04+00:00", commit="abc1234", model="model-0", wall_s=12.5))


@register("a10_compare_variants_scale", f"""
WITH {_PRED_SQL},
acc AS (SELECT variant, count(*) AS n, avg(CAST(correct AS DOUBLE)) AS acc,
  coalesce(stddev_samp(CAST(correct AS DOUBLE)) / sqrt(count(*)), 0.0) AS acc_stderr FROM results GROUP BY variant),
d AS (SELECT v.variant, count(*) AS n_paired, avg(CAST(v.correct AS INTEGER) - CAST(b.correct AS INTEGER)) AS delta
  FROM results v JOIN results b ON v.ind = b.ind AND b.variant = 'baseline' WHERE v.variant <> 'baseline' GROUP BY v.variant)
SELECT a.variant, a.n, round(acc, 9) AS acc, round(acc_stderr, 9) AS acc_stderr, round(delta, 9) AS delta,
  coalesce(n_paired, 0) AS n_paired, CAST(CASE WHEN delta IS NULL THEN 0 ELSE 10000 END AS BIGINT) AS resamples, true AS consistent
FROM acc a LEFT JOIN d ON a.variant = d.variant""", ["lp_tokens"])
def a10_compare_variants_scale(spark, sf):
    """A10 on the scale path: multinomial bootstrap, B = 10 000; interval, p-value and verdict must agree with each other."""
    out = compare.compare_variants(_results(spark, sf), resamples=10_000, portable=False)
    apart = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    said = F.col("verdict").startswith("significantly")
    held = (F.col("ci_low") <= F.col("delta")) & (F.col("delta") <= F.col("ci_high"))
    p_fits = F.when(apart, F.col("p_value") <= 0.055).otherwise(F.col("p_value") >= 0.045)
    fits = F.when(F.col("delta").isNull(), F.col("verdict") == "n/a (baseline)").otherwise(held & (said == apart) & p_fits)
    return finish(out.fillna(0, ["n_paired", "resamples"]).withColumn("consistent", fits)
                  .drop("ci_low", "ci_high", "p_value", "verdict"))
