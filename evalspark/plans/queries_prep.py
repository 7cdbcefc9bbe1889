"""Registered queries: data preparation and prompt construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.text import strip_artifacts
from evalspark.operators import prep, prompts
from evalspark.plans import sql_fragments as Q
from evalspark.plans import views as V
from evalspark.plans.registry import finish, register

_NORM_SQL = f"""norm AS (
  SELECT CAST(ind AS VARCHAR) AS ind,
    CASE WHEN coalesce(ctx_b, '') = '' THEN coalesce(nullif(ctx, ''), ctx_a, '')
         WHEN coalesce(nullif(ctx, ''), ctx_a, '') = '' THEN ctx_b
         ELSE coalesce(nullif(ctx, ''), ctx_a, '') || ' ' || ctx_b END AS ctx,
    coalesce(activity_label, '') AS activity_label, endings,
    CASE WHEN label IS NULL OR label = '' THEN -1 ELSE CAST(label AS INTEGER) END AS label
  FROM raw_items)"""


@register("p1_normalise_items", f"""
WITH {_NORM_SQL}
SELECT ind, ctx, activity_label, array_to_string(endings, '|') AS endings, CAST(label AS BIGINT) AS label FROM norm""",
          ["raw_items"])
def p1_normalise_items(spark, sf):
    n = prep.normalise_items(V.raw_items(spark, sf))
    return finish(n.withColumn("endings", F.array_join("endings", "|")))


@register("p2_labelled_items", f"""
WITH {_NORM_SQL}
SELECT label AS label, count(*) AS n FROM (SELECT CAST(label AS BIGINT) AS label FROM norm WHERE label >= 0 AND len(endings) > 0 AND CAST(ind AS BIGINT) % 9 <> 0)
GROUP BY label""", ["raw_items"])
def p2_labelled_items(spark, sf):
    """Every ninth raw item has lost its endings, some have no label."""
    raw = V.raw_items(spark, sf).withColumn("endings", F.when(F.col("ind") % 9 != 0, F.col("endings")))
    lab = prep.labelled(prep.normalise_items(raw))
    return finish(lab.groupBy("label").agg(F.count("*").alias("n")))


@register("p4_split_items", """
WITH sizes AS (SELECT count(*) // 5 AS n_eval, count(*) // 10 AS n_pool FROM items)
SELECT ind, CAST(rank AS BIGINT) AS rank, CASE WHEN rank < n_eval THEN 'eval' ELSE 'pool' END AS split
FROM (SELECT ind, row_number() OVER (ORDER BY md5('42:' || ind), ind) - 1 AS rank FROM items), sizes
WHERE rank < n_eval + n_pool""", ["items"])
def p4_split_items(spark, sf):
    """Split sizes are fractions of the table: 20 % eval, 10 % pool."""
    items = V.items(spark, sf)
    n = items.count()
    s = prep.split_items(items, n_eval=n // 5, n_pool=n // 10, seed=42, check=False)
    return finish(s.select("ind", "rank", "split"))


@register("p5_limit_per_task", """
SELECT task, run_id FROM (
  SELECT task, run_id, row_number() OVER (PARTITION BY task ORDER BY run_id) AS rn FROM runs) WHERE rn <= 50""",
          ["runs"])
def p5_limit_per_task(spark, sf):
    return finish(prep.limit_items(V.runs(spark, sf), 50, by="task", order="run_id").select("task", "run_id"))


@register("p6_qa_contract", f"""
WITH agg AS (
  SELECT count(*) AS rows,
    count(*) FILTER (WHERE question IS NULL OR {Q.strip_ws('question')} = '') AS blank_question,
    count(*) FILTER (WHERE answer IS NULL OR {Q.strip_ws('answer')} = '') AS blank_answer,
    count(*) FILTER (WHERE {Q.word_count('answer')} > 3) AS long_answer
  FROM qa_items)
SELECT 'row_count' AS rule, CAST(abs(rows - 100) AS BIGINT) AS violations FROM agg
UNION ALL SELECT 'blank_question', blank_question FROM agg
UNION ALL SELECT 'blank_answer', blank_answer FROM agg
UNION ALL SELECT 'long_answer', long_answer FROM agg""", ["qa_items"])
def p6_qa_contract(spark, sf):
    return finish(prep.check_contract(V.qa_items(spark, sf), expected_rows=100))


@register("p7_degenerate_accuracy", """
SELECT source, count(*) AS n, round(avg(CAST(baseline AS DOUBLE)), 9) AS accuracy,
       (bool_and(baseline = 1) OR NOT bool_or(baseline = 1)) AS degenerate
FROM pairs GROUP BY source""", ["pairs"])
def p7_degenerate_accuracy(spark, sf):
    res = V.pairs(spark, sf).select("source", (F.col("baseline") == 1).alias("correct"))
    return finish(prep.degenerate_accuracy(res, by="source"))


@register("p7_synthetic_ids", """
SELECT count(*) FILTER (WHERE starts_with(ind, 'syn-')) AS synthetic, count(*) AS n_items FROM items""", ["items"])
def p7_synthetic_ids(spark, sf):
    return finish(prep.synthetic_ids(V.items(spark, sf)))


@register("t1_strip_artifacts", f"""
SELECT ind, {Q.strip_artifacts('ctx', 'activity_label')} AS clean_ctx FROM items""", ["items"])
def t1_strip_artifacts(spark, sf):
    return finish(V.items(spark, sf).select("ind", strip_artifacts("ctx", "activity_label").alias("clean_ctx")))


@register("t3_baseline_pairs", f"""
SELECT ind, CAST(option AS BIGINT) AS option, ctx AS prompt, {Q.continuation('ending')} AS continuation FROM options""",
          ["options"])
def t3_baseline_pairs(spark, sf):
    return finish(prompts.baseline_pairs(V.items(spark, sf)))


@register("t4_clean_pairs", f"""
SELECT ind, CAST(option AS BIGINT) AS option, {Q.strip_artifacts('ctx', 'activity_label')} AS prompt,
       {Q.continuation('ending')} AS continuation FROM options""", ["options"])
def t4_clean_pairs(spark, sf):
    return finish(prompts.clean_pairs(V.items(spark, sf)))


@register("t6_qa_prompt", """
SELECT qid, 'Answer the question with a single short answer (one or two words).' || chr(10) || chr(10)
       || 'Question: ' || question || chr(10) || 'Answer:' AS prompt, answer AS target FROM qa_items""",
          ["qa_items"])
def t6_qa_prompt(spark, sf):
    qa = V.qa_items(spark, sf)
    return finish(qa.select("qid", prompts.qa_prompt().alias("prompt"), F.col("answer").alias("target")))


def _draws() -> str:
    at = "(p - least(5, p) + {0})"
    return "".join(f", {Q.md5_u32(f"'42:' || i.ind || ':' || CAST({at.format(j)} AS VARCHAR)")} % ({at.format(j)} + 1) AS t{j}" for j in range(5))


def _taken() -> str:
    """Floyd's method: a position that's taken already gives way to the last one."""
    out = ["taken0 AS (SELECT *, t0 AS s0 FROM drawn)"]
    for j in range(1, 5):
        before = ", ".join(f"s{i}" for i in range(j))
        out.append(f"taken{j} AS (SELECT *, CASE WHEN t{j} IN ({before}) THEN p - k + {j} ELSE t{j} END AS s{j} FROM taken{j - 1})")
    return ",\n".join(out)


_PICKS_SQL = f"""pool_idx AS (
  SELECT pool_id, row_number() OVER (ORDER BY md5('42:' || CAST(pool_id AS VARCHAR)), pool_id) - 1 AS pos FROM pool),
np AS (SELECT count(*) AS p FROM pool),
drawn AS (SELECT i.ind, p, least(5, p) AS k{_draws()} FROM items i CROSS JOIN np),
{_taken()},
picks AS (
  SELECT ind, CAST(r.j AS INTEGER) AS j, [s0, s1, s2, s3, s4][r.j + 1] AS pos FROM taken4 CROSS JOIN range(5) r(j) WHERE r.j < k),
chosen AS (SELECT picks.ind, picks.j, pool_idx.pool_id FROM picks JOIN pool_idx ON picks.pos = pool_idx.pos)"""


@register("t7_fewshot_random", f"""
WITH {_PICKS_SQL}
SELECT ind, CAST(j AS BIGINT) AS j, pool_id FROM chosen""", ["items", "pool"])
def t7_fewshot_random(spark, sf):
    return finish(prompts.fewshot_random(V.items(spark, sf), V.pool(spark, sf), 5, seed=42))


_DEMO_SQL = f"""demos AS (
  SELECT c.ind, string_agg({Q.strip_artifacts('p.ctx', 'p.activity_label')} || ' ' ||
                           {Q.lstrip_ws("coalesce(p.endings[p.label + 1], '')")}, chr(10) || chr(10) ORDER BY c.j) AS demos
  FROM chosen c JOIN pool p ON c.pool_id = p.pool_id GROUP BY c.ind)"""


@register("t5_fewshot_pairs", f"""
WITH {_PICKS_SQL}, {_DEMO_SQL}
SELECT o.ind, CAST(o.option AS BIGINT) AS option,
  md5(CASE WHEN d.demos IS NULL THEN {Q.strip_artifacts('o.ctx', 'o.activity_label')}
      ELSE d.demos || chr(10) || chr(10) || {Q.strip_artifacts('o.ctx', 'o.activity_label')} END) AS prompt_md5,
  {Q.continuation('o.ending')} AS continuation
FROM options o LEFT JOIN demos d ON o.ind = d.ind""", ["items", "options", "pool"])
def t5_fewshot_pairs(spark, sf):
    items, pool = V.items(spark, sf), V.pool(spark, sf)
    pairs = prompts.fewshot_pairs(items, prompts.fewshot_random(items, pool, 5, seed=42), pool)
    return finish(pairs.select("ind", "option", F.md5("prompt").alias("prompt_md5"), "continuation"))


@register("p3_require_rows", f"""
WITH {_NORM_SQL}
SELECT needed, count(*) AS available, count(*) >= needed AS ok FROM norm, (VALUES (300::BIGINT), (1000000000)) v(needed)
WHERE label >= 0 AND len(endings) > 0 GROUP BY needed""", ["raw_items"])
def p3_require_rows(spark, sf):
    """The gate asked for 300 labelled rows, and for more than there are."""
    lab = prep.labelled(prep.normalise_items(V.raw_items(spark, sf)))
    available, rows = prep.require_rows(lab, 0), []
    for needed in (300, 10**9):
        try:
            rows.append((needed, prep.require_rows(lab, needed), True))
        except prep.ContractError:
            rows.append((needed, available, False))
    return spark.createDataFrame(rows, "needed bigint, available bigint, ok boolean")


@register("p7_sanity_gate", """
WITH syn AS (SELECT count(*) FILTER (WHERE starts_with(ind, 'syn-')) AS synthetic FROM items)
SELECT source, count(*) AS n, round(avg(CAST(baseline AS DOUBLE)), 9) AS accuracy,
       (bool_and(baseline = 1) OR NOT bool_or(baseline = 1)) AS degenerate, syn.synthetic
FROM pairs, syn GROUP BY source, syn.synthetic""", ["items", "pairs"])
def p7_sanity_gate(spark, sf):
    res = V.pairs(spark, sf).select("source", (F.col("baseline") == 1).alias("correct"))
    return finish(prep.sanity_gate(V.items(spark, sf), res, by="source"))
