"""Registered queries: exemplar retrieval and the variant ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import prompts, retrieval
from evalspark.plans import sql_fragments as Q
from evalspark.plans import views as V
from evalspark.plans.queries_prep import _DEMO_SQL, _PICKS_SQL
from evalspark.plans.registry import finish, register
from evalspark.sources.readers import read_table

K = 5


_COSINE_SQL = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS pool_id, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS score
      FROM n a JOIN n b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pool_id) AS rank FROM s)
SELECT query_id, CAST(rank AS BIGINT) AS rank, pool_id, round(score, 9) AS score FROM r WHERE rank <= {K}"""


def _cosine(spark, sf, **sizes):
    e = read_table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    p = e.select(F.col("vec_id").alias("pool_id"), "embedding")
    return finish(retrieval.topk_cosine(q, p, K, "query_id", "pool_id", "embedding", exclude_self=True, **sizes))


@register("t8_topk_cosine", _COSINE_SQL)
def t8_topk_cosine(spark, sf):
    return _cosine(spark, sf)


@register("t8_topk_cosine_cells", _COSINE_SQL)
def t8_topk_cosine_cells(spark, sf):
    """T8 as on a large pool: many cells, blocks and chunks."""
    return _cosine(spark, sf, cell_rows=32, chunk_rows=100)


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\pL\\pN_]{{2,}}')"


def _terms_sql(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def tfidf_sql(queries_cte: str, k: int = K, limit: str = "LIMIT 8192") -> str:
    """CTEs ending in ``topk(qid, rank, pid, score)``; ``queries_cte`` defines ``q(qid, text)``."""
    return f"""{queries_cte},
ptok AS (SELECT pool_id AS pid, {_tok('ctx')} AS t FROM pool),
ptf AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest({_terms_sql('t')}) AS term FROM ptok) GROUP BY ALL),
stats AS (SELECT term, sum(tf) AS total, count(*) AS df FROM ptf GROUP BY term),
vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM pool)) / (1 + df)) + 1 AS idf
          FROM stats ORDER BY total DESC, term {limit}),
pw AS (SELECT pid, term, tf * idf AS w FROM ptf JOIN vocab USING (term)),
pn AS (SELECT pid, term, w / sqrt(sum(w * w) OVER (PARTITION BY pid)) AS w FROM pw),
qtok AS (SELECT qid, {_tok('text')} AS t FROM q),
qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_terms_sql('t')}) AS term FROM qtok)
        WHERE term IN (SELECT term FROM vocab) GROUP BY ALL),
qw AS (SELECT qid, term, tf * idf AS w FROM qtf JOIN vocab USING (term)),
qn AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM qw),
sims AS (SELECT qn.qid, pn.pid, sum(qn.w * pn.w) AS score FROM qn JOIN pn ON qn.term = pn.term GROUP BY ALL),
grid AS (SELECT q.qid, p.pool_id AS pid, coalesce(s.score, 0.0) AS score
         FROM q CROSS JOIN pool p LEFT JOIN sims s ON s.qid = q.qid AND s.pid = p.pool_id),
topk AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM grid)
  WHERE rank <= {k})"""


@register("t9_tfidf_topk", f"""
WITH {tfidf_sql("q AS (SELECT doc_id AS qid, text FROM documents)")}
SELECT qid AS doc_id, CAST(rank AS BIGINT) AS rank, pid AS pool_id, round(score, 9) AS score FROM topk""", ["pool"])
def t9_tfidf_topk(spark, sf):
    docs = read_table(spark, sf, "documents")
    out = retrieval.tfidf_topk(docs, V.pool(spark, sf), K, "doc_id", "text", "pool_id", "ctx")
    return finish(out)


@register("t9_tfidf_full_vocabulary", f"""
WITH {tfidf_sql("q AS (SELECT doc_id AS qid, text FROM documents)", limit="")}
SELECT qid AS doc_id, CAST(rank AS BIGINT) AS rank, pid AS pool_id, round(score, 9) AS score FROM topk""", ["pool"])
def t9_tfidf_full_vocabulary(spark, sf):
    """T9 with every term of the pool, and floors from one term per query."""
    docs = read_table(spark, sf, "documents")
    out = retrieval.tfidf_topk(docs, V.pool(spark, sf), K, "doc_id", "text", "pool_id", "ctx", max_features=None, seeds=1)
    return finish(out)


_SEM_PICKS_SQL = tfidf_sql("q AS (SELECT ind AS qid, ctx AS text FROM items)") + """,
sem_chosen AS (SELECT qid AS ind, CAST(rank - 1 AS INTEGER) AS j, pid AS pool_id FROM topk)"""


def _fewshot_prompt_sql(chosen: str) -> str:
    demo = _DEMO_SQL.replace("demos AS", f"demos_{chosen} AS").replace("FROM chosen c", f"FROM {chosen} c")
    return demo


_LADDER_SQL = f"""
WITH {_PICKS_SQL}, {_SEM_PICKS_SQL},
{_fewshot_prompt_sql('chosen')},
{_fewshot_prompt_sql('sem_chosen')},
clean AS (SELECT ind, option, ending, {Q.strip_artifacts('ctx', 'activity_label')} AS cctx, ctx FROM options),
kinds AS (
  SELECT 'baseline' AS kind, ind, option, ctx AS prompt, ending FROM clean
  UNION ALL SELECT 'clean', ind, option, cctx, ending FROM clean
  UNION ALL SELECT 'fewshot_random', c.ind, c.option,
    CASE WHEN d.demos IS NULL THEN c.cctx ELSE d.demos || chr(10) || chr(10) || c.cctx END, c.ending
    FROM clean c LEFT JOIN demos_chosen d ON c.ind = d.ind
  UNION ALL SELECT 'fewshot_semantic', c.ind, c.option,
    CASE WHEN d.demos IS NULL THEN c.cctx ELSE d.demos || chr(10) || chr(10) || c.cctx END, c.ending
    FROM clean c LEFT JOIN demos_sem_chosen d ON c.ind = d.ind),
variants AS (SELECT * FROM (VALUES
  ('baseline', 'baseline', 'sum'), ('length_norm', 'baseline', 'length_norm'), ('byte_norm', 'baseline', 'byte_norm'),
  ('clean_prompt', 'clean', 'sum'), ('clean_length_norm', 'clean', 'length_norm'),
  ('fewshot_random_5', 'fewshot_random', 'length_norm'), ('fewshot_semantic_5', 'fewshot_semantic', 'length_norm'))
  v(variant, kind, scoring))
SELECT v.variant, v.kind, v.scoring, k.ind, CAST(k.option AS BIGINT) AS option, md5(k.prompt) AS prompt_md5,
       {Q.continuation('k.ending')} AS continuation
FROM kinds k JOIN variants v ON k.kind = v.kind"""


@register("t10_variant_ladder", _LADDER_SQL, ["items", "options", "pool"])
def t10_variant_ladder(spark, sf):
    items, pool = V.items(spark, sf), V.pool(spark, sf)
    lad = prompts.build_ladder(items, pool, seed=42, semantic_picks=retrieval.semantic_picks("ctx", "ctx"))
    return finish(lad.select("variant", "kind", "scoring", "ind", "option", F.md5("prompt").alias("prompt_md5"),
                             "continuation"))
