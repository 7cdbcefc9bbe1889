"""DuckDB SQL of the test-data views in :mod:`evalspark.plans.views`.

Each entry is one ``name AS (...)`` CTE; :func:`with_views` prefixes a query
with the CTEs it names. Expressions mirror the Spark ones one for one.
"""

from __future__ import annotations

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _md5_bucket(key_sql: str, n: int) -> str:
    return f"(CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT) % {n})"


def _pieces(n: int) -> list[str]:
    """``views.pieces`` of ``text``."""
    at = [f"CAST(floor(length(text) * {i} / {n}.0) AS INTEGER)" for i in range(n + 1)]
    return [f"substr(text, {at[i]} + 1, {at[i + 1]} - {at[i]})" for i in range(n)]


P5, P6 = _pieces(5), _pieces(6)

VIEWS: dict[str, str] = {
    "requests": f"""requests AS (
  SELECT event_id AS idx,
    CASE WHEN user_id % 2 = 0 THEN 'short' ELSE 'long' END AS prompt_kind,
    CASE WHEN user_id % 2 = 0 THEN 18 ELSE 384 END AS prompt_chars,
    CASE WHEN user_id % 2 = 0 THEN 32 ELSE 256 END AS max_tokens,
    CASE WHEN event_id % 3 = 0 THEN 'generate' ELSE 'stream' END AS mode,
    value / 50.0 AS wall_s,
    CASE WHEN event_id % 3 <> 0 THEN (value / 50.0) * {_K} / 200.0 END AS ttft_s,
    {_K} AS output_tokens,
    CASE WHEN event_type = 'error' AND value > 400 THEN 'timeout'
         WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN 'HTTP ' || event_type END AS error,
    epoch_us(ts) / 1e6 AS started_at,
    epoch_us(ts) / 1e6 + value / 50.0 AS ended_at
  FROM events)""",
    "gpu": """gpu AS (
  SELECT epoch_us(date_trunc('minute', ts)) / 1e6 AS timestamp, 0 AS index,
         avg(value) AS util_gpu, max(value) AS mem_used
  FROM events GROUP BY 1)""",
    "pairs": """pairs AS (
  SELECT l.doc_id AS ind, l.quality AS baseline, 1 - l.toxic AS improved, d.lang, d.source
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "items": f"""items AS (
  SELECT CAST(doc_id AS VARCHAR) AS ind,
    '[' || lang || '] ' || source || ': ' || {P5[0]} AS ctx,
    source AS activity_label,
    [{", ".join(P5[1:])}] AS endings,
    CAST(doc_id % 4 AS INTEGER) AS label
  FROM documents)""",
    "raw_items": f"""raw_items AS (
  SELECT doc_id AS ind,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE {P6[0]} END AS ctx,
    {P6[0]} AS ctx_a, {P6[1]} AS ctx_b, source AS activity_label,
    [{", ".join(P6[2:])}] AS endings,
    CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN NULL ELSE CAST(doc_id % 4 AS VARCHAR) END AS label
  FROM documents)""",
    "pool": f"""pool AS (
  SELECT item_id AS pool_id, {P5[0]} AS ctx, 'bench' AS activity_label,
    [{", ".join(P5[1:])}] AS endings,
    CAST(item_id % 4 AS INTEGER) AS label
  FROM benchmark)""",
    # Long form of the scoring payloads: one row per (item, option, token position).
    "options": """options AS (
  SELECT ind, ctx, activity_label, label, unnest(endings) AS ending,
         CAST(generate_subscripts(endings, 1) - 1 AS INTEGER) AS option
  FROM items)""",
    "lp_tokens": f"""lp_tokens AS (
  SELECT ind, option, ending, unnest(toks) AS token,
         CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, len(toks) AS n_tok
  FROM (SELECT ind, option, ending,
               list_filter(regexp_split_to_array(ctx || ' ' || ending, '\\s+'), lambda x: x <> '') AS toks
        FROM options)),
lp_long AS (
  SELECT ind, option, ending, token, pos, n_tok,
    CASE WHEN pos > 0 THEN -{_md5_bucket("ind || ':' || CAST(option AS VARCHAR) || ':' || CAST(pos AS VARCHAR)", 1000)} / 100.0 END AS lp,
    CASE WHEN pos > 0 THEN -{_md5_bucket("ind || ':' || CAST(option AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':alt'", 1000)} / 100.0 END AS alt_lp
  FROM lp_tokens)""",
    "generations": """generations AS (
  SELECT u.conv_id, u.turn, 'model-' || CAST(u.conv_id % 3 AS VARCHAR) AS model, u.text AS prompt, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')""",
    "repeats": """repeats AS (SELECT source AS prompt, doc_id AS run, text, lang FROM documents)""",
    "runs": """runs AS (
  SELECT o_orderkey AS run_id, o_orderdate AS timestamp, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS commit,
    'm' || CAST(o_custkey % 3 AS VARCHAR) AS model, o_orderpriority AS task, o_orderstatus AS method,
    CASE WHEN o_orderkey % 2 = 0 THEN 200 END AS "limit", CAST(o_custkey % 6 AS INTEGER) AS num_fewshot,
    42 AS seed, 'acc' AS metric, o_totalprice AS value,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 1e7 END AS stderr,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_totalprice - 250000.0) / 1e6 END AS delta,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_totalprice - 250000.0) / 1e6 END - 0.05 AS ci95_low,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_totalprice - 250000.0) / 1e6 END + 0.05 AS ci95_high,
    o_totalprice / 1000.0 AS wall_s, o_orderkey % 10 = 0 AS mock_backend,
    CASE WHEN o_orderkey % 11 = 0 THEN 'line one' || chr(10) || 'line two' ELSE '' END AS notes
  FROM orders)""",
    "qa_items": """qa_items AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, prompt AS question, output AS answer
  FROM generations)""",
}

# Views that other views are built from.
DEPENDS = {
    "options": ["items"],
    "lp_tokens": ["items", "options"],
    "qa_items": ["generations"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH`` CTEs for the named views (and their inputs)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = "WITH " + ",\n".join(VIEWS[n] for n in order) + "\n"
    body = sql.lstrip()
    if body.startswith("WITH "):
        body = ", " + body[5:]
    return head + body

VIEWS["sse_lines"] = """sse_lines AS (
  SELECT user_id AS request_id, epoch_us(ts) / 1e6 AS ts, ts AS event_ts, event_id AS seq,
    CASE WHEN event_type = 'view' THEN ': keep-alive'
         WHEN event_type = 'error' THEN 'data: [DONE]'
         ELSE 'data: {"choices": [{"text": "' ||
              CASE WHEN event_type = 'purchase' THEN '' ELSE event_type || ' ' || CAST(event_id % 3 AS VARCHAR) END
              || '", "finish_reason": null}]}' END AS value
  FROM events)"""

VIEWS["task_metrics"] = """task_metrics AS (
  SELECT 'task-' || CAST(o_orderkey AS VARCHAR) AS task, 0 AS pos, 'alias' AS metric, CAST(NULL AS DOUBLE) AS value FROM orders
  UNION ALL SELECT 'task-' || CAST(o_orderkey AS VARCHAR), m.pos, m.metric, o_totalprice / m.div FROM orders,
    (VALUES (1, 'acc,none', 1e6), (2, 'acc_stderr,none', 1e8), (3, 'acc_norm,none', 2e6), (4, 'acc_norm_stderr,none', 2e8))
      m(pos, metric, div) WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'task-' || CAST(o_orderkey AS VARCHAR), m.pos, m.metric, o_totalprice / m.div FROM orders,
    (VALUES (1, 'exact_match,strict-match', 1e6), (2, 'exact_match_stderr,strict-match', 1e8), (3, 'exact_match,none', 3e6))
      m(pos, metric, div) WHERE o_orderkey % 4 = 1
  UNION ALL SELECT 'task-' || CAST(o_orderkey AS VARCHAR), m.pos, m.metric, o_totalprice / m.div FROM orders,
    (VALUES (1, 'word_perplexity,none', 1e3), (2, 'byte_perplexity,none', 1e4), (3, 'bits_per_byte,none', 1e5))
      m(pos, metric, div) WHERE o_orderkey % 4 = 2)"""
