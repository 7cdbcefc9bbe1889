"""Registered queries: output guardrails."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.text import truncate_at_stops
from evalspark.operators import guard
from evalspark.plans import sql_fragments as Q
from evalspark.plans import views as V
from evalspark.plans.queries_compare import _PRED_SQL, _results
from evalspark.plans.queries_scoring import QA_STOPS, _trunc_sql
from evalspark.plans.registry import finish, register
from evalspark.sources.readers import read_table


def _repr_sql(v: str) -> str:
    # DuckDB string literals take backslashes literally; '' is one single quote.
    esc = (f"replace(replace(replace(replace({v}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), "
           f"chr(9), '\\t')")
    return (f"CASE WHEN strpos({v}, '''') > 0 AND strpos({v}, '\"') = 0 THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


# Every third output is a letter that its length gives, the others are validated as they are.
_LETTER = "CASE WHEN turn % 3 = 0 THEN chr(CAST(65 + length(output) % 7 AS INTEGER)) || CASE WHEN turn % 2 = 0 THEN '.' ELSE '' END ELSE output END"


@register("g1_mcq_letter", f"""
WITH v AS (SELECT conv_id, turn, {_LETTER} AS value FROM generations)
SELECT conv_id, turn, value,
  coalesce(CASE WHEN value IS NULL THEN 'None is not of type ''string'''
                WHEN NOT regexp_matches(value, '^[A-E]\\.?$') THEN {_repr_sql('value')} || ' does not match ''^[A-E]\\.?$''' END, '')
    AS error
FROM v""", ["generations"])
def g1_mcq_letter(spark, sf):
    g = V.generations(spark, sf).select(
        "conv_id", "turn",
        F.when(F.col("turn") % 3 == 0, F.concat(F.char(65 + F.char_length("output") % 7), F.when(F.col("turn") % 2 == 0, ".").otherwise("")))
        .otherwise(F.col("output")).alias("value"))
    return finish(guard.validate(g, "value", "mcq_letter").select("conv_id", "turn", "value", "error"))


_SA_PATTERN = "^[A-Za-z0-9][A-Za-z0-9 .,''-]{0,78}[A-Za-z0-9]$|^[A-Za-z0-9]$"


@register("g1_short_answer_schema", f"""
SELECT qid, answer,
  coalesce(CASE WHEN answer IS NULL THEN 'None is not of type ''string'''
    WHEN length(answer) < 1 THEN {_repr_sql('answer')} || ' is too short'
    WHEN length(answer) > 80 THEN {_repr_sql('answer')} || ' is too long'
    WHEN NOT regexp_matches(answer, '{_SA_PATTERN}') THEN {_repr_sql('answer')} || ' does not match ''{_SA_PATTERN}'''
  END, '') AS error
FROM qa_items""", ["qa_items"])
def g1_short_answer_schema(spark, sf):
    qa = V.qa_items(spark, sf)
    return finish(guard.validate(qa, "answer", "short_answer").select("qid", "answer", "error"))


DOC_SCHEMA = {
    "type": "object", "required": ["id", "lang", "parts"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 3}, "lang": {"enum": ["en", "de", "fr"]},
                   "parts": {"type": "array", "maxItems": 2,
                             "items": {"anyOf": [{"type": "integer", "minimum": 300}, {"type": "string", "pattern": "^src1"}]}}},
}


@register("g1_nested_schema", """
WITH d AS (SELECT doc_id, lang, source, length(text) AS n FROM documents)
SELECT doc_id, CASE
  WHEN doc_id % 7 = 0 THEN '''lang'' is a required property'
  WHEN doc_id < 3 THEN '$.id: ' || doc_id || ' is less than the minimum of 3'
  WHEN lang NOT IN ('en', 'de', 'fr') THEN '$.lang: ''' || lang || ''' is not one of [''en'', ''de'', ''fr'']'
  WHEN n < 300 THEN '$.parts[0]: ' || n || ' is not valid under any of the given schemas'
  WHEN NOT starts_with(source, 'src1') THEN '$.parts[1]: ''' || source || ''' is not valid under any of the given schemas'
  WHEN doc_id % 4 = 0 THEN '$.parts: [' || n || ',"' || source || '",999] is too long'
  WHEN doc_id % 6 = 0 THEN 'Additional properties are not allowed (''extra'' was unexpected)' ELSE '' END AS error
FROM d""")
def g1_nested_schema(spark, sf):
    """A schema of objects, arrays, enum and anyOf over a JSON text per document."""
    d = read_table(spark, sf, "documents")
    put = lambda when, text: F.when(when, F.lit(text)).otherwise("")
    doc = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"),
                   F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit(', "lang": "'), "lang", F.lit('"'))),
                   F.lit(', "parts": ['), F.char_length("text").cast("string"), F.lit(', "'), F.col("source"), F.lit('"'),
                   put(F.col("doc_id") % 4 == 0, ", 999"), F.lit("]"), put(F.col("doc_id") % 6 == 0, ', "extra": 1'), F.lit("}"))
    return finish(guard.validate_json(d.select("doc_id", doc.alias("doc")), "doc", DOC_SCHEMA).select("doc_id", "error"))


@register("g1_option_index", """
WITH v AS (SELECT doc_id, CAST(doc_id % 6 - 1 AS BIGINT) AS k, (doc_id % 12) / 2.0 - 1.0 AS x FROM documents)
SELECT doc_id, k, round(x, 9) AS x,
  coalesce(CASE WHEN k < 0 THEN CAST(k AS VARCHAR) || ' is less than the minimum of 0'
                WHEN k > 3 THEN CAST(k AS VARCHAR) || ' is greater than the maximum of 3' END, '') AS error_int,
  coalesce(CASE WHEN x <> floor(x) THEN CAST(x AS VARCHAR) || ' is not of type ''integer'''
                WHEN x < 0 THEN CAST(x AS VARCHAR) || ' is less than the minimum of 0'
                WHEN x > 3 THEN CAST(x AS VARCHAR) || ' is greater than the maximum of 3' END, '') AS error_float
FROM v""")
def g1_option_index(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 6 - 1).alias("k"), ((F.col("doc_id") % 12) / 2.0 - 1.0).alias("x"))
    a = guard.validate(d, "k", "hellaswag_option_index").withColumnRenamed("error", "error_int").drop("valid")
    b = guard.validate(a, "x", "hellaswag_option_index").withColumnRenamed("error", "error_float").drop("valid")
    return finish(b)


def _sa_sql(v: str) -> str:
    n = Q.word_count(v)
    return f"""CASE WHEN {v} IS NULL THEN 'output is empty'
    WHEN {v} <> {Q.strip_ws(v)} THEN 'output has leading/trailing whitespace'
    WHEN {v} = '' THEN 'output is empty'
    WHEN regexp_matches({v}, '[^\\x00-\\x7F]') THEN 'output contains non-ASCII characters'
    WHEN {n} > 3 THEN 'output has ' || CAST({n} AS VARCHAR) || ' tokens, max is 3'
    WHEN regexp_matches({v}, '[.?!]\\n?$') THEN 'output ends in punctuation (.?!)' END"""


_TRUNC_CTE = f"""t AS (SELECT conv_id, turn, model, conv_id * 100000 + turn AS idx, {_trunc_sql('output')} AS output
  FROM generations),
rec AS (SELECT *, coalesce({_sa_sql('output')}, '') AS error FROM t)"""


def _records(spark, sf):
    g = V.generations(spark, sf)
    stops = F.array(*[F.lit(s) for s in QA_STOPS])
    t = g.select("conv_id", "turn", "model", (F.col("conv_id") * 100000 + F.col("turn")).alias("idx"),
                 truncate_at_stops("output", stops).alias("output"))
    return guard.validate(t, "output", short_answer=True)


@register("g2_short_answer_rule", f"""
WITH {_TRUNC_CTE}
SELECT conv_id, turn, output, error, error = '' AS valid FROM rec""", ["generations"])
def g2_short_answer_rule(spark, sf):
    return finish(_records(spark, sf).select("conv_id", "turn", "output", "error", "valid"))


@register("g3_validation_summary", f"""
WITH {_TRUNC_CTE}
SELECT model, count(*) AS total, count(*) FILTER (WHERE error = '') AS valid,
  count(*) FILTER (WHERE error <> '') AS invalid,
  round(count(*) FILTER (WHERE error = '') / count(*), 9) AS valid_rate
FROM rec GROUP BY model""", ["generations"])
def g3_validation_summary(spark, sf):
    return finish(guard.validation_summary(_records(spark, sf), ["model"]))


@register("g4_invalid_report", f"""
WITH {_TRUNC_CTE}
SELECT idx, output, error FROM rec WHERE error <> '' ORDER BY idx LIMIT 20""", ["generations"])
def g4_invalid_report(spark, sf):
    return finish(guard.invalid_report(_records(spark, sf), "idx", 20).select("idx", "output", "error"))


_DET_SQL = """
WITH f AS (SELECT prompt, count(*) AS n_runs, arg_min(text, run) AS first_text FROM repeats GROUP BY prompt),
d AS (SELECT r.prompt, min(r.run) FILTER (WHERE r.text IS DISTINCT FROM f.first_text) AS first_divergence_at
      FROM repeats r JOIN f ON r.prompt = f.prompt GROUP BY r.prompt)
SELECT f.prompt, f.n_runs, f.first_text, d.first_divergence_at IS NULL AS identical,
       CASE WHEN d.first_divergence_at IS NULL THEN -1 ELSE (SELECT count(*) FROM repeats q
         WHERE q.prompt = f.prompt AND q.run < d.first_divergence_at) END AS first_divergence_at,
       coalesce(CASE WHEN f.n_runs < 2 THEN 'requires n_runs >= 2' END, '') AS error
FROM f JOIN d ON f.prompt = d.prompt"""


def _det(log):
    rep = guard.determinism_report(log)
    return finish(rep.fillna(-1, ["first_divergence_at"]).fillna("", ["error"]))


@register("g5_determinism", _DET_SQL, ["repeats"])
def g5_determinism(spark, sf):
    return _det(V.repeats(spark, sf))


@register("g5_determinism_by_lang", _DET_SQL.replace("FROM repeats", "FROM repeats_l").replace(
    "WITH f AS", "WITH repeats_l AS (SELECT prompt || '/' || lang AS prompt, run, text FROM repeats),\nf AS"),
          ["repeats"])
def g5_determinism_by_lang(spark, sf):
    r = V.repeats(spark, sf)
    return _det(r.select(F.concat_ws("/", "prompt", "lang").alias("prompt"), "run", "text"))


@register("g6_prediction_gate", f"""
WITH {_PRED_SQL}
SELECT variant, count(*) AS total, count(*) FILTER (WHERE predicted BETWEEN 0 AND 3) AS valid,
  count(*) FILTER (WHERE NOT predicted BETWEEN 0 AND 3) AS invalid,
  round(count(*) FILTER (WHERE predicted BETWEEN 0 AND 3) / count(*), 9) AS valid_rate
FROM results GROUP BY variant""", ["lp_tokens"])
def g6_prediction_gate(spark, sf):
    return finish(guard.validation_summary(guard.gate_predictions(_results(spark, sf)), ["variant"]))
