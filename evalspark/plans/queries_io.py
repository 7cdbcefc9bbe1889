"""Registered queries: every source and sink as a round trip.

Each query writes a whole derived table with the library's writer to a new
folder under ``spark.checkpoint.dir`` (shared on a cluster), reads it back
with the library's reader and returns what was read; the oracle computes the
same rows from the base tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions import logprob as LP
from evalspark.operators import perf, runlog, scoring
from evalspark.plans import views as V
from evalspark.plans.queries_compare import _PRED_SQL
from evalspark.plans.registry import finish, register
from evalspark.session import ensure_checkpoint_dir
from evalspark.sources import readers, writers


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s1_s2_items_jsonl", """
SELECT ind, md5(ctx) AS ctx_md5, activity_label, md5(array_to_string(endings, '|')) AS endings_md5, CAST(label AS BIGINT) AS label
FROM items""", ["items"])
def s1_s2_items_jsonl(spark, sf):
    path = _folder(spark, "items")
    writers.write_items(V.items(spark, sf), path)
    return finish(readers.read_items(spark, path).select(
        "ind", F.md5("ctx").alias("ctx_md5"), "activity_label", F.md5(F.array_join("endings", "|")).alias("endings_md5"), "label"))


@register("s3_qa_jsonl", """
SELECT md5(question || '|' || answer) AS pair_md5, count(*) AS n FROM qa_items GROUP BY 1""", ["qa_items"])
def s3_qa_jsonl(spark, sf):
    path = _folder(spark, "qa")
    V.qa_items(spark, sf).select("question", "answer").write.json(path)
    pair = F.md5(F.concat_ws("|", "question", "answer"))
    return finish(readers.read_qa(spark, path).groupBy(pair.alias("pair_md5")).agg(F.count("*").alias("n")))


@register("s4_s5_requests_csv", """
SELECT idx, prompt_kind, CAST(prompt_chars AS BIGINT) AS prompt_chars, CAST(max_tokens AS BIGINT) AS max_tokens, mode,
  round(wall_s, 9) AS wall_s, round(ttft_s, 9) AS ttft_s, CAST(coalesce(output_tokens, 0) AS BIGINT) AS output_tokens, status,
  error, round(started_at, 6) AS started_at, round(ended_at, 6) AS ended_at
FROM requests""", ["requests"])
def s4_s5_requests_csv(spark, sf):
    path = _folder(spark, "requests")
    writers.write_requests_csv(V.requests(spark, sf), path)
    back = readers.read_requests(spark, path)
    return finish(back.withColumn("started_at", F.round("started_at", 6)).withColumn("ended_at", F.round("ended_at", 6)))


_SIX = "CAST(printf('%.6f', {0}) AS DOUBLE) AS {0}"


@register("s6_result_log_csv", f"""
SELECT run_id, CAST(epoch(CAST(timestamp AS TIMESTAMP)) AS BIGINT) AS at, commit, model, task, method, CAST(coalesce("limit", -1) AS BIGINT) AS "limit",
  CAST(num_fewshot AS BIGINT) AS num_fewshot, CAST(seed AS BIGINT) AS seed, metric, {_SIX.format('value')}, {_SIX.format('stderr')},
  {_SIX.format('delta')}, {_SIX.format('ci95_low')}, {_SIX.format('ci95_high')}, {_SIX.format('wall_s')}, mock_backend,
  trim(replace(notes, chr(10), ' ')) AS notes
FROM runs""", ["runs"])
def s6_result_log_csv(spark, sf):
    path = _folder(spark, "log")
    log = V.runs(spark, sf).withColumn("notes", F.trim(F.regexp_replace("notes", "\n", " ")))
    runlog.write_result_log(log.select(*schemas.RESULT_LOG_COLUMNS), path)
    back = readers.read_result_log(spark, path)
    return finish(back.withColumn("at", F.unix_timestamp("timestamp")).drop("timestamp").fillna(-1, ["limit"]))


@register("s9_outputs_jsonl", """
SELECT md5(output) AS output_md5, count(*) AS n, true AS numbered FROM generations GROUP BY 1""", ["generations"])
def s9_outputs_jsonl(spark, sf):
    path = _folder(spark, "outputs")
    V.generations(spark, sf).select("output").write.json(path)
    back = readers.read_outputs(spark, path)
    last, n, kinds = back.agg(F.max("index"), F.count("*"), F.count_distinct("index")).first()
    numbered = n == kinds and last == n - 1 if n else True
    return finish(back.groupBy(F.md5("output").alias("output_md5")).agg(F.count("*").alias("n")).withColumn("numbered", F.lit(numbered)))


@register("s11_example_results", f"""
WITH {_PRED_SQL},
lists AS (SELECT ind, list(round(score_length_norm, 9) ORDER BY option) AS scores FROM modes GROUP BY ind)
SELECT variant, ind, CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, correct, scores
FROM results JOIN lists USING (ind) WHERE variant = 'length_norm'""", ["lp_tokens"])
def s11_example_results(spark, sf):
    """Every variant's results with the scores of all options, one variant read back."""
    path = _folder(spark, "results")
    s = scoring.option_scores(V.logprob_payloads(spark, sf))
    long = s.select("ind", "option", F.explode(F.array(*[
        F.struct(F.lit("baseline" if m == "sum" else m).alias("variant"), F.round(F.col(f"score_{m}"), 9).alias("score"))
        for m in LP.SCORING_MODES])).alias("m")).select("ind", "option", "m.*").checkpoint()
    lists = long.groupBy("ind", "variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("option", "score"))), lambda x: x["score"]).alias("scores"))
    flags = scoring.mark_correct(scoring.predict_long(long, "score", ["ind", "variant"]), V.items(spark, sf).select("ind", "label"))
    rows = flags.join(lists, ["ind", "variant"]).withColumn("run_id", F.lit(1).cast("long"))
    writers.write_example_results(rows, path)
    return finish(writers.read_example_results(spark, path, "length_norm").select("variant", "ind", "label", "predicted", "correct", "scores"))


@register("s12_run_meta", """
SELECT CAST((SELECT count(*) FROM items) AS VARCHAR) AS "limit", (SELECT max(model) FROM runs) AS model, '' AS notes, '42' AS seed""",
          ["items", "runs"])
def s12_run_meta(spark, sf):
    """A run's metadata written and read back: sorted keys, values as text, nothing as empty text."""
    path = _folder(spark, "meta")
    model = V.runs(spark, sf).agg(F.max("model")).first()[0]
    writers.write_run_meta(spark, {"seed": 42, "model": model, "notes": None, "limit": V.items(spark, sf).count()}, path)
    return finish(spark.read.schema("`limit` string, model string, notes string, seed string").json(path))


@register("s12_task_metrics", """
SELECT task, CAST(num_fewshot AS BIGINT) AS pos, metric, round(avg(value), 9) AS value FROM runs GROUP BY task, num_fewshot, metric""", ["runs"])
def s12_task_metrics(spark, sf):
    path = _folder(spark, "metrics")
    rows = V.runs(spark, sf).groupBy("task", F.col("num_fewshot").alias("pos"), "metric").agg(F.avg("value").alias("value"))
    writers.write_task_metrics(rows, path)
    return finish(spark.read.schema(schemas.TASK_METRICS).json(path))


@register("l13_fold_text", """
WITH done AS (SELECT request_id, min({'t': ts, 's': seq}) AS d FROM sse_lines WHERE value = 'data: [DONE]' GROUP BY request_id),
c AS (SELECT l.request_id, l.ts, l.seq, coalesce(json_extract_string(substr(l.value, 7), '$.choices[0].text'), '') AS delta
  FROM sse_lines l LEFT JOIN done ON l.request_id = done.request_id
  WHERE starts_with(l.value, 'data: ') AND l.value <> 'data: [DONE]' AND (done.d IS NULL OR {'t': l.ts, 's': l.seq} < done.d))
SELECT request_id, string_agg(delta, '' ORDER BY ts, seq) AS text FROM c GROUP BY request_id""", ["sse_lines"])
def l13_fold_text(spark, sf):
    return finish(perf.fold_text(perf.parse_sse_lines(V.sse_lines(spark, sf), arrival="seq"), "seq"))
