"""Sources and sinks: JSONL items, QA split, request CSV, outputs, partitioned results, metrics."""

from __future__ import annotations

import json
import os

import pytest

from evalspark.sources import readers, writers


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_items_jsonl_blank_lines_and_roundtrip(spark, scratch):
    p = os.path.join(scratch, "items.jsonl")
    _write(p, [json.dumps({"ind": "a", "ctx": "c", "activity_label": "x", "endings": ["1", "2"], "label": 1}), "",
               json.dumps({"ind": "b", "ctx": "d", "activity_label": "y", "endings": ["3"], "label": -1})])
    df = readers.read_items(spark, p)
    assert df.count() == 2
    writers.write_items(df, os.path.join(scratch, "out"))
    back = readers.read_items(spark, os.path.join(scratch, "out"))
    assert sorted(r["ind"] for r in back.collect()) == ["a", "b"]


def test_items_malformed_line_fails(spark, scratch):
    p = os.path.join(scratch, "bad.jsonl")
    _write(p, [json.dumps({"ind": "a", "ctx": "c", "endings": [], "label": 0}), "{not json"])
    with pytest.raises(Exception):
        readers.read_items(spark, p).collect()


def test_missing_file_fails(spark, scratch):
    with pytest.raises(Exception):
        readers.read_items(spark, os.path.join(scratch, "nope.jsonl")).collect()


def test_qa_split(spark, scratch):
    p = os.path.join(scratch, "qa.jsonl")
    _write(p, [json.dumps({"question": "Capital of France?", "answer": "Paris"})])
    assert readers.read_qa(spark, p).first()["answer"] == "Paris"


def test_request_csv_roundtrip(spark, scratch):
    from evalspark import schemas
    rows = [(0, "long", 384, 256, "stream", 4.5, 0.1, 256, "ok", None, 100.0, 104.5),
            (1, "short", 18, 32, "generate", 0.6, None, 32, "error", "HTTP 500", 100.0, 100.6)]
    df = spark.createDataFrame(rows, schemas.REQUEST_METRICS)
    writers.write_requests_csv(df, os.path.join(scratch, "m"))
    header = open([os.path.join(scratch, "m", f) for f in os.listdir(os.path.join(scratch, "m"))
                   if f.endswith(".csv")][0]).readline().strip()
    assert header == ",".join(schemas.REQUEST_COLUMNS)
    back = {r["idx"]: r for r in readers.read_requests(spark, os.path.join(scratch, "m")).collect()}
    assert back[1]["ttft_s"] is None and back[1]["error"] == "HTTP 500" and back[0]["wall_s"] == 4.5


def test_outputs_coerced_to_text(spark, scratch):
    p = os.path.join(scratch, "outputs.jsonl")
    _write(p, [json.dumps({"output": "Paris"}), json.dumps({"output": 3}), json.dumps({"other": 1}), "",
               json.dumps({"output": True}), json.dumps({"output": None}), json.dumps({"output": 0.5})])
    rows = readers.read_outputs(spark, p).orderBy("index").collect()
    assert [r["output"] for r in rows] == ["Paris", "3", "", "True", "None", "0.5"]


def test_example_results_partitioned_by_variant(spark, scratch):
    rows = [(1, "baseline", "a", 0, 0, True, [-1.0, -2.0]), (1, "length_norm", "a", 0, 1, False, [-2.0, -1.0])]
    from evalspark import schemas
    df = spark.createDataFrame(rows, schemas.EXAMPLE_RESULTS)
    path = os.path.join(scratch, "results")
    writers.write_example_results(df, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("variant=")) == ["variant=baseline", "variant=length_norm"]
    one = writers.read_example_results(spark, path, "length_norm")
    assert [r["predicted"] for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(variant" in one._jdf.queryExecution().executedPlan().toString()


def test_task_metrics_and_meta(spark, scratch):
    m = spark.createDataFrame([("hs", 1, "acc,none", 0.5)], "task string, pos int, metric string, value double")
    writers.write_task_metrics(m, os.path.join(scratch, "tm"))
    assert os.path.isdir(os.path.join(scratch, "tm", "task=hs"))
    writers.write_run_meta(spark, {"model": "m", "seed": 42, "limit": None}, os.path.join(scratch, "meta"))
    meta = spark.read.json(os.path.join(scratch, "meta")).first()
    assert (meta["model"], meta["seed"], meta["limit"]) == ("m", "42", "")
