"""Data preparation and prompt construction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark.functions.text import as_continuation, strip_artifacts
from evalspark.operators import prep, prompts

ITEM = "ind string, ctx string, activity_label string, endings array<string>, label int"


def _one(spark, col, *vals, schema="a string, b string"):
    return spark.createDataFrame([vals], schema).select(col).first()[0]


def test_strip_artifacts(spark):
    assert _one(spark, strip_artifacts("a", "b"), "[header: Indoor Cats] Cats The cat", "cats") == "The cat"
    assert _one(spark, strip_artifacts("a", "b"), "[x] Baking: - mix flour", "baking") == "mix flour"
    assert _one(spark, strip_artifacts("a", "b"), "  plain text ", "") == "plain text"
    assert _one(spark, strip_artifacts("a", "b"), "Other words", "cats") == "Other words"


def test_continuation_single_leading_space(spark):
    assert _one(spark, as_continuation("a"), "   sits on the mat", None) == " sits on the mat"
    assert _one(spark, as_continuation("a"), "sits", None) == " sits"


def test_normalise_items(spark):
    raw = spark.createDataFrame([
        (1, None, "first", "second", "act", ["x"], "2"),
        (2, "given", "ignored", "", "act", ["x"], ""),
        (3, "", "", "only b", "act", [], None),
    ], "ind long, ctx string, ctx_a string, ctx_b string, activity_label string, endings array<string>, label string")
    out = {r["ind"]: r for r in prep.normalise_items(raw).collect()}
    assert out["1"]["ctx"] == "first second" and out["1"]["label"] == 2
    assert out["2"]["ctx"] == "given" and out["2"]["label"] == -1
    assert out["3"]["ctx"] == "only b"
    assert prep.labelled(prep.normalise_items(raw)).count() == 1


def test_split_is_disjoint_sized_and_deterministic(spark):
    items = spark.range(100).select(F.col("id").cast("string").alias("ind"))
    a = prep.split_items(items, 30, 20, seed=7)
    b = prep.split_items(items, 30, 20, seed=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"eval": 30, "pool": 20}
    assert a.select("ind").distinct().count() == 50
    with pytest.raises(prep.ContractError):
        prep.split_items(items, 90, 20)


def test_contract(spark):
    qa = spark.createDataFrame([("q1", "Paris"), ("q2", " "), ("q3", "one two three four")], "question string, answer string")
    v = {r["rule"]: r["violations"] for r in prep.check_contract(qa, expected_rows=50).collect()}
    assert v == {"row_count": 47, "blank_question": 0, "blank_answer": 1, "long_answer": 1}
    with pytest.raises(prep.ContractError):
        prep.assert_contract(prep.check_contract(qa, expected_rows=50))


def test_fewshot_pairs_and_fallback(spark):
    items = spark.createDataFrame([("q", "The cat", "cat", [" sits on the mat", " runs"], 0)], ITEM)
    pool = spark.createDataFrame([(1, "Bread is", "baking", [" delicious", " stale"], 0)],
                                 "pool_id long, ctx string, activity_label string, endings array<string>, label int")
    picks = prompts.fewshot_random(items, pool, 5, seed=1)
    assert picks.count() == 1  # k capped at the pool size
    pairs = prompts.fewshot_pairs(items, picks, pool).orderBy("option").collect()
    assert pairs[0]["prompt"] == "Bread is delicious\n\nThe cat"
    assert pairs[0]["continuation"] == " sits on the mat"
    empty = picks.limit(0)
    fallback = prompts.fewshot_pairs(items, empty, pool).orderBy("option").collect()
    clean = prompts.clean_pairs(items).orderBy("option").collect()
    assert [r["prompt"] for r in fallback] == [r["prompt"] for r in clean]


def test_fewshot_random_distinct_and_seeded(spark):
    items = spark.range(50).select(F.col("id").cast("string").alias("ind"))
    pool = spark.range(12).select(F.col("id").alias("pool_id"))
    picks = prompts.fewshot_random(items, pool, 5, seed=3)
    per = picks.groupBy("ind").agg(F.countDistinct("pool_id").alias("d"), F.count("*").alias("n")).collect()
    assert all(r["d"] == 5 and r["n"] == 5 for r in per) and len(per) == 50
    again = prompts.fewshot_random(items, pool, 5, seed=3)
    assert sorted(map(tuple, picks.collect())) == sorted(map(tuple, again.collect()))


def test_variant_registry(spark):
    assert len(prompts.VARIANTS) == 7
    with pytest.raises(KeyError):
        prompts.variant_rows(["nope"])
    items = spark.createDataFrame([("q", "[h] The cat", "", ["a", "b"], 0)], ITEM)
    lad = prompts.build_ladder(items, items.limit(0).select(F.lit(1).cast("long").alias("pool_id"), "*"),
                               ["baseline", "clean_prompt", "length_norm"])
    assert lad.count() == 6
    assert {r["prompt"] for r in lad.filter(F.col("variant") == "clean_prompt").collect()} == {"The cat"}


def test_qa_prompt(spark):
    p = _one(spark, prompts.qa_prompt(F.col("a")), "What is 2+2?", None)
    assert p.endswith("Question: What is 2+2?\nAnswer:")


def test_split_counts_repeated_and_null_ids_row_by_row(spark):
    import hashlib

    ids = [str(i) for i in range(40)] + ["7", "7"]
    items = spark.createDataFrame([(x, n) for n, x in enumerate([*ids, None])], "ind string, n int").repartition(3)
    got = prep.split_items(items, 15, 20, seed=5).collect()
    assert sorted(r["rank"] for r in got) == list(range(35))
    assert sum(r["split"] == "eval" for r in got) == 15
    order = sorted(ids, key=lambda x: (hashlib.md5(f"5:{x}".encode()).hexdigest(), x))
    known = [r["ind"] for r in sorted(got, key=lambda r: r["rank"]) if r["ind"] is not None]
    assert known == order[:len(known)]


def test_prompts_are_built_once_per_item(spark):
    """Below the unrolled endings, and without a filter that builds the endings again; items without endings have no pairs."""
    rows = [("1", "[tag] some words", "act", "a,b"), ("2", "x", "act", None)]
    items = (spark.createDataFrame(rows, "ind string, ctx string, activity_label string, e string")
             .withColumn("endings", F.split(F.col("e"), ",")))
    pairs = prompts.clean_pairs(items)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("regexp_replace(ctx") and plan.count("split(") == 1
    assert sorted((r.ind, r.option, r.prompt, r.continuation) for r in pairs.collect()) == [
        ("1", 0, "some words", " a"), ("1", 1, "some words", " b")]
