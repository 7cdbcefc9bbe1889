"""Cases that once gave wrong results."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.formatting import fixed
from evalspark.functions.indexing import broadcast_if_small
from evalspark.operators import compare, retrieval, runlog
from evalspark.sources import readers


def test_topk_of_an_empty_pool_or_null_first_vectors(spark):
    kind = "id long, v array<double>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], kind)
    none = spark.createDataFrame([], kind).withColumnRenamed("id", "pid")
    assert retrieval.topk_cosine(queries, none, 2, "id", "pid", "v").count() == 0


def test_fixed_decimals_round_like_python(spark):
    values = [5e-7, 3.5e-6, 0.12345, -0.12345, 2.5, 0.5, 1.5, 1e15, 1e23, -1e-9, 0.0, -0.0, 123456.7890125, 0.000125, 1 / 3, float("inf")]
    values += list(np.random.default_rng(0).normal(size=200) * 10) + [round(x, 5) for x in np.random.default_rng(1).uniform(-1, 1, 200)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    for digits in (0, 1, 4, 6):
        got = [r[0] for r in df.select(fixed("v", digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values] + [None, None]


def test_csv_text_of_small_numbers(spark):
    from evalspark import schemas

    row = {f.name: None for f in schemas.RESULT_LOG.fields} | {"run_id": 1, "value": 5e-7, "stderr": 3.5e-6}
    got = runlog.to_csv_columns(spark.createDataFrame([tuple(row.values())], schemas.RESULT_LOG)).first()
    assert (got["value"], got["stderr"], got["delta"]) == ("0.000000", "0.000003", "")


def test_a_task_with_only_nan_metrics_has_a_primary_metric(spark):
    metrics = spark.createDataFrame([("t", 0, "alias", None), ("t", 1, "acc,none", float("nan")), ("u", 0, "alias", None)],
                                    "task string, pos int, metric string, value double")
    (r,) = runlog.primary_metric(metrics).collect()
    assert (r["task"], r["metric"]) == ("t", "acc,none") and math.isnan(r["value"])
    assert [x[0] for x in runlog.tasks_without_metric(metrics).collect()] == ["u"]


def test_bootstraps_check_their_input(spark):
    bad = spark.createDataFrame([("g", 2, 1), ("g", 0, 1)], "k string, baseline int, improved int")
    good = spark.createDataFrame([("g", 0, 1), ("g", 1, 1)], "k string, baseline int, improved int")
    for boot in (compare.paired_bootstrap, compare.paired_bootstrap_portable):
        with pytest.raises(compare.BootstrapError):
            boot(good, ["k"], ci=2.0)
        with pytest.raises(compare.BootstrapError):
            boot(good.limit(0))
        with pytest.raises(Exception, match="0 or 1"):
            boot(bad, ["k"], 50).collect()


def test_broadcast_is_checked_by_bytes(spark):
    wide = spark.range(20).select(F.repeat(F.lit("x"), 1000).alias("t"))
    for limit, hinted in ((10_000, False), (100_000, True)):
        df, n = broadcast_if_small(wide, max_bytes=limit)
        assert n == 20
        assert ("ResolvedHint" in df._jdf.queryExecution().analyzed().toString()) == hinted


def test_outputs_are_numbered_without_gaps(spark, scratch):
    for part in range(3):
        with open(f"{scratch}/part{part}.json", "w") as f:
            f.write("".join(f'{{"output": "{part}-{i}"}}\n\n' for i in range(4)))
    rows = readers.read_outputs(spark, scratch).collect()
    assert sorted(r["index"] for r in rows) == list(range(12))


def test_output_index_follows_input_order(spark, scratch):
    """Files by path whatever their size, and the splits of a long file in their order."""
    sizes = {"a": 1, "b": 5, "c": 4000, "d": 2}
    for name, n in sizes.items():
        with open(f"{scratch}/{name}.jsonl", "w") as f:
            f.write("\n".join(f'{{"output": "{name}{i} {"x" * (i % 37)}"}}\n  ' for i in range(n)))
    want = [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("1024", "10000", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = readers.read_outputs(spark, scratch).collect()
        assert [r.output.split()[0] for r in sorted(rows, key=lambda r: r["index"])] == want
        assert sorted(r["index"] for r in rows) == list(range(len(want)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert readers.read_outputs(spark, f"{scratch}/a.jsonl").first()["index"] == 0
