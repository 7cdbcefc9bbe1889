"""Table sinks.

Every writer targets a directory of part files written by the executors in
parallel (never a single file assembled on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import schemas


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Items as JSON lines."""
    items.select(*[f.name for f in schemas.ITEMS.fields]).write.mode(mode).json(path)


def write_requests_csv(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Request log as CSV in the fixed column order; nulls become empty fields."""
    (requests.select(*schemas.REQUEST_COLUMNS)
     .write.mode(mode).option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path))


def write_example_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-example results, one directory per variant (partition pruning on read)."""
    cols = [f.name for f in schemas.EXAMPLE_RESULTS.fields]
    results.select(*cols).write.mode(mode).partitionBy("variant").parquet(path)


def read_example_results(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """S11 read side; a variant filter only lists that variant's directory."""
    df = spark.read.schema(schemas.EXAMPLE_RESULTS).parquet(path)
    return df.filter(F.col("variant") == variant) if variant is not None else df


def write_task_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long-form task metrics as JSON, one directory per task."""
    metrics.select("task", "pos", "metric", "value").write.mode(mode).partitionBy("task").json(path)


def write_run_meta(spark: SparkSession, meta: dict, path: str, mode: str = "overwrite") -> None:
    """The run's metadata as one JSON row (keys sorted, values as text)."""
    keys = sorted(meta)
    row = spark.createDataFrame([tuple("" if meta[k] is None else str(meta[k]) for k in keys)],
                                ", ".join(f"`{k}` string" for k in keys))
    row.coalesce(1).write.mode(mode).json(path)
