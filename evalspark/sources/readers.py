"""Table sources.

All readers declare their schema up front (no inference pass over the data)
so a scan of a large folder is a single, pruned, pushed-down read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.joins import join_small


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base parquet table of a data folder (``<dir>/<name>.parquet``)."""
    return with_min_parallelism(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def with_min_parallelism(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores.

    A single small file (one row group) is read by one task, and every narrow
    step after it (tokenising, hashing) would run on one core. Such inputs get
    a round-robin repartition to the default parallelism; inputs of several
    splits are returned as they are, so no shuffle is added at scale. Filters and column pruning still
    reach the scan through the repartition.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() == 1:
        return df.repartition(target)
    return df


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items as JSONL. Blank lines are skipped; a malformed line fails the job."""
    return spark.read.schema(schemas.ITEMS).option("mode", "FAILFAST").json(path)


def read_raw_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw benchmark items (D2) as JSONL; the label may be a string or missing."""
    return spark.read.schema(schemas.RAW_ITEMS).option("mode", "FAILFAST").json(path)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """S3: question / answer JSONL (the named split is the path)."""
    return spark.read.schema(schemas.QA_ITEMS).option("mode", "FAILFAST").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """S4 + M5: request-log CSV; empty fields are null, bad numbers become null, tokens default 0."""
    raw = (
        spark.read.schema(schemas.REQUEST_METRICS_RAW)
        .option("header", "true")
        .option("nullValue", "")
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return coerce_requests(raw)


def coerce_requests(raw: DataFrame) -> DataFrame:
    """M5: cast every numeric field with ``try_cast`` (bad value → null); tokens null → 0."""
    def num(c: str, t: str):
        return F.expr(f"try_cast(nullif(trim(cast(`{c}` as string)), '') as {t})")

    return raw.select(
        num("idx", "bigint").alias("idx"),
        F.col("prompt_kind").cast("string").alias("prompt_kind"),
        num("prompt_chars", "int").alias("prompt_chars"),
        num("max_tokens", "int").alias("max_tokens"),
        F.col("mode").cast("string").alias("mode"),
        num("wall_s", "double").alias("wall_s"),
        num("ttft_s", "double").alias("ttft_s"),
        F.coalesce(num("output_tokens", "double").cast("int"), F.lit(0)).alias("output_tokens"),
        F.col("status").cast("string").alias("status"),
        F.col("error").cast("string").alias("error"),
        num("started_at", "double").alias("started_at"),
        num("ended_at", "double").alias("ended_at"),
    )


def read_result_log(spark: SparkSession, path: str) -> DataFrame:
    """Result-log CSV. Empty → null, bad numbers → null, timestamp parsed (UTC)."""
    raw = (
        spark.read.schema(schemas.RESULT_LOG_RAW)
        .option("header", "true")
        .option("nullValue", "")
        .csv(path)
    )
    return coerce_result_log(raw)


def coerce_result_log(raw: DataFrame) -> DataFrame:
    """Typed result-log columns from string columns."""
    def num(c: str, t: str):
        return F.expr(f"try_cast(nullif(trim(`{c}`), '') as {t})")

    return raw.select(
        num("run_id", "bigint").alias("run_id"),
        F.expr("try_to_timestamp(nullif(trim(`timestamp`), ''))").alias("timestamp"),
        "commit", "model", "task", "method",
        num("limit", "int").alias("limit"),
        num("num_fewshot", "int").alias("num_fewshot"),
        num("seed", "bigint").alias("seed"),
        "metric",
        num("value", "double").alias("value"),
        num("stderr", "double").alias("stderr"),
        num("delta", "double").alias("delta"),
        num("ci95_low", "double").alias("ci95_low"),
        num("ci95_high", "double").alias("ci95_high"),
        num("wall_s", "double").alias("wall_s"),
        (F.lower(F.trim("mock_backend")) == "true").alias("mock_backend"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
    )


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Outputs JSONL for validation; ``output`` becomes text as Python's ``str`` would print it.

    Strings stay as they are, ``true``/``false`` become ``True``/``False``, a
    JSON ``null`` becomes ``None``, numbers keep their JSON text, and a missing
    key gives ``''`` (lists and objects keep their JSON text). ``index`` is the
    line's 0-based position among the non-blank lines, in input order: files
    by path, a file's lines as they stand. Lines are counted per split (file
    and block start), and a split's first index is the count of those before;
    the texts aren't sorted.
    """
    txt = (spark.read.text(path).filter(F.trim("value") != "")
           .select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")))
    v = F.try_parse_json("value")
    o = F.variant_get(v, "$.output", "variant")
    kind = F.schema_of_variant(o)
    out = (
        F.when(o.isNull(), F.lit(""))
        .when(F.is_variant_null(o), F.lit("None"))
        .when(kind == "BOOLEAN", F.when(F.variant_get(o, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
        .when(kind == "STRING", F.variant_get(o, "$", "string"))
        .otherwise(F.to_json(o))
    )
    # a split's lines are read one after the other by one task, so the ids of a split have no gaps
    placed = txt.select("_path", "_block", F.monotonically_increasing_id().alias("_at"), out.alias("output")).checkpoint()
    splits = placed.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)   # one row per split
    starts = splits.select("_path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return join_small(placed, starts, ["_path", "_block"]).select((F.col("_start") + F.col("_at") - F.col("_first")).alias("index"), "output")


def parse_gpu_samples(lines: DataFrame, text_col: str = "value", ts_col: str | None = None,
                      keep: list[str] | None = None) -> DataFrame:
    """GPU sampler text (``", "``-separated, 7 fields) into typed rows; blank lines dropped.

    Unparseable and missing fields become null; ``keep`` carries other columns along.
    """
    parts = F.split(F.trim(F.col(text_col)), r",\s*")
    fields = ["index", "util_gpu", "util_mem", "mem_used", "mem_total", "temp", "power"]
    types = ["int"] + ["double"] * 6
    cols = [F.expr(f"try_cast(trim(get(_parts, {i})) as {t})").alias(f)
            for i, (f, t) in enumerate(zip(fields, types))]
    base = lines.filter(F.trim(F.col(text_col)) != "").withColumn("_parts", parts)
    carried = [F.col(c) for c in (keep or [])] + ([F.col(ts_col).alias("timestamp")] if ts_col else [])
    return base.select(*carried, *cols)


def read_gpu_samples(spark: SparkSession, path: str) -> DataFrame:
    """S10 from files: ``timestamp, index, util, ...`` CSV lines without a header."""
    return spark.read.schema(schemas.GPU_SAMPLES).option("nullValue", "").csv(path, ignoreLeadingWhiteSpace=True)
