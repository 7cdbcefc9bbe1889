"""Task metrics and the append-only result log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.formatting import fixed
from evalspark.functions.indexing import with_row_index

# Preferred primary-metric names and their stderr names, in order.
METRIC_PREFERENCE = (
    "acc_norm,none",
    "acc,none",
    "exact_match,exact_match",
    "exact_match,none",
    "acc_norm",
    "acc",
    "exact_match",
)
STDERR_PREFERENCE = (
    "acc_norm_stderr,none",
    "acc_stderr,none",
    "exact_match_stderr,exact_match",
    "exact_match_stderr,none",
    "acc_norm_stderr",
    "acc_stderr",
    "exact_match_stderr",
)


def _pref_map(names: Sequence[str]) -> Column:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])


def primary_metric(metrics: DataFrame) -> DataFrame:
    """A4: primary ``(metric, value, stderr)`` per task from long-form metrics.

    ``metrics`` has ``task, pos, metric, value DOUBLE`` (value null = not
    numeric). The metric is the first name of the preference list present
    with a numeric value, its stderr the first numeric name of the stderr list;
    without a preferred name, the first numeric metric by ``pos`` with a null
    stderr. Tasks without any numeric metric are absent (see
    :func:`tasks_without_metric`). Small literal maps replace a join; the
    per-task reduction is a partial ``min_by`` aggregate.
    """
    num = metrics.filter(F.col("value").isNotNull())  # NaN is a number here, as in the summary and the check
    pref = F.element_at(_pref_map(METRIC_PREFERENCE), F.col("metric"))
    spref = F.element_at(_pref_map(STDERR_PREFERENCE), F.col("metric"))
    rank = F.coalesce(pref, F.lit(len(METRIC_PREFERENCE)) + F.col("pos"))
    agg = num.groupBy("task").agg(
        F.min_by(F.struct(F.col("metric"), F.col("value")), F.struct(rank, F.col("pos"))).alias("_best"),
        F.min(pref).alias("_has_pref"),
        F.min_by(F.when(spref.isNotNull(), F.col("value")),
                 F.struct(F.coalesce(spref, F.lit(1 << 30)), F.col("pos"))).alias("_se"),
    )
    return agg.select(
        "task",
        F.col("_best.metric").alias("metric"),
        F.col("_best.value").alias("value"),
        F.when(F.col("_has_pref").isNotNull(), F.col("_se")).alias("stderr"),
    )


def tasks_without_metric(metrics: DataFrame) -> DataFrame:
    """Tasks that have no numeric metric (the reference raises for these)."""
    return metrics.groupBy("task").agg(F.count_if(F.col("value").isNotNull()).alias("_k")).filter("_k = 0").select("task")


def summary_long(metrics: DataFrame) -> DataFrame:
    """A5: numeric metrics only, in task / insertion order."""
    return metrics.filter(F.col("value").isNotNull()).select("task", "pos", "metric", "value").orderBy("task", "pos")


def log_rows(primary: DataFrame, meta: dict) -> DataFrame:
    """One result-log row per task from the primary metric and run metadata."""
    lit = lambda k, t: F.lit(meta.get(k)).cast(t)
    return primary.select(
        lit("model", "string").alias("model"), "task", lit("method", "string").alias("method"),
        lit("limit", "int").alias("limit"), lit("num_fewshot", "int").alias("num_fewshot"),
        lit("seed", "bigint").alias("seed"), "metric", "value", "stderr",
        F.lit(None).cast("double").alias("delta"), F.lit(None).cast("double").alias("ci95_low"),
        F.lit(None).cast("double").alias("ci95_high"), lit("wall_s", "double").alias("wall_s"),
        F.lit(bool(meta.get("mock_backend", False))).alias("mock_backend"),
        F.lit(meta.get("notes", "")).alias("notes"),
    )


def append_results(log: DataFrame, new: DataFrame, order: Sequence[str], commit: str = "",
                   timestamp: Column | None = None) -> DataFrame:
    """The rows to append, numbered ``max(run_id) + 1, + 2, ...`` (from 1 on an empty log).

    ``order`` fixes the numbering of the new rows; the timestamp is the current
    UTC time unless given; newlines in text become spaces and text is trimmed.
    The next id comes from a single max aggregate (one number), the per-row
    offset from a distributed contiguous index.
    """
    # The next id is one number (as the log format itself reads it).
    start = log.agg(F.max("run_id")).first()[0] or 0
    j = with_row_index(new, list(order), "_i").withColumn("_max", F.lit(start).cast("bigint"))
    ts = timestamp if timestamp is not None else F.current_timestamp()
    clean = lambda c: F.trim(F.regexp_replace(F.col(c), "\n", " "))
    cols = []
    for c in schemas.RESULT_LOG_COLUMNS:
        if c == "run_id":
            cols.append((F.col("_max") + F.col("_i") + 1).cast("bigint").alias("run_id"))
        elif c == "timestamp":
            cols.append(ts.cast("timestamp").alias("timestamp"))
        elif c == "commit":
            cols.append(F.lit(commit).alias("commit"))
        elif c in ("model", "task", "method", "metric", "notes"):
            cols.append(clean(c).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def to_csv_columns(log: DataFrame) -> DataFrame:
    """S7 text form: floats with 6 decimals, booleans true/false, null → empty."""
    out = []
    for f in schemas.RESULT_LOG.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() == "double":
            s = fixed(c, 6)
        elif f.dataType.simpleString() == "boolean":
            s = F.when(c, "true").when(~c, "false")
        elif f.dataType.simpleString() == "timestamp":
            s = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
        else:
            s = c.cast("string")
        out.append(F.coalesce(s, F.lit("")).alias(f.name))
    return log.select(*out)


def write_result_log(log: DataFrame, path: str) -> None:
    """S7 sink: append rows as CSV (header, stable column order, null → empty)."""
    to_csv_columns(log).write.mode("append").option("header", "true").option("emptyValue", "").csv(path)


def result_log_view(log: DataFrame) -> DataFrame:
    """Display projection: 4-decimal value, signed delta, ``[lo, hi]``, ``full``, yes/no."""
    delta = F.when(F.col("delta").isNull(), F.lit("")).otherwise(
        F.concat(F.when(F.col("delta") >= 0, F.lit("+")).otherwise(F.lit("")), fixed("delta", 4)))
    ci = F.when(F.col("ci95_low").isNotNull() & F.col("ci95_high").isNotNull(),
                F.concat(F.lit("["), fixed("ci95_low", 6), F.lit(", "), fixed("ci95_high", 6), F.lit("]"))
                ).otherwise(F.lit(""))
    return log.select(
        "run_id",
        F.substring(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), 1, 19).alias("when"),
        "commit", "task", "method",
        F.coalesce(F.col("limit").cast("string"), F.lit("full")).alias("limit"),
        "metric",
        F.coalesce(fixed("value", 4), F.lit("")).alias("value"),
        delta.alias("delta"),
        ci.alias("ci95"),
        F.when(F.col("wall_s").isNull(), F.lit("")).otherwise(F.concat(fixed("wall_s", 1), F.lit("s"))).alias("wall"),
        F.when(F.col("mock_backend"), "yes").otherwise("no").alias("mock"),
    )


def leaderboard(log: DataFrame) -> DataFrame:
    """Per (task, method): run count, last non-null value (by run id), mean wall; by last value desc."""
    return log.groupBy("task", "method").agg(
        F.count("run_id").alias("n_runs"),
        # Null ordering values are skipped, so this is the last non-null value.
        F.max_by(F.col("value"), F.when(F.col("value").isNotNull(), F.col("run_id"))).alias("last_value"),
        F.avg("wall_s").alias("mean_wall_s"),
    ).orderBy(F.desc_nulls_last("last_value"))


def latest_runs(log: DataFrame, columns: Sequence[str] = ("run_id", "value", "wall_s", "delta")) -> DataFrame:
    """R2: per (task, method) the latest non-null value of each column, by (timestamp, run_id)."""
    order = F.struct(F.col("timestamp"), F.col("run_id"))
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return log.groupBy("task", "method").agg(*aggs)


def value_over_time(log: DataFrame) -> DataFrame:
    """Value by task and method in time order (a distributed sort)."""
    return log.select("task", "method", "timestamp", "run_id", "value").orderBy("task", "method", "timestamp", "run_id")


def delta_errors(log: DataFrame) -> DataFrame:
    """Rows with delta and both CI bounds, with asymmetric error-bar lengths."""
    d = log.dropna(subset=["delta", "ci95_low", "ci95_high"])
    return d.select("run_id", "task", "method", "delta",
                    F.abs(F.col("delta") - F.col("ci95_low")).alias("err_low"),
                    F.abs(F.col("ci95_high") - F.col("delta")).alias("err_high"))


def exclude_smoke(log: DataFrame) -> DataFrame:
    """Drop smoke-test rows (``mock_backend``)."""
    return log.filter(~F.coalesce(F.col("mock_backend"), F.lit(False)))
