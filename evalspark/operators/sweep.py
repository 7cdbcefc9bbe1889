"""Decoding-parameter sweeps.

A sweep evaluates every item under every grid cell. The grid is a small,
user-given parameter list, so each item row is expanded into its cells by
exploding the three literal lists (no join at all); requests then go through the
keyed cache (C6), so cells that resolve to identical requests share responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks scored purely by log-likelihood, where decoding knobs do nothing.
LOGLIKELIHOOD_ONLY = frozenset({
    "hellaswag", "arc_challenge", "arc_easy", "winogrande", "piqa",
    "mmlu_stem", "mmlu_humanities", "mmlu_social_sciences", "mmlu_other",
})


class SweepError(ValueError):
    """A sweep was asked for a log-likelihood-only task without ``force``."""


def _axis(listed: str, kind: str) -> Column:
    """One row per value of a comma list."""
    values = F.filter(F.transform(F.split(F.lit(listed), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.explode(F.transform(values, lambda x: x.cast(kind)))


def _short(c: Column) -> Column:
    """A double in six significant digits, without trailing zeros, as ``{:g}`` prints it.

    Plain decimals for exponents from -4 to 5, else a mantissa and an exponent
    of two digits or more.
    """
    sci = F.format_string("%.5e", c)        # the exponent after rounding to six digits
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.array(*[F.format_string(f"%.{5 - p}f", c) for p in range(-4, 6)])
    small = trim(F.element_at(plain, F.greatest(F.least(power, F.lit(5)), F.lit(-4)) + 5))
    return F.when(power.between(-4, 5), small).otherwise(F.concat(trim(F.regexp_extract(sci, r"^(.*)e", 1)), F.regexp_extract(sci, r"(e[+-]\d+)$", 1)))


def with_cells(df: DataFrame, temperatures: str, top_ps: str, top_ks: str) -> DataFrame:
    """Every row of ``df`` under every cell of the grid of three comma lists.

    Adds ``cell`` (``sweep_t0.3_p1_k0``), ``temperature``, ``top_p`` and ``top_k``.
    """
    grid = (df.withColumn("temperature", _axis(temperatures, "double")).withColumn("top_p", _axis(top_ps, "double"))
            .withColumn("top_k", _axis(top_ks, "int")))
    label = F.concat(F.lit("sweep_t"), _short(F.col("temperature")), F.lit("_p"), _short(F.col("top_p")),
                     F.lit("_k"), F.col("top_k").cast("string"))
    return grid.select(*df.columns, label.alias("cell"), "temperature", "top_p", "top_k")


def is_loglikelihood_only(task: Column | str) -> Column:
    """Flag tasks where a decoding sweep is meaningless."""
    t = F.col(task) if isinstance(task, str) else task
    return t.isin(*sorted(LOGLIKELIHOOD_ONLY)) | t.startswith("mmlu_")


def check_task(task: str, force: bool = False) -> None:
    """W3 for a single task name given as a parameter."""
    if (task in LOGLIKELIHOOD_ONLY or task.startswith("mmlu_")) and not force:
        raise SweepError(f"{task} is log-likelihood only; decoding params have no effect (use force)")


def summarise_cells(results: DataFrame, correct: str = "correct", response: str = "response") -> DataFrame:
    """W4 roll-up per cell: n, correct, accuracy, rows without a response (errors), failed flag."""
    return results.groupBy("cell", "temperature", "top_p", "top_k").agg(
        F.count("*").alias("n"),
        F.count_if(F.col(correct)).alias("n_correct"),
        F.coalesce(F.avg(F.col(correct).cast("double")), F.lit(0.0)).alias("accuracy"),
        F.count_if(F.col(response).isNull()).alias("errors"),
    ).withColumn("failed", F.col("errors") > 0)
