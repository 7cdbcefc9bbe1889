"""Data preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.hashing import seeded_key
from evalspark.functions.indexing import with_row_index

# Above this many rows a split is ranked by a distributed sort instead of a top-n merge.
from evalspark.functions.text import strip_ws, word_count


class ContractError(ValueError):
    """A data-contract or sanity gate failed."""


def normalise_items(raw: DataFrame) -> DataFrame:
    """Raw items → items.

    ``ctx`` = ctx, or ctx_a when ctx is missing/empty; a non-empty ctx_b is
    appended after one space (or used alone when ctx is empty). ``label`` = int
    of the label, -1 when missing or empty. ``ind`` becomes a string.
    """
    base = F.coalesce(F.when(F.col("ctx") != "", F.col("ctx")), F.col("ctx_a"), F.lit(""))
    b = F.coalesce(F.col("ctx_b"), F.lit(""))
    ctx = F.when(b == "", base).when(base == "", b).otherwise(F.concat(base, F.lit(" "), b))
    lab = F.col("label").cast("string")
    return raw.select(
        F.coalesce(F.col("ind").cast("string"), F.lit("")).alias("ind"),
        ctx.alias("ctx"),
        F.coalesce(F.col("activity_label"), F.lit("")).alias("activity_label"),
        F.coalesce(F.col("endings"), F.array().cast("array<string>")).alias("endings"),
        F.when(lab.isNull() | (lab == ""), F.lit(-1)).otherwise(lab.cast("int")).alias("label"),
    )


def labelled(items: DataFrame) -> DataFrame:
    """Rows with a gold label (>= 0) and at least one ending."""
    return items.filter((F.col("label") >= 0) & (F.size("endings") > 0))


def require_rows(df: DataFrame, n_needed: int, what: str = "labelled rows") -> int:
    """Fail when ``df`` has fewer than ``n_needed`` rows; returns the count."""
    n = df.count()
    if n < n_needed:
        raise ContractError(f"only {n} {what} available; need {n_needed}")
    return n


def split_items(items: DataFrame, n_eval: int, n_pool: int, seed: int = 42, check: bool = True) -> DataFrame:
    """Seeded shuffle; the first ``n_eval`` rows are ``eval``, the next ``n_pool`` ``pool``.

    The shuffle order is ``md5(seed:ind)`` then ``ind``: deterministic,
    independent of partitioning, and the two splits are disjoint. Counts per
    first four hex digits (at most 65,536) tell up to which digits rows can be
    among the first; only those rows are sorted, and get a contiguous index
    from a range-partitioned sort, so a repeated or null ``ind`` is counted row
    by row. The result carries ``split`` and ``rank`` (0-based position in the
    shuffle).
    """
    if check:
        require_rows(items, n_eval + n_pool)
    keyed = items.withColumn("_key", F.md5(seeded_key(seed, F.col("ind"))))
    digits = F.coalesce(F.substring("_key", 1, 4), F.lit(""))
    seen, last = 0, ""
    for r in sorted(keyed.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect()):
        if seen >= n_eval + n_pool:
            break
        seen, last = seen + r["n"], r["d"]
    placed = with_row_index(keyed.filter(digits <= last), ["_key", "ind"], "rank")
    ranked = placed.filter(F.col("rank") < n_eval + n_pool).withColumn("rank", F.col("rank").cast("int"))
    return ranked.withColumn("split", F.when(F.col("rank") < n_eval, "eval").otherwise("pool")).drop("_key")


def limit_items(df: DataFrame, n: int, by: str | None = None, order: str | Column = "ind") -> DataFrame:
    """P5: the first ``n`` rows (per ``by`` group when given) in ``order``.

    ``row_number() <= n`` is planned as a window group limit, so each task
    pre-selects ``n`` rows per group before the shuffle.
    """
    o = F.col(order) if isinstance(order, str) else order
    if not by:
        return df.orderBy(o).limit(n)
    w = Window.partitionBy(by).orderBy(o)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def check_contract(qa: DataFrame, expected_rows: int | None = None, max_answer_tokens: int = 3) -> DataFrame:
    """QA dataset contract as long-form ``(rule, violations)`` from one aggregate."""
    agg = qa.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("question").isNull() | (strip_ws("question") == "")).alias("blank_question"),
        F.count_if(F.col("answer").isNull() | (strip_ws("answer") == "")).alias("blank_answer"),
        F.count_if(word_count("answer") > max_answer_tokens).alias("long_answer"),
    )
    exp = F.lit(expected_rows) if expected_rows is not None else F.col("rows")
    return agg.select(F.explode(F.array(
        F.struct(F.lit("row_count").alias("rule"), F.abs(F.col("rows") - exp).cast("bigint").alias("violations")),
        F.struct(F.lit("blank_question").alias("rule"), F.col("blank_question").alias("violations")),
        F.struct(F.lit("blank_answer").alias("rule"), F.col("blank_answer").alias("violations")),
        F.struct(F.lit("long_answer").alias("rule"), F.col("long_answer").alias("violations")),
    )).alias("r")).select("r.*")


def assert_contract(violations: DataFrame) -> None:
    """Raise when any contract rule has violations (one small collect of <= 4 rows)."""
    bad = [r for r in violations.filter(F.col("violations") > 0).collect()]
    if bad:
        raise ContractError("; ".join(f"{r['rule']}: {r['violations']}" for r in bad))


def synthetic_ids(items: DataFrame, synthetic_prefix: str = "syn-") -> DataFrame:
    """P7 (data gate): number of ids that look like smoke data (one global aggregate)."""
    return items.agg(F.count_if(F.col("ind").cast("string").startswith(synthetic_prefix)).alias("synthetic"),
                     F.count("*").alias("n_items"))


def degenerate_accuracy(results: DataFrame, by: str = "variant") -> DataFrame:
    """P7 (result gate): per group, accuracy and whether it is exactly 0 or exactly 1."""
    c = F.col("correct").cast("boolean")
    return results.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(c.cast("double")).alias("accuracy"),
        (F.bool_and(c) | ~F.bool_or(c)).alias("degenerate"),
    )


def sanity_gate(items: DataFrame, results: DataFrame, by: str = "variant", synthetic_prefix: str = "syn-") -> DataFrame:
    """P7, both gates in one table: per group accuracy and ``degenerate``, plus the
    number of synthetic-looking ids (one number, attached as a literal)."""
    syn = synthetic_ids(items, synthetic_prefix).first()["synthetic"]
    return degenerate_accuracy(results, by).withColumn("synthetic", F.lit(syn).cast("bigint"))
