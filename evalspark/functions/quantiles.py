"""Exact percentiles in fixed memory, by repeated histogram refinement.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, so a group that holds a third of a large log would land in one task.
Here the exact, linearly interpolated percentile (numpy's default, DuckDB's
``quantile_cont``) is selected:

1. per group: count, smallest and largest value. They settle p = 0, p = 1 and
   groups of one distinct value;
2. an interval of values that holds a wanted rank is cut into CELLS
   sub-intervals, and one aggregation gives every sub-interval's count,
   smallest and largest value. Running sums of the counts tell which holds the
   rank; its smallest and largest value are the next interval. Two neighbouring
   ranks in different sub-intervals are settled at once: one is the largest
   value of its sub-interval, the other the smallest of the next;
3. when no interval holds more than LIMIT values, those are collected and the
   ranks read from them.

A value lies in one interval at most, so a pass is one scan with at most one
row per value, and no buffer holds more than LIMIT values whatever the size of
a group. Sub-intervals shrink to the values they hold, so ties, gaps and
outliers cost a round, not memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import join_small

CELLS = 1024
LIMIT = 4096
LARGEST = 1.7976931348623157e308


def _pname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"p{s}"


def _cell(cells: int) -> Column:
    """Sub-interval of ``_x`` in [``_lo``, ``_hi``]; it rises with _x, and both ends are never in one.

    Intervals within a factor of two are cut evenly, others by the logarithm
    (mirrored for negative values), so values of very different size are told
    apart in a few rounds.
    """
    finite = lambda c: F.least(F.greatest(F.col(c), F.lit(-LARGEST)), F.lit(LARGEST))
    even = lambda c: finite(c) / 2
    log = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.signum(finite(c)) * (F.log2(F.abs(finite(c))) + 1100))
    narrow = ((F.col("_lo") > 0) & (even("_hi") <= finite("_lo"))) | ((F.col("_hi") < 0) & (even("_lo") >= finite("_hi")))
    place = F.when(narrow, (even("_x") - even("_lo")) / F.nullif(even("_hi") - even("_lo"), F.lit(0.0))).otherwise(
        (log("_x") - log("_lo")) / F.nullif(log("_hi") - log("_lo"), F.lit(0.0)))
    inside = F.least(F.greatest(F.floor(place * cells).cast("long"), F.lit(0).cast("long")), F.lit(cells - 1).cast("long"))
    return F.when(F.col("_x") == F.col("_lo"), F.lit(0).cast("long")).when(F.col("_x") == F.col("_hi"), F.lit(cells - 1).cast("long")).otherwise(inside)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    ps: Sequence[float],
    prefix: str = "",
    limit: int = LIMIT,
    cells: int = CELLS,
) -> DataFrame:
    """Exact percentiles of ``value`` per ``keys`` group.

    Nulls and NaN are ignored. Returns one row per group that has at least one
    value, with columns ``keys + [prefix + 'p50', ...]`` (DOUBLE). At most
    ``limit`` values are ever collected in one place.
    """
    keys = list(keys)
    g = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    x = F.col(value) if isinstance(value, str) else value
    names = [F.col(k).alias(n) for k, n in zip(keys, g)] or [F.lit(0).alias("_all")]
    base = df.select(*names, x.cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))

    sizes = base.groupBy(*g).agg(F.count("*").alias("_cnt"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    last = F.col("_cnt") - 1
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * last).alias("_h")) for i, p in enumerate(ps)]))
    none = F.lit(None).cast("double")
    targets = (sizes.withColumn("_t", wanted).select(*g, "_t.*", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_cnt")
               .withColumn("_r", F.floor("_h")).withColumn("_s", F.ceil("_h")))
    first = F.when(F.col("_r") == 0, F.col("_lo")).when((F.col("_r") == last) | (F.col("_lo") == F.col("_hi")), F.col("_hi"))
    second = F.when(F.col("_s") == last, F.col("_hi")).when((F.col("_s") == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo"))
    targets = targets.withColumn("_v", first).withColumn("_w", second)
    settled = F.col("_v").isNotNull() & F.col("_w").isNotNull()
    targets = targets.withColumn("_v", F.when(settled, F.col("_v"))).withColumn("_w", F.when(settled, F.col("_w"))).checkpoint()

    def inside(intervals: DataFrame) -> DataFrame:
        held = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
        if keys:
            return join_small(base, intervals, g).filter(held)
        # one group: at most one interval per percentile, as literals
        names = intervals.columns[1:]
        options = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r[1:])]) for r in intervals.collect()]
        if not options:
            options = [F.struct(*[F.lit(None).cast(intervals.schema[n].dataType).alias(n) for n in names])]
        return base.select("_all", "_x", F.inline(F.array(*options))).filter(held)

    while not targets.filter(F.col("_v").isNull() & (F.col("_cnt") > limit)).isEmpty():
        wide = F.col("_v").isNull() & (F.col("_cnt") > limit)
        todo, done = targets.filter(wide), targets.filter(~wide)
        counts = (inside(todo.select(*g, "_lo", "_hi", "_below").distinct()).groupBy(*g, "_lo", "_below", _cell(cells).alias("_cell"))
                  .agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b")))
        before = Window.partitionBy(*g, "_lo").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_from", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_below")
        # a target has one row here, or two if its ranks fall apart
        met = todo.alias("t").join(counts.alias("c"), [*[F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in g], F.col("t._lo") == F.col("c._lo")])
        has = lambda r: (F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_from") + F.col("_c"))
        met = (met.filter(has("_r") | has("_s")).select(*[F.col(f"t.{k}").alias(k) for k in g], "_i", "_h", "_r", "_s", "_a", "_b", "_c", "_from",
                                                        has("_r").alias("_one"), has("_s").alias("_two"))
               .groupBy(*g, "_i", "_h", "_r", "_s")
               .agg(F.min("_a").alias("_lo"), F.max("_b").alias("_hi"), F.min("_from").alias("_below"), F.sum("_c").alias("_cnt"),
                    F.count("*").alias("_n"), F.max(F.when(F.col("_one"), F.col("_b"))).alias("_end"), F.min(F.when(F.col("_two"), F.col("_a"))).alias("_start")))
        apart, equal = F.col("_n") == 2, F.col("_lo") == F.col("_hi")
        met = met.select(*g, "_i", "_h", "_lo", "_hi", "_below", "_cnt", "_r", "_s",
                         F.when(apart, F.col("_end")).when(equal, F.col("_lo")).alias("_v"),
                         F.when(apart, F.col("_start")).when(equal, F.col("_lo")).alias("_w"))
        targets = done.unionByName(met).checkpoint()

    left = targets.filter("_v is null")
    held = (inside(left.select(*g, "_lo", "_hi").distinct()).groupBy(*g, "_lo").agg(F.array_sort(F.collect_list("_x")).alias("_values")))
    read = lambda r: F.try_element_at("_values", (F.col(r) - F.col("_below") + 1).cast("int"))
    on = [*[F.col(f"t.{k}").eqNullSafe(F.col(f"h.{k}")) for k in g], F.col("t._lo") == F.col("h._lo")]
    chosen = (targets.alias("t").join(held.alias("h"), on, "left")
              .select(*[F.col(f"t.{k}").alias(k) for k in g], "_i", "_h", "_r", F.coalesce("_v", read("_r")).alias("_v"), F.coalesce("_w", read("_s")).alias("_w")))
    part = F.col("_h") - F.col("_r")
    answer = F.when(part == 0, F.col("_v")).otherwise(F.col("_v") + part * (F.col("_w") - F.col("_v")))
    out = chosen.groupBy(*g).agg(*[F.max(F.when(F.col("_i") == i, answer)).alias(prefix + _pname(p)) for i, p in enumerate(ps)])
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, g)], *[prefix + _pname(p) for p in ps])


def percentile_names(ps: Sequence[float], prefix: str = "") -> list[str]:
    return [prefix + _pname(p) for p in ps]
