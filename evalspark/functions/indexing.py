"""Contiguous row indexes and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Row bound under which a side is broadcast. Sides are dimension-like tables
# (exemplar pools, variant registries, grids); above the bound the planner's
# shuffle join is used instead.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20


def rows_and_bytes(df: DataFrame) -> tuple[int, int]:
    """Row count and size of the rows as JSON text, from one aggregate."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, total = df.agg(F.count("*"), size).first()
    return n, total or 0


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, int]:
    """Broadcast ``df`` when it's within both bounds; returns (frame, row count)."""
    n, size = rows_and_bytes(df)
    return (F.broadcast(df) if n <= max_rows and size <= max_bytes else df), n


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "_idx") -> DataFrame:
    """Add a contiguous 0-based index in ``order`` (which must be a total order).

    Distributed: a range-partitioned sort, per-partition counts (one row per
    partition), their running offsets, and a broadcast join of those offsets.
    The sorted frame is checkpointed so both passes see the same partitions.
    """
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    s = s.withColumn("_part", F.shiftright("_mid", 33))
    counts = s.groupBy("_part").agg(F.count("*").alias("_cnt"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return (
        s.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_off") + local).cast("bigint"))
        .drop("_mid", "_part", "_off")
    )


def with_running_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """Add running sums over the whole table in ``order`` (a total order): ``sums`` maps new columns to summed ones.

    Distributed prefix sums: a range-partitioned sort, one row of totals per
    partition, their running offsets (added back by a broadcast join of one
    row per partition), and running sums within each partition.
    """
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    s = s.withColumn("_part", F.shiftright("_mid", 33))
    totals = s.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    upto = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    return (s.join(F.broadcast(offsets), "_part")
            .select(*df.columns, *[(F.col(f"_o_{n}") + F.sum(c).over(upto)).alias(n) for n, c in sums.items()]))
