"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              broadcast_right: bool = False) -> DataFrame:
    """Null-safe equi-join on ``keys``; the output carries the keys once.

    Right-side keys are renamed first, so frames derived from the same source
    (aggregates of one input joined back together) join without ambiguity.
    Without keys the right side is a global aggregate: more than one row of
    it is an error, not a cross join.
    """
    keys = list(keys)
    if not keys:
        if right.limit(2).count() > 1:
            raise ValueError("a join without keys needs a right side of one row")
        return left.join(F.broadcast(right), how=how) if how != "inner" else left.crossJoin(F.broadcast(right))
    ren = {k: f"__r_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(f"`{c}`").alias(ren.get(c, c)) for c in right.columns])
    if broadcast_right:
        r = F.broadcast(r)
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(ren[k])) for k in keys]
    out = left.join(r, cond, how)
    if how in ("right", "right_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(F.col(f"`{k}`"), F.col(ren[k])))
    if how in ("full", "outer", "full_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(F.col(f"`{k}`"), F.col(ren[k])))
    return out.drop(*ren.values())


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner",
               max_rows: int | None = None) -> DataFrame:
    """Join ``big`` to a side expected to be small, broadcasting it only behind a size check.

    ``small`` is typically an aggregate of ``big`` (one row per group), stored
    or cheap to make again: its rows and bytes are measured, and it's
    broadcast when both are bounded, else joined by shuffle (where AQE can
    still split skewed keys).
    """
    from evalspark.functions.indexing import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, rows_and_bytes

    rows, size = rows_and_bytes(small)
    fits = rows <= (BROADCAST_MAX_ROWS if max_rows is None else max_rows) and size <= BROADCAST_MAX_BYTES
    return join_keys(big, small, keys, how, broadcast_right=fits)
