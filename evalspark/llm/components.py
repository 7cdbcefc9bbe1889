"""Connected components and path ends of a link table through Spark joins.

Components alternate two steps on the links (u, v), v < u, until nothing
changes: large-star hands every larger neighbour of a node the smallest of
its neighbourhood, small-star does so for the smaller neighbours. The links
stay as many as before at most and end as stars around the smallest node of
each component, in a number of rounds that grows with the logarithm of the
longest path. Each round is written to the shared checkpoint folder, so a
lost executor costs one round at most; only a count and a checksum reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import materialise


def _state(links: DataFrame, *cols: str) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64(*cols))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable from node through ``links``.

    Links are undirected; repeated links, self links and links with a null
    end are ignored. A node without links isn't in the result; no links
    give an empty table.
    """
    edges = materialise(links.filter(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges, "u", "v")
    for _ in range(max_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min(F.least("u", "v")).alias("m"))
        large = (both.join(low, both.u == low.x).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        met = large.join(least, large.u == least.x)
        small = met.select("v", "m").filter("v <> m").union(met.select("u", "m"))
        edges = materialise(small.toDF("u", "v").distinct())
        new = _state(edges, "u", "v")
        if new == state:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select("root", "root").distinct())
        state = new
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


def path_ends(steps: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, last): the end of the path that starts at ``a`` of each step (a, b), by pointer doubling.

    A node has one step out at most and paths don't close; a path of n steps
    takes about log2(n) joins.
    """
    steps = steps.select("a", "b")
    ends = materialise(steps.select(F.col("a").alias("node"), F.col("b").alias("last")))
    state = _state(ends, "node", "last")
    for _ in range(max_rounds):
        ahead = ends.select(F.col("node").alias("_n"), F.col("last").alias("_l"))
        ends = materialise(ends.join(ahead, ends["last"] == ahead["_n"], "left").select("node", F.coalesce("_l", "last").alias("last")))
        new = _state(ends, "node", "last")
        if new == state:
            return ends
        state = new
    raise RuntimeError(f"paths not settled after {max_rounds} rounds")
