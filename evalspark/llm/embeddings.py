"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Exact copies (same label, same vector) are one representative with a
multiplicity. Representatives are compared in two passes, and only the first
deals all of them out.

1. Sketches. A unit vector x is turned into s(x) = (x's coordinates on 23
   axes, length of the rest), a unit vector as well. The lengths of two rests
   bound their product, so s(x).s(y) >= x.y: every pair at or above the
   threshold is one of the sketches too, whatever the axes are. Sketches are
   assigned to the nearest of k centroids (spherical k-means; axes and
   centroids are fitted on a bounded sample). A sketch x whose home is cell i
   is also compared with cell j when it's so near the plane between both
   centroids that a partner may lie beyond it: a partner y at home in j has
   y.(ci - cj) <= 0, and the angle between x and y is at most acos(t), so
   x.(ci - cj) <= |ci - cj| sqrt(1 - t^2). Axes and centroids only decide how
   much is compared.
2. Vectors. Components of the sketches' links hold every link of the vectors;
   inside each of them the vectors are compared in double precision.

Disk: sketches have 48 bytes and travel once per pair of blocks, packed;
blocks grow with a label, so a sketch travels four times at most until a label
has a million representatives. The vectors are written once and meet the ids
of those whose sketches link; only these go to the second pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import group_runs, materialise, run_bounds
from evalspark.llm.components import connected_components

SAMPLE_ROWS = 8192      # vectors that axes and centroids are fitted on, at most
MAX_CELLS = 256
CELL_ROWS = 20_000      # wanted representatives per cell
BLOCK_ROWS = 4096       # wanted rows of a block in the products, until a group has SPREAD blocks
SPREAD = 4              # blocks of a group, as long as they aren't larger than they may be
MOST_ROWS = 1 << 18     # sketches of a block at most
MOST_BYTES = 32 << 20   # vectors (double precision) of a block at most
ROUNDS = 8
AXES = 23
LEVELS = 32767          # sketches are 16-bit fixed-point numbers
SLACK = 2e-4            # more than what rounding takes from a product of sketches (2 sqrt(24) / 65534) and from a plane's test
PACK_ROWS = 32_768      # sketches that are dealt to packs at a time
PACK = np.dtype([("rep", "<i8"), ("sketch", "<i2", (AXES + 1,))])
TASK_PRODUCTS = 1 << 26
MOST_TASKS = 4000
EDGES = 1 << 20         # links that are gathered before they're merged


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component goes first, so no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit_cells(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids of unit ``vectors`` (the first k start, ties to the lower cell)."""
    centres = vectors[:k].copy()
    for _ in range(rounds):
        cell = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def fit_axes(vectors: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Orthonormal columns (23, or as many as there are dimensions) along which ``vectors`` differ most."""
    dim = vectors.shape[1]
    axes = np.linalg.qr(np.random.default_rng(0).normal(size=(dim, min(AXES, dim))))[0]
    centred = vectors - vectors.mean(axis=0) if len(vectors) else vectors
    for _ in range(rounds if len(vectors) > 1 and dim > AXES else 0):
        axes = np.linalg.qr(centred.T @ (centred @ axes))[0]
    return axes


def sketch(vectors: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows whose products are those of the unit ``vectors`` or more."""
    out = np.zeros((len(vectors), AXES + 1))
    out[:, :axes.shape[1]] = vectors @ axes
    out[:, AXES] = np.sqrt(np.maximum(0, 1 - (out * out).sum(axis=1)))
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = SAMPLE_ROWS,
                    cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine
    (double precision) is at least ``threshold`` (above 0). A vector that is
    null, empty, zero or holds a null or a non-finite component, one without
    label or without vec_id, links with nothing: n_links 0, its own
    component. Vectors of different length don't link. component_id is the
    smallest vec_id reachable by links, ``kept`` marks it. A vec_id that
    comes more than once is one vector: the smallest (label, embedding) of
    its rows counts. An empty table gives an empty result; other columns are
    ignored. At most ``sample_rows`` vectors (by hash of vec_id) fit the
    centroids; every vector is compared.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    given = materialise(_described(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), "label")))
    fitted = _fitted(given, sample_rows, cell_rows)
    rows = _one_each(given, fitted)
    reps = materialise(rows.filter("dim is not null").groupBy("label", "dim", "h1", "h2")
                       .agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("sketch").alias("sketch")))
    maybe = connected_components(_sketch_links(reps, fitted, threshold, block_rows))
    found = _linked(given, reps, maybe, threshold, block_rows)
    counts = found.filter("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(found.filter("n is null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classed = (reps.join(counts, "rep", "left").join(roots, reps.rep == roots.node, "left")
               .select("label", "dim", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"),
                       F.coalesce("root", "rep").alias("root")))
    linked = rows.filter("dim is not null").join(classed, ["label", "dim", "h1", "h2"]).select(
        "vec_id", F.col("n").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.filter("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _described(given: DataFrame) -> DataFrame:
    """``given`` with dim (null: links with nothing), two hashes of the vector, and one of the whole row."""
    v = F.col("embedding")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite
                        & F.exists(v, lambda x: x != 0), F.lit(False))
    return (given.select("vec_id", "embedding", "label").withColumn("dim", F.when(usable, F.size(v)))
            .withColumn("h1", F.xxhash64(v)).withColumn("h2", F.xxhash64(F.lit(1), v))
            .withColumn("same", F.xxhash64("label", "h1", "h2", F.size(v), "dim")))


def _fitted(given: DataFrame, sample_rows: int, cell_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Axes and centroids by dimension."""
    usable = given.filter("dim is not null")
    sizes = {r["dim"]: r["n"] for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    whole = 1 << 30
    part = int(np.ceil(whole * min(1, sample_rows / sum(sizes.values()))))
    pick = usable.filter(F.pmod(F.xxhash64("vec_id"), F.lit(whole)) < part).select("vec_id", "dim", "embedding").limit(sample_rows).toArrow()
    pick = pick.sort_by("vec_id")
    out = {}
    for dim, n in sizes.items():
        sample = _matrix(pick.filter(pc.equal(pick["dim"], dim))["embedding"], dim)
        sample = _unit(sample) if len(sample) else sample
        axes = fit_axes(sample)
        k = max(1, min(MAX_CELLS, n // cell_rows, len(sample)))
        out[dim] = axes, fit_cells(sketch(sample, axes), k) if len(sample) else np.eye(AXES + 1)[:1]
    return out


def _one_each(given: DataFrame, fitted: dict) -> DataFrame:
    """Written table (vec_id, label, h1, h2, dim, sketch), a row for each vec_id."""
    body = f"vec_id long, label {given.schema['label'].dataType.simpleString()}, h1 long, h2 long, dim int, same long"
    names = ["vec_id", "label", "h1", "h2", "dim", "same"]
    width = (AXES + 1) * 2

    def to_sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims = pc.fill_null(batch.column("dim"), 0).to_numpy(zero_copy_only=False)
            out = np.zeros((n, AXES + 1), "<i2")
            for dim in np.unique(dims[dims > 0]):
                row = np.flatnonzero(dims == dim)
                x = _unit(_matrix(batch.column("embedding").take(pa.array(row)), int(dim)))
                out[row] = np.rint(sketch(x, fitted[int(dim)][0]) * LEVELS)
            offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)[:n + 1])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.Array.from_buffers(
                pa.binary(), n, [None, offsets, pa.py_buffer(out)])], [*names, "sketch"])

    def sketched(rows: DataFrame) -> DataFrame:
        sent = F.when(F.col("dim").isNotNull(), F.col("embedding")).alias("embedding")
        return rows.select(*names, sent).mapInArrow(to_sketch, f"{body}, sketch binary")

    kept = ["vec_id", "label", "h1", "h2", "dim", "sketch"]
    one = materialise(sketched(given).groupBy("vec_id")
                      .agg(F.min(F.struct("label", "h1", "h2", "dim", "sketch")).alias("r"), (F.min("same") != F.max("same")).alias("differ"))
                      .select("vec_id", "r.*", (F.col("differ") & F.col("vec_id").isNotNull()).alias("differ")))
    clash = one.filter("differ").select("vec_id")
    if clash.isEmpty():
        return one.select(*kept)
    smallest = (given.join(clash, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
                .select("vec_id", "r.*"))
    return materialise(one.filter("not differ").select(*kept).union(sketched(_described(smallest)).select(*kept)))


def _blocks(n: Column, wanted: int, most: Column, spread: int = SPREAD) -> Column:
    """Blocks of a group of n rows."""
    return F.greatest(F.least(F.ceil(n / wanted), F.lit(spread)), F.ceil(n / most)).cast("int")


def _units(dealt: DataFrame, *group: str) -> DataFrame:
    """Every row of block _b of _nb in all units of its group that its block is part of; side 0 or 1, 2: both."""
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return dealt.withColumn("unit", F.xxhash64(*group, F.least("_b", "_o"), F.greatest("_b", "_o"))).withColumn("side", side)


def _in_units(units: DataFrame, sizes: DataFrame) -> DataFrame:
    """``units`` dealt to tasks by the products they take; sizes: _n and _nb of every group."""
    n, products = sizes.agg(F.sum(F.expr("_nb * (_nb + 1) / 2")), F.sum(F.expr("double(_n) * _n * (1 + 1 / _nb) / 2"))).first()
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(n or 0, (products or 0) / TASK_PRODUCTS, MOST_TASKS)))
    return units.repartition(tasks, "unit").sortWithinPartitions("unit")


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (smallest index of each node's component) after the links (a, b)."""
    while True:
        x, y = root[a], root[b]
        far = x != y
        if not far.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[far], np.minimum(x, y)[far])
        while not np.array_equal(new := root[root], root):
            root = new


def _hits(x: np.ndarray, y: np.ndarray, cut: float, high: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the rows of x and y whose product is ``cut`` or more, some rows at a time."""
    for i in range(0, len(x), high):
        for j in range(0, len(y), wide):
            hit = x[i:i + high] @ y[j:j + wide].T >= cut
            if hit.any():
                a, b = np.divmod(np.flatnonzero(hit), hit.shape[1])
                yield a + i, b + j


def _near_hits(x: np.ndarray, y: np.ndarray, centres: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sketches x at home in a cell and sketches y near that cell whose product may be the threshold or more."""
    cut = threshold - SLACK
    if len(centres) == 1 or cut <= 0:
        yield from _hits(x, y, cut, 512, 1024)
        return
    reach = np.sqrt(1 - cut * cut) + SLACK
    gap = np.sqrt(np.maximum(0, ((centres[:, None] - centres[None]) ** 2).sum(axis=2)))
    home = (x @ centres.T).argmax(axis=1)
    order = np.argsort(home, kind="stable")
    cells, starts = np.unique(home[order], return_index=True)
    for j in range(0, len(y), PACK_ROWS):
        z = y[j:j + PACK_ROWS]
        dots = z @ centres.T
        own = dots.argmax(axis=1)
        near = (dots[np.arange(len(z)), own][:, None] - dots <= gap[own] * reach + 1e-5).T
        for cell, left in zip(cells, np.split(order, starts[1:])):
            right = np.flatnonzero(near[cell])
            for a, b in _hits(x[left], z[right], cut, 512, 1024):
                yield left[a], right[b] + j


def _sketch_links(reps: DataFrame, fitted: dict, threshold: float, block_rows: int) -> DataFrame:
    """Written table (a, b): links that span the components of the sketches, of each pair of blocks."""
    centres = {dim: c.astype(np.float32) for dim, (_, c) in fitted.items()}
    sizes = (reps.groupBy("label", "dim").agg(F.count("*").alias("_n")).filter("_n > 1")
             .withColumn("_nb", _blocks(F.col("_n"), block_rows, F.lit(MOST_ROWS))))
    dealt = reps.join(sizes, ["label", "dim"]).select(
        F.xxhash64("label", "dim").alias("key"), "dim", "_nb", F.pmod(F.xxhash64("rep"), "_nb").cast("int").alias("_b"), "rep", "sketch")

    def pack(table: pa.Table) -> pa.RecordBatch:
        rows = np.empty(table.num_rows, PACK)
        rows["rep"] = table["rep"].to_numpy()
        rows["sketch"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), "<i2").reshape(-1, AXES + 1)
        group = {c: table[c].to_numpy() for c in ("key", "dim", "_nb", "_b")}
        order = np.lexsort((group["_b"], group["dim"], group["key"]))
        rows, group = rows[order], {c: x[order] for c, x in group.items()}
        edge = np.flatnonzero((np.diff(group["key"]) != 0) | (np.diff(group["dim"]) != 0) | (np.diff(group["_b"]) != 0)) + 1
        starts = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(rows)]])
        starts, ends = (np.array(z) for z in zip(*((i, min(i + BLOCK_ROWS, b)) for a, b in zip(starts, ends) for i in range(a, b, BLOCK_ROWS))))
        return pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in group.values()] + [
            pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], [*group, "rows"])

    def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some, n = [*some, batch], n + batch.num_rows
            if n >= PACK_ROWS:
                yield pack(pa.Table.from_batches(some))
                some, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(some))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_runs(batches, ["unit"]):
            bounds = run_bounds(table, ["unit"])
            for a, b in zip(bounds, bounds[1:]):
                part = table.slice(a, b - a)
                packed, side = part["rows"].to_pylist(), part["side"].to_numpy()
                rows = np.frombuffer(b"".join(packed), PACK)
                side = np.repeat(side, [len(p) // PACK.itemsize for p in packed])
                x = rows["sketch"].astype(np.float32) / np.float32(LEVELS)
                i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                root, links, n = np.arange(len(rows)), [], 0
                for p, q in _near_hits(x[i], x[j], centres[int(part["dim"][0].as_py())], threshold):
                    p, q = i[p], j[q]
                    new = root[p] != root[q]
                    links.append((p[new], q[new]))
                    n += int(new.sum())
                    if n >= EDGES:
                        root, links, n = _merged(root, *map(np.concatenate, zip(*links))), [], 0
                if n:
                    root = _merged(root, *map(np.concatenate, zip(*links)))
                far = root != np.arange(len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(rows["rep"][far]), pa.array(rows["rep"][root[far]])], ["a", "b"])

    units = _units(dealt.mapInArrow(packs, "key long, dim int, _nb int, _b int, rows binary"), "key", "dim")
    return materialise(_in_units(units.select("unit", "side", "dim", "rows"), sizes).mapInArrow(compare, "a long, b long"))


def _linked(given: DataFrame, reps: DataFrame, maybe: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(rep, n, other): summands of link counts (other null) and spanning links (n null); maybe: components of the sketches."""
    group = ["root", "label", "dim"]
    most = F.greatest(F.lit(block_rows), F.floor(F.lit(MOST_BYTES / 8) / F.col("dim")))
    wanted = materialise(reps.drop("sketch").join(maybe, reps.rep == maybe.node).drop("node"))
    spread = max(2, min(SPREAD, reps.count() // max(1, wanted.count())))  # the more vectors go, the fewer times each
    sizes = (wanted.groupBy(*group).agg(F.count("*").alias("_n")).filter("_n > 1")
             .withColumn("_nb", _blocks(F.col("_n"), block_rows, most, spread)))
    dealt = (wanted.join(sizes, group).withColumn("_b", F.pmod(F.xxhash64("rep"), "_nb").cast("int"))
             .select(F.col("rep").alias("vec_id"), "h1", "h2", F.xxhash64(*group).alias("key"), "dim", "m", "_nb", "_b"))
    full = given.filter("dim is not null").select("vec_id", "h1", "h2", "embedding").join(dealt, ["vec_id", "h1", "h2"])
    units = _units(full, "key").select("unit", "side", "dim", F.col("vec_id").alias("rep"), "m", "embedding")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_runs(batches, ["unit"]):
            rep, m = table.column("rep").to_numpy(), table.column("m").to_numpy()
            sides, dims = table.column("side").to_numpy(), table.column("dim").to_numpy()
            bounds = run_bounds(table, ["unit"])
            reps_, ns, others = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                ids, first = np.unique(rep[a:b], return_index=True)  # a row that comes twice is one vector
                x = _unit(_matrix(table.column("embedding").slice(a, b - a), int(dims[a])))[first]
                side, many = sides[a:b][first], m[a:b][first]
                i, j = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
                root, n = np.arange(len(ids)), np.zeros(len(ids))
                for p, q in _hits(x[i], x[j], threshold, 1024, 4096):
                    p, q = i[p], j[q]
                    other = p != q
                    p, q = p[other], q[other]
                    n += np.bincount(p, many[q], len(ids))
                    if side[0] != 2:  # a block with itself has each pair in both orders
                        n += np.bincount(q, many[p], len(ids))
                    root = _merged(root, p, q)
                some, far = n > 0, root != np.arange(len(ids))
                reps_ += [ids[some], ids[far]]
                ns += [n[some], np.full(far.sum(), -1)]
                others += [np.full(some.sum(), -1), ids[root[far]]]
            r, n, o = (np.concatenate(z).astype(np.int64) for z in (reps_, ns, others))
            link = n < 0
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n, mask=link), pa.array(o, mask=~link)], ["rep", "n", "other"])

    return materialise(_in_units(units, sizes).mapInArrow(compare, "rep long, n long, other long"))
