"""Helpers shared by the operators of this subpackage.

Texts are processed in Arrow batches cut into slices of a few megabytes, so
the working memory of a task depends on the slice size (or on one single
document, whichever is larger), never on the size of a partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import apply_session_conf, ensure_checkpoint_dir, ship_package

SLICE_BYTES = 4 << 20
# Texts travel in small Arrow batches: two tasks share an executor's memory outside the heap.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters that separate words in every word contract: space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Session settings, checkpoint folder and package on the executors."""
    apply_session_conf(spark)
    for k, v in ARROW_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage; unlike ``checkpoint()`` the rows are computed once and
    stored as compressed columns. The files belong to ``spark.checkpoint.dir``
    and follow that folder's clean-up.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


class Tokens(NamedTuple):
    """Words of several texts: ``codes[offsets[i]:offsets[i+1]]`` index ``words``."""

    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array


def tokenise(texts: pa.Array, lower: bool = False) -> Tokens:
    """Words (runs of other characters than space and \\t..\\r) of every text; null has none."""
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        col = pc.ascii_lower(col)
    lists = pc.ascii_split_whitespace(col)
    flat = lists.flatten()
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = encoded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # a text that begins or ends with white space gives empty pieces
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return Tokens(codes, offsets.astype(np.int64), words)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of every word as unsigned integers."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def block_pairs(df: DataFrame, keys: list[str], member: Column, block_rows: int, min_rows: int = 2) -> DataFrame:
    """Deal the members of every group to pairs of blocks of bounded size.

    Groups under ``min_rows`` rows are left out. A group of n rows is cut
    into b = ceil(n / block_rows) blocks by the hash of ``member``; the pair
    of blocks (i, j) becomes the work unit ``_bi``, ``_bj`` and gets the rows
    of both, so any two members meet in a unit and no unit has more than
    about 2 * block_rows rows, however large the group is.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows)
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    both = df.join(sizes, keys).withColumn("_nb", blocks).withColumn("_b", F.pmod(F.xxhash64(member), "_nb").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_nb") - 1), lambda j: (F.col("_nb") == 1) | (j != F.col("_b")))
    return (both.withColumn("_o", F.explode(others))
            .withColumn("_bi", F.least("_b", "_o")).withColumn("_bj", F.greatest("_b", "_o"))
            .drop("_n", "_nb", "_o", "_b"))


def group_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``keys``, many groups at a time.

    Rows of the last, perhaps unfinished group are carried to the next batch.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        edge = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            col = table.column(k).to_numpy()
            edge |= col[1:] != col[:-1]
        cut = int(np.flatnonzero(edge)[-1]) + 1 if edge.any() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def run_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start of every group in a table sorted by ``keys``, and its end."""
    edge = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        col = table.column(k).to_numpy()
        edge |= col[1:] != col[:-1]
    return np.concatenate([[0], np.flatnonzero(edge) + 1, [table.num_rows]])


def linked_labels(adjacent: np.ndarray) -> np.ndarray:
    """Smallest row index reachable from each row of a symmetric boolean matrix."""
    n = len(adjacent)
    labels = np.arange(n)
    while True:
        new = np.minimum(labels, np.where(adjacent, labels[None, :], n).min(axis=1))
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new
