"""Corpus slices, and totals over keys that many slices share.

A corpus operator often needs, for every k-mer or n-gram of its texts, one
number over the whole corpus, back at the text. One shuffled row per
occurrence costs several times the size of the text. Here the texts are cut
into slices of a few megabytes; a slice sends each of its distinct keys once,
in one row per key range (sorted, as differences, compressed), and gets the
totals back in the same order. Spark shuffles, groups and joins the rows; a
hot key is one entry per slice, so no group grows with a key's frequency.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import SLICE_BYTES, materialise, text_slices
from evalspark.session import ensure_checkpoint_dir

ENTRIES = 1_000_000      # wanted entries of a key range
LEAST_RANGES = 48
BUCKET_ROWS = 2000       # documents in a bucket of the slice table, about
ROW_KIND = "slice long, bucket int, keys binary, vals array<binary>"
ROW_NAMES = ["slice", "bucket", "keys", "vals"]


def squeeze(values: np.ndarray) -> bytes:
    """64-bit integers as compressed byte planes (the planes of small numbers are zeros)."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data).view(np.uint64), dtype=np.uint64)


class Corpus(NamedTuple):
    """The slice table, bucketed by ``slice`` so that replies join it without moving the texts."""

    slices: DataFrame
    buckets: int


def cut_slices(docs: DataFrame, max_bytes: int = SLICE_BYTES) -> Corpus:
    """Written table (slice, ids, sizes, z, raw): runs of documents with their texts compressed (null: empty).

    ``sizes`` are the UTF-8 lengths of the texts in ``z``, ``raw`` their sum.
    A slice has about ``max_bytes`` of text, or one longer document. The
    files are in the checkpoint folder; the session's catalog gets a table
    name for them, which is how Spark knows about buckets.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, at = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32
        for part in text_slices(batches, max_bytes=max_bytes):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([pack(b"".join(texts))], pa.binary()), pa.array([sum(sizes)])], ["slice", "ids", "sizes", "z", "raw"])
            at += 1

    spark = docs.sparkSession
    buckets = max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET_ROWS)
    name = f"llm_slices_{uuid.uuid4().hex}"
    cut = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
           .mapInArrow(run, "slice long, ids array<long>, sizes array<long>, z binary, raw long"))
    (cut.write.option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").option("compression", "none")
     .bucketBy(min(buckets, 100_000), "slice").saveAsTable(name))
    return Corpus(spark.table(name), min(buckets, 100_000))


def slice_texts(row: dict) -> list[bytes]:
    import zstandard

    blob = zstandard.ZstdDecompressor().decompress(row["z"]) if row["raw"] else b""
    ends = np.cumsum(row["sizes"], dtype=np.int64)
    return [blob[e - n:e] for n, e in zip(row["sizes"], ends)]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def ranges_for(corpus: Corpus, keys_per_byte: float) -> int:
    """Number of key ranges such that each has about ENTRIES entries."""
    raw = corpus.slices.agg(F.sum("raw")).first()[0] or 0
    return max(LEAST_RANGES, int(raw * keys_per_byte / ENTRIES) + 1)


def send(slice_id: int, keys: np.ndarray, values: list[np.ndarray], ranges: int) -> pa.RecordBatch:
    """Rows of a slice: sorted distinct unsigned ``keys`` and aligned integers, cut by key range."""
    edges = [0, *(np.searchsorted(keys, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64))), len(keys)]
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return pa.RecordBatch.from_arrays(
        [pa.array([slice_id] * len(spans), pa.int64()), pa.array([i for i, _, _ in spans], pa.int32()),
         pa.array([squeeze_keys(keys[a:b]) for _, a, b in spans], pa.binary()),
         pa.array([[squeeze(v[a:b]) for v in values] for _, a, b in spans], pa.list_(pa.binary()))], ROW_NAMES)


def totals(rows: DataFrame, reduce: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """Written table (slice, bucket, out): what ``reduce`` makes of each range, back in each row's order.

    ``reduce(keys, values)`` gets the entries of all slices of a range and
    returns integer arrays aligned with them.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")  # the order of entries doesn't depend on the shuffle
        keys = [unsqueeze_keys(k) for k in table.column("keys").to_pylist()]
        vals = [[unsqueeze(v) for v in row] for row in table.column("vals").to_pylist()]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = reduce(np.concatenate(keys), [np.concatenate([v[i] for v in vals]) for i in range(len(vals[0]))])
        parts = [np.split(o, cuts) for o in out]
        return pa.table([table.column("slice"), table.column("bucket"),
                         pa.array([[squeeze(p[i]) for p in parts] for i in range(len(keys))], pa.list_(pa.binary()))],
                        names=["slice", "bucket", "out"])

    return materialise(rows.groupBy("bucket").applyInArrow(run, "slice long, bucket int, out array<binary>"))


def with_reply(corpus: Corpus, reply: DataFrame, name: str) -> Corpus:
    """``corpus`` with the rows of ``reply`` that belong to each slice, as array ``name`` (null: none)."""
    got = (reply.repartition(corpus.buckets, "slice").groupBy("slice")
           .agg(F.sort_array(F.collect_list(F.struct("bucket", "out"))).alias(name)))
    return Corpus(corpus.slices.join(got, "slice", "left"), corpus.buckets)


def received(row: dict, name: str, arrays: int) -> list[np.ndarray]:
    """The arrays that a slice got back, aligned with its sorted keys."""
    got = row[name] or []
    return [np.concatenate([unsqueeze(r["out"][i]) for r in got]) if got else np.zeros(0, np.int64) for i in range(arrays)]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, group): a sort of ``keys``, where each distinct key starts in it, and each entry's group."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order, np.flatnonzero(fresh), group
