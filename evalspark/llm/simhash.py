"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most d differing bits agree in at least
m = 8 - d of their eight byte positions. The inverted index posts every
distinct fingerprint under its positional bytes. Postings of single bytes
would hold 1/256 of the corpus each, so positions are taken t at a time: of m
agreeing positions, t = ceil(m / 2) lie in the same half of the fingerprint,
so it's enough to post each half's groups of t positions. Fingerprints that
meet in a posting list are tallied: pairs that share at least m positional
bytes are kept, then verified by their bit distance. Long lists are dealt to
pairs of bounded blocks; a block reports a spanning set of its links, not all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import block_pairs, group_runs, linked_labels, materialise, run_bounds, text_slices
from evalspark.llm.components import connected_components

BLOCK_ROWS = 512
SHINGLES_AT_ONCE = 1 << 16


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        part = words[a:min(a + SHINGLES_AT_ONCE, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(part)]
        hashes = np.fromiter((h(g, seed) for g in grams), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _prints(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(doc_id, th, fp) of every row: th is the text's hash, it tells rows of one doc_id apart."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = pc.ascii_lower(pc.fill_null(part.column("text"), "")).cast(pa.binary()).to_pylist()
            fps = np.array([_fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(fps)], ["doc_id", "th", "fp"])

    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long"), _text_hash(text).alias("th"), text.alias("text"))
            .mapInArrow(run, "doc_id long, th long, fp long"))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): SimHash of every whole text.

    A-Z are lower-cased, words are runs of other characters than space and
    \\t..\\r, shingles are ``shingle`` words joined by a space, repeats
    included; a text of fewer words is one shingle, a text without words (or
    null) has fingerprint 0. Bit i is 1 if it's set in over half the XXH64
    values. One row per input row; other columns are not read.
    """
    return _prints(docs, shingle, seed).select("doc_id", "fp")


def _masks(max_bits: int) -> list[int]:
    """Byte masks (as signed longs) such that fingerprints within ``max_bits`` agree under one of them."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be between 0 and 7")
    t = -(-(8 - max_bits) // 2)
    masks = [sum(0xFF << 8 * p for p in half) for lo in (0, 4) for half in combinations(range(lo, lo + 4), t)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that span every class of distinct ``fp`` within ``max_bits`` bits of each other."""
    keys = ["s", "key", "_bi", "_bj"]
    postings = F.array(*[F.struct(F.lit(i).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                         for i, m in enumerate(_masks(max_bits))])
    lists = fps.select("fp", F.inline(postings))
    units = block_pairs(lists, ["s", "key"], F.col("fp"), block_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_runs(batches, keys):
            fp = table.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            out_a, out_b = [], []
            bounds = run_bounds(table, keys)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            ok = _near(bits[two], bits[two + 1], max_bits)
            out_a.append(fp[two][ok])
            out_b.append(fp[two + 1][ok])
            for i in np.flatnonzero(size > 2):
                x = bits[bounds[i]:bounds[i + 1]]
                own = fp[bounds[i]:bounds[i + 1]]
                root = linked_labels(_near(x[:, None], x[None, :], max_bits))
                far = root != np.arange(len(x))
                out_a.append(own[far])
                out_b.append(own[root[far]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return (units.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long").distinct())


def _near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter on shared positional bytes, then the bit distance of what is left."""
    diff = np.bitwise_xor(x, y)
    shared = (np.ascontiguousarray(diff).view(np.uint8).reshape(*diff.shape, 8) == 0).sum(axis=-1)
    keep = shared >= 8 - max_bits
    keep[keep] = np.bitwise_count(diff[keep]) <= max_bits
    return keep


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (columns doc_id, text).

    component_id is the smallest doc_id among the documents whose
    fingerprints are reachable by links of at most ``max_bits`` differing
    bits. Equal fingerprints are one node of the link graph, so a group of
    copies costs one posting however large it is. Repeated rows of a doc_id
    are returned as often as they come. A null doc_id takes part like any other and is
    passed over when the smallest is taken (null if it's alone). An empty
    table gives an empty result; other columns are ignored.
    """
    return _classes(docs, shingle, max_bits, seed).select("doc_id", "fp", "component_id")


def _classes(docs: DataFrame, shingle: int, max_bits: int, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of every row; root is the group itself."""
    rows = materialise(_prints(docs, shingle, seed))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = connected_components(links(least.select("fp"), max_bits))
    classed = (least.join(roots, least.fp == roots.node, "left")
               .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    ids = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classed.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id, with all its columns.

    Rows without doc_id aren't told apart: all of them stay. A row goes only
    for its own fingerprint's group: of rows that repeat a doc_id, one stays
    for each group whose smallest doc_id it is (the smallest fingerprint).
    """
    classes = materialise(_classes(docs.select("doc_id", "text"), shingle, max_bits))
    gone = classes.filter("doc_id <> component_id").select("doc_id", "th")
    repeats = classes.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeats:
        own = classes.filter("doc_id = component_id")
        first = own.groupBy("doc_id", "root").agg(F.min(F.struct("fp", "th")).alias("first"))
        gone = gone.union(own.join(first, ["doc_id", "root"]).filter(F.struct("fp", "th") != F.col("first")).select("doc_id", "th"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    # rows travel whole in one struct, so no column of theirs can clash with the operator's
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash(F.col("text")).alias("th"))
    left = packed.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti")
    if repeats:
        left = left.filter("id is not null").dropDuplicates(["id", "th"]).unionByName(left.filter("id is null"))
    return left.select("row.*")
