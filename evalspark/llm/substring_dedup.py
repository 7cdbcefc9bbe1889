"""Substring dedup on the de Bruijn graph of token k-mers.

Every window of k words is an edge from the node of its first k - 1 words to
that of its last k - 1. An edge that occurs in several documents is repeated;
its source is its first occurrence by (doc_id, position). Stretches of a
document whose edges have consecutive sources are segments; segments that
meet in a node where the repeated graph doesn't branch are compacted to paths
through Spark joins. A second hash taken at the source coordinates must agree
for every edge of a span.

Most windows occur once. A window can only be repeated if its minimizer (the
smallest hash of its 5-word pieces) is, and there are far fewer minimizers:
they're counted first, and only windows with a repeated one become edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import packed
from evalspark.llm.common import hash_words, materialise, mix64, tokenise
from evalspark.llm.components import path_ends

K = 13
PIECE = 5
KEY, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CHECK_BITS = 0xFFFF


def _rolling(words: np.ndarray, k: int, factor: np.uint64) -> np.ndarray:
    """Hash of every k consecutive words (the last k - 1 places are left out)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * factor + words[j:j + n]
    return mix64(out)


class _Windows:
    """Windows of a slice: first word, document row, minimizer and hashes."""

    def __init__(self, row: dict, k: int) -> None:
        t = tokenise(pa.array(packed.slice_texts(row), pa.binary()).cast(pa.string()))
        self.words = hash_words(t.words)[t.codes] if len(t.words) else np.zeros(0, np.uint64)
        self.offsets = t.offsets
        n = max(0, len(t.codes) - k + 1)
        doc = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
        known = np.array([i is not None for i in row["ids"]], bool)
        ids = np.array([i or 0 for i in row["ids"]], np.int64)
        ok = (doc[:n] == doc[k - 1:]) & known[doc[:n]] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(ok)
        self.row = doc[self.at]
        self.id = ids[self.row]
        self.pos = self.at - t.offsets[:-1][self.row]
        self.k = k

    def minimizers(self) -> np.ndarray:
        piece = min(PIECE, self.k)
        hashes = _rolling(self.words, piece, KEY)
        low = hashes[self.at] if len(self.at) else np.zeros(0, np.uint64)
        for j in range(1, self.k - piece + 1):
            low = np.minimum(low, hashes[self.at + j])
        return mix64(low)  # smallest hashes are small: scrambled, they fill all key ranges alike

    def hashes(self, of: np.ndarray, k: int, factor: np.uint64 = KEY, shift: int = 0) -> np.ndarray:
        return _rolling(self.words, k, factor)[self.at[of] + shift] if len(of) else np.zeros(0, np.uint64)


def _send_minimizers(k: int, ranges: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            w = _Windows(row, k)
            low = w.minimizers()
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (w.row[1:] != w.row[:-1])
            per_doc = np.unique(np.stack([low[new], w.row[new].astype(np.uint64)], axis=1), axis=0)[:, 0]
            keys, n = np.unique(per_doc, return_counts=True)
            yield packed.send(row["slice"], keys, [n], ranges)

    return run


def _count(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    order, starts, group = packed.grouped(keys)
    return [(np.add.reduceat(values[0][order], starts)[group] >= 2).astype(np.int64)]


class _Edges:
    """Windows of a slice whose minimizer occurs in several documents."""

    def __init__(self, row: dict, k: int) -> None:
        self.w = _Windows(row, k)
        low = self.w.minimizers()
        keys = np.unique(low)
        (repeated,) = packed.received(row, "seen", 1)
        self.of = np.flatnonzero(repeated[np.searchsorted(keys, low)]) if len(keys) else np.zeros(0, np.int64)
        self.hash = self.w.hashes(self.of, k)
        self.check = (self.w.hashes(self.of, k, CHECK) & np.uint64(CHECK_BITS)).astype(np.int64)
        self.id, self.pos, self.row = self.w.id[self.of], self.w.pos[self.of], self.w.row[self.of]
        self.keys, self.key = np.unique(self.hash, return_inverse=True)


def _send_edges(k: int, ranges: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            e = _Edges(row, k)
            first = np.lexsort((e.pos, e.id, e.key))
            first = first[np.r_[True, e.key[first][1:] != e.key[first][:-1]]] if len(first) else first
            yield packed.send(row["slice"], e.keys, [e.id[first], e.pos[first], e.check[first]], ranges)

    return run


def _sources(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    doc, pos, check = values
    order = np.lexsort((pos, doc, keys))
    fresh = np.r_[True, keys[order][1:] != keys[order][:-1]]
    starts = order[fresh]
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return [doc[starts][group], pos[starts][group], (check == check[starts][group]).astype(np.int64)]


def _segments(k: int):
    """(slice, row, start, size, u, v): stretches of edges with consecutive sources in a smaller document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            e = _Edges(row, k)
            source, place, agrees = (x[e.key] if len(x) else x for x in packed.received(row, "source", 3))
            hit = np.flatnonzero((source < e.id) & (agrees == 1)) if len(e.of) else np.zeros(0, np.int64)
            if not len(hit):
                continue
            r, p, s, q = e.row[hit], e.pos[hit], source[hit], place[hit]
            new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1]) | (q[1:] != q[:-1] + 1)]
            a = np.flatnonzero(new)
            z = np.r_[a[1:], len(hit)] - 1
            u = e.w.hashes(e.of[hit[a]], k - 1).view(np.int64)
            v = e.w.hashes(e.of[hit[z]], k - 1, shift=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), row["slice"])), pa.array(r[a].astype(np.int32)), pa.array(p[a]), pa.array(p[z] - p[a] + 1),
                 pa.array(s[a]), pa.array(q[a]), pa.array(u), pa.array(v)],
                ["slice", "row", "start", "size", "source", "source_start", "u", "v"])

    return run


def compact(segments: DataFrame) -> DataFrame:
    """(slice, row, start, size, source, source_start): spans after segments that meet in a nonbranching node are joined.

    A node branches if distinct source stretches enter or leave it in more
    than one way. Two segments of a document meet when one starts at the
    window after the other's last; chains of meetings are followed to their
    ends through Spark joins (pointer doubling), and each chain becomes one
    span.
    """
    named = materialise(segments.withColumn("id", F.xxhash64("slice", "row", "start")))
    kinds = named.select("u", "v", "source", "source_start").distinct()
    inward = kinds.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"))
    outward = kinds.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"))
    # Written, so that the next join has plain exchanges on both sides: a passage that very many
    # documents share ends in one node, and Spark can then split that node's segments.
    plain = materialise(inward.join(outward, "node").filter("n_in = 1 and n_out = 1").select(F.col("node").alias("plain")))
    left = named.join(plain, named.v == plain.plain, "left_semi").select(
        "slice", "row", (F.col("start") + F.col("size")).alias("start"), F.col("id").alias("a"))
    meets = left.join(named.select("slice", "row", "start", F.col("id").alias("b")), ["slice", "row", "start"]).select("a", "b")
    ends = path_ends(meets)
    return (named.join(ends, named.id == ends.node, "left").withColumn("path", F.coalesce("last", "id"))
            .groupBy("slice", "row", "path")
            .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("size")) - F.min("start")).alias("size"),
                 F.min_by(F.struct("source", "source_start"), "start").alias("s"))
            .select("slice", "row", "start", "size", "s.*"))


def repeated_spans(corpus: packed.Corpus, k: int = K) -> DataFrame:
    """Spans of windows whose word sequence also starts in a document with a smaller doc_id.

    ``start`` and ``size`` count windows: the words covered are start to
    start + size + k - 2. ``source``, ``source_start``: where its first
    window occurs first.
    """
    r = packed.ranges_for(corpus, 0.04)
    seen = packed.totals(corpus.slices.mapInArrow(_send_minimizers(k, r), packed.ROW_KIND), _count)
    once = packed.with_reply(corpus, seen, "seen")
    edges = once.slices.mapInArrow(_send_edges(k, r), packed.ROW_KIND)
    source = packed.totals(edges, _sources)
    twice = packed.with_reply(once, source, "source")
    return compact(twice.slices.mapInArrow(_segments(k), "slice long, row int, start long, size long, source long, source_start long, u long, v long"))


def dedup(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row of ``docs`` (doc_id, text).

    A word goes if it's covered by a window of ``k`` consecutive words that
    also starts in a document with a smaller doc_id. Words are runs of other
    characters than space and \\t..\\r, unchanged. A null or empty text has
    none (the hash is that of no bytes); texts under ``k`` words have no
    window. Rows that repeat a doc_id are one document to each other: none
    of them is smaller. A null doc_id is neither smaller nor larger than any
    other: its row keeps all words. Repeats within a document stay. An empty
    table gives an empty result; other columns aren't read. ``spans`` are
    the removed word ranges (end exclusive).
    """
    corpus = packed.cut_slices(docs)
    spans = repeated_spans(corpus, k)
    lists = spans.repartition(corpus.buckets, "slice").groupBy("slice").agg(F.collect_list(F.struct("row", "start", "size")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            by_row: dict[int, list[tuple[int, int]]] = {}
            for s in row["spans"] or []:
                by_row.setdefault(s["row"], []).append((s["start"], s["start"] + s["size"] + k - 1))
            n, gone, sha, cut = [], [], [], []
            for i, text in enumerate(packed.slice_texts(row)):
                words = text.split()
                merged: list[list[int]] = []
                for a, b in sorted(by_row.get(i, [])):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept += words[at:a]
                    at = b
                kept = kept + words[at:] if merged else words
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(sha256(b" ".join(kept)).hexdigest())
                cut.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return (corpus.slices.join(lists, "slice", "left")
            .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"))
