"""Randomised edit embedding: edit distance becomes Hamming distance.

A walk reads a text: at step j it writes the character under its pointer and
moves on if a random function h(j, character), shared by all texts, says so.
Two texts that differ by a few edits soon read the same characters at the
same steps again, so the written sequences differ in few places. Texts are
walked in blocks that the text itself cuts: after 8 characters whose hash says
so (one place in 256), or 512 characters after the last cut; so blocks after
an edit are the same again. A block is walked for three steps per
character; every 32nd step or so is sampled (more at the start of a text), and
its character hashed to a digit 1-15. The digits of all blocks, as
hexadecimal text, are the fingerprint of the whole text. Likeness aligns the
blocks of two texts and gives the share of equal digits.

Near duplicates: bands of digits propose candidates, and the likeness of the
whole fingerprints verifies them. Bands are all runs of eight sampled
digits of every block, wherever in the text the block is, and those of the
first block's extra digits, which short texts have, too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import block_pairs, group_runs, linked_labels, materialise, mix64, run_bounds, text_slices
from evalspark.llm.components import connected_components

BLOCK = 512
STEPS = 3 * BLOCK
SAMPLES = STEPS // 32        # sampled steps of every block
FIRST = 32                   # more of them in the first 128 steps of a text
RUN_DIGITS, LEAST_DIGITS = 8, 4   # bands: runs of eight digits; a block of four or more is one run
RANGE_ROWS = 4096            # documents in a range of doc_ids, about
MAX_RANGES = 10_000
BLOCK_ROWS = 256
ROWS_AT_ONCE = 256           # documents that are unpacked and walked at a time
CUT_EVERY, CUT_DOUBLINGS = 256, 3   # a content cut after one place in 256, by the hash of its last 2^3 characters
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(maxsize=4)
def _walk_tables(seed: int):
    """h(step, class) as 0/1, the sampled steps of the first and of later blocks, digit tables."""
    rng = np.random.default_rng(seed)
    move = rng.integers(0, 2, (STEPS, 256), dtype=np.int64)
    move[:, 0] = 0  # class 0 is the end of a block
    later = np.arange(SAMPLES) * 32 + rng.integers(0, 32, SAMPLES)
    extra = np.setdiff1d(np.arange(8, 128), later)
    steps = np.union1d(later, np.append(np.arange(8), rng.choice(extra, FIRST - 8, replace=False)))  # step 0 reads the first character
    digit = rng.integers(1, 16, (len(steps), 256), dtype=np.uint8)
    digit[:, 0] = 0
    return move, steps, np.isin(steps, later), digit


def _classes(cp: np.ndarray) -> np.ndarray:
    return (mix64(cp.astype(np.uint64)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal digits among those that either text has; 1 for two empty texts."""
    n = max(len(a), len(b))
    if n == 0:
        return 1.0
    m = min(len(a), len(b))
    either = int(((a[:m] | b[:m]) != 0).sum() + np.count_nonzero(a[m:]) + np.count_nonzero(b[m:]))
    return float(((a[:m] == b[:m]) & (a[:m] != 0)).sum()) / either


def to_text(digits: np.ndarray) -> str:
    return HEX[digits].tobytes().decode()


def from_text(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode(), np.uint8)
    return np.where(x >= 97, x - 87, x - 48).astype(np.uint8)


def _content_starts(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start of every content block in the joined texts, and each text's number of blocks."""
    size = np.array([len(p) for p in points], np.int64)
    begin = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(begin, size)
    h, factor = mix64(np.concatenate(points).astype(np.uint64)), 0x9E3779B97F4A7C15
    for i in range(CUT_DOUBLINGS):
        h[1 << i:] = h[1 << i:] + h[:-(1 << i)] * np.uint64(factor)
        factor = factor * factor % (1 << 64)
    cut = (mix64(h) % np.uint64(CUT_EVERY) == 0) & (within >= (1 << CUT_DOUBLINGS) - 1)
    start = np.union1d(begin[size > 0], np.flatnonzero(cut) + 1)
    start = start[start < len(h)]
    n = -(-np.diff(start, append=len(h)) // BLOCK)
    start = np.repeat(start, n) + BLOCK * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return start, np.diff(np.searchsorted(start, np.append(begin, len(h))))


def content_prints(texts: list[str], seed: int = 7) -> list[str]:
    """Fingerprint of every text: the first block's extra digits, then the digits of each block, joined by dots.

    A block has a digit for each sampled step it reaches, without zeros at
    the end. An empty text has the empty fingerprint.
    """
    move, steps, is_later, digit = _walk_tables(seed)
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    if not any(map(len, points)):
        return [""] * len(texts)
    start, blocks = _content_starts(points)
    total = sum(map(len, points))
    size = np.diff(start, append=total)
    number = np.arange(len(start))
    flat = np.zeros(total + len(start), np.uint8)
    flat[np.arange(total) + np.repeat(number, size)] = _classes(np.concatenate(points))
    order = np.argsort(-size, kind="stable")
    pointer = (start + number)[order]
    ends = np.searchsorted(-3 * size[order], -np.arange(3 * int(size.max())))  # blocks with more than 3 j steps
    out = np.zeros((len(start), len(steps)), np.uint8)
    sampled = {int(x): k for k, x in enumerate(steps)}
    for j, m in enumerate(ends.tolist()):
        c = flat[pointer[:m]]
        k = sampled.get(j)
        if k is not None:
            out[:m, k] = digit[k][c]
        pointer[:m] += move[j][c]
    back = np.empty_like(order)
    back[order] = number
    last = np.cumsum(blocks)
    own, extra = to_text(out[back][:, is_later].ravel()), out[back[(last - blocks)[blocks > 0]]][:, ~is_later]
    heads = iter(to_text(row).rstrip("0") for row in extra)
    bodies = [own[a:a + SAMPLES].rstrip("0") for a in range(0, len(own), SAMPLES)]
    return [".".join([next(heads), *bodies[b - n:b]]) if n else "" for n, b in zip(blocks.tolist(), last.tolist())]


def _aligned(x: list[str], y: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of blocks: those that both have just once, in the longest common order; what lies between, from both ends."""
    count_x, count_y = Counter(x), Counter(y)
    where = {b: j for j, b in enumerate(y) if count_y[b] == 1}
    tails: list[int] = []
    ends: list[tuple] = []  # per length: (i, j, chain before)
    for i, b in enumerate(x):
        j = where.get(b, -1) if count_x[b] == 1 else -1
        if j >= 0:
            k = bisect_left(tails, j)
            link = (i, j, ends[k - 1] if k else None)
            tails[k:k + 1], ends[k:k + 1] = [j], [link]
    anchors, link = [(len(x), len(y))], ends[-1] if ends else None
    while link:
        anchors.append(link[:2])
        link = link[2]
    i = j = 0
    for p, q in reversed(anchors):
        a, b = x[i:p], y[j:q]
        least = min(len(a), len(b))
        head = next((k for k in range(least) if a[k] != b[k]), least)
        tail = next((k for k in range(least - head) if a[-1 - k] != b[-1 - k]), least - head)
        yield from zip(a[:head], b[:head])
        yield from zip_longest(a[head:len(a) - tail], b[head:len(b) - tail], fillvalue="")
        yield from zip(a[len(a) - tail:], b[len(b) - tail:])
        if p < len(x):
            yield x[p], y[q]
        i, j = p + 1, q + 1


def content_likeness(a: str, b: str) -> float:
    """``likeness`` of two fingerprints whose blocks are aligned first."""
    if a == b:
        return 1.0
    a, b = sorted((a, b))
    (head_a, *x), (head_b, *y) = a.split("."), b.split(".")
    pairs = [(p, q, max(len(p), len(q))) for p, q in [(head_a, head_b), *_aligned(x, y)]]
    return likeness(from_text("".join(p.ljust(n, "0") for p, _, n in pairs)), from_text("".join(q.ljust(n, "0") for _, q, n in pairs)))


def band_keys(content: str, seed: int = 7) -> list[int]:
    """Distinct keys of a fingerprint's bands (none for an empty text).

    One for each run of digits of every block, and of the first block's
    extra digits; a block's number is no part of the key.
    """
    import xxhash

    head, *blocks = content.split(".")
    runs = set()
    for name, digits, least in [("h", head, 1), *(("", block, LEAST_DIGITS) for block in set(blocks))]:
        last = max(0, len(digits) - RUN_DIGITS)
        if len(digits) >= least:
            runs.update(f"{name}{k}:{digits[k:k + RUN_DIGITS]}" for k in [*range(0, last, RUN_DIGITS), last])
    return np.array([xxhash.xxh64_intdigest(r, seed) for r in sorted(runs)], np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, fingerprint, bands) of every row of ``docs`` (doc_id, text); null is an empty text.

    Equal texts have equal fingerprints; an empty text has the empty one and
    no bands. One row per input row; other columns aren't read.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            content = content_prints([t or "" for t in part.column("text").to_pylist()], seed)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(content, pa.string()), pa.array([band_keys(c, seed) for c in content], pa.list_(pa.int64()))],
                ["doc_id", "fingerprint", "bands"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, fingerprint string, bands array<long>"))


def near_duplicates(prints: DataFrame, threshold: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, component_id) of every row of ``prints`` (doc_id, fingerprint, bands).

    Fingerprints that share a band and have a likeness of ``threshold`` or
    more link; component_id is the smallest doc_id reachable. Equal
    fingerprints are one node; empty ones belong together. Every candidate
    of a band is compared, in blocks of bounded size; bands that hold the
    same fingerprints (near copies share most of theirs) are compared once.
    """
    rows = prints.select("doc_id", "fingerprint", "bands", F.xxhash64("fingerprint").alias("fh"))
    nodes = materialise(rows.groupBy("fingerprint", "fh").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands")))
    keys = ["key", "_bi", "_bj"]
    posts = nodes.select("fh", F.explode("bands").alias("key"))
    held = posts.groupBy("key").agg(F.count("*").alias("n"), *[F.expr(f"bit_xor(xxhash64({i}, fh))").alias(f"s{i}") for i in (1, 2)]).filter("n > 1")
    picked = held.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    members = materialise(posts.join(picked, "key")).join(nodes.select("fh", "fingerprint"), "fh")
    units = block_pairs(members, ["key"], F.col("fh"), block_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_runs(batches, keys):
            bounds = run_bounds(table, keys)
            ids, prints_ = table.column("fh").to_numpy(), table.column("fingerprint")
            a_, b_ = [], []
            for a, b in zip(bounds, bounds[1:]):
                own = prints_.slice(a, b - a).to_pylist()
                near = np.eye(b - a, dtype=bool)
                for i in range(b - a):
                    for j in range(i):
                        near[i, j] = near[j, i] = content_likeness(own[i], own[j]) >= threshold
                root = linked_labels(near)
                far = np.flatnonzero(root != np.arange(b - a))
                a_.append(ids[a:b][far])
                b_.append(ids[a:b][root[far]])
            if a_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_)), pa.array(np.concatenate(b_))], ["a", "b"])

    links = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()
    roots = connected_components(links)
    classed = nodes.join(roots, nodes.fh == roots.node, "left").select("fh", "low", F.coalesce("root", "fh").alias("root"))
    ids = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "fh").join(classed.join(ids, "root").select("fh", "component_id"), "fh").select("doc_id", "component_id")


def with_next(docs: DataFrame, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, bands. The edited text has its last
    floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document by doc_id (after the last: the first; rows of one
    doc_id by the hash of their texts, a null doc_id before all others).

    Documents are dealt to ranges of doc_id, compressed; a range also gets
    the first document of the next one, so every document meets its
    successor. The bounds of the ranges (at most 10,000 ids) are all that
    the driver sees. An empty table gives an empty result; other columns
    aren't read.
    """
    low = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low))
    ids = docs.select(key.alias("k"))
    n, least = ids.agg(F.count("*"), F.min("k")).first()
    p = max(1, min(MAX_RANGES, n // range_rows))
    marks = [i / p for i in range(1, p)]
    cuts = ids.agg(F.percentile_approx("k", marks, max(1000, 20 * p))).first()[0] if marks and n else []
    bounds = np.array(sorted({x for x in cuts or [] if x > (least or 0)}), np.int64)
    smallest = least

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for part in text_slices(batches, max_bytes=1 << 20):
            k = part.column("k").to_numpy()
            z = [pack((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            own = np.searchsorted(bounds, k, side="right")
            heads = np.flatnonzero(np.isin(k, bounds) | (k == smallest))
            rows = np.concatenate([np.arange(len(k)), heads])
            where = np.concatenate([own, np.where(own[heads] == 0, len(bounds), own[heads] - 1)])
            extra = np.arange(len(rows)) >= len(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), pa.array(extra), *(part.column(c).take(pa.array(rows)) for c in ("k", "h", "doc_id")),
                 pa.array([z[i] for i in rows], pa.binary())], ["pid", "extra", "k", "h", "doc_id", "z"])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(a, ROWS_AT_ONCE)
                held += zip(part.column("extra").to_pylist(), part.column("doc_id").to_pylist(),
                            (unpack(z).decode("utf-8", "surrogatepass") for z in part.column("z").to_pylist()))
                yield from compare(held)
                held = held[-1:]

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        at = [i for i, r in enumerate(rows[:-1]) if not r[0]]
        if not at:
            return
        texts = [r[2] for r in rows]
        edited = []
        for i in at:
            cut = len(texts[i]) // 4
            edited.append(texts[i][:len(texts[i]) - cut] + texts[i + 1][:cut])
        prints, new = content_prints(texts, seed), content_prints(edited, seed)
        yield pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([prints[i] for i in at], pa.string()), pa.array(new, pa.string()),
            pa.array([content_likeness(prints[i], d) for i, d in zip(at, new)]),
            pa.array([content_likeness(prints[i], prints[i + 1]) for i in at]),
            pa.array([band_keys(prints[i], seed) for i in at], pa.list_(pa.int64()))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bands"])

    text = F.col("text").cast("string")
    dealt = (docs.select(F.col("doc_id").cast("long"), key.alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
             .mapInArrow(deal, "pid int, extra boolean, k long, h long, doc_id long, z binary"))
    return (dealt.repartition("pid").sortWithinPartitions("pid", "extra", "k", "h").select("extra", "doc_id", "z")
            .mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
                              "near_edited double, near_next double, bands array<long>"))
