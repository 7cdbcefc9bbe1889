"""Phrase collocation mining by Rabin-Karp fingerprints.

The words of a slice of texts lie in one byte array, joined by single
spaces. With Q[i] the sum of byte j times B^-j over j < i (modulo 2^64, B
odd), every n-gram from byte s to byte e has the fingerprint
(Q[e] - Q[s]) * B^e: one subtraction and one product, whatever its length.
Language and number of words are mixed in.

Three passes over the texts; only fingerprints of what may still be frequent
are shuffled, summed up in the task first:

1. words and pairs of words;
2. longer n-grams all of whose pairs are frequent (both as pieces: sorted
   fingerprints and counts of one part of the key range, compressed, in one
   row; rows are in proportion to the texts);
3. every occurrence of a frequent fingerprint points into its slice and is
   compared with the text that the first one points at, so the counts of the
   phrases, which only now become text, don't depend on the hash. A task sends
   its phrases once, merged and compressed.

Between passes the frequent fingerprints travel as a bit filter of fixed
size. A bit that is set by mistake costs a row, never a result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import UPPER, materialise, mix64, text_slices
from evalspark.llm.packed import rows_of, squeeze, squeeze_keys, unsqueeze, unsqueeze_keys

LEAST = 100              # occurrences of a candidate
LONGEST = 5              # words of a candidate
TOP = 2000               # candidates reported per language
FILTER_BITS = 26         # the filter has 2^26 bits (8 MB)
SLICE = 1 << 20          # bytes of text in a slice: its prefix sums take eight times as much, each
ENTRIES = 2 << 20        # fingerprints gathered in a task before they're summed up, and wanted in a part
PART_BITS = 8            # first bits of a fingerprint that name its part of the key range
PHRASE = ["lang", "phrase", "words", "c", "first_doc_id"]
PIECE = "part long, m long, keys binary, counts binary"
ROWS_AT_ONCE = 1 << 17
PHRASES_AT_ONCE = 1 << 19
BASE = 0x9E3779B97F4A7C15    # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = (1 << 63) - 1
UNKNOWN = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    for c in UPPER.encode():
        lower[c] += 32
    lower[list(BLANKS)] = 32
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)], kind[list(BREAKS)] = 1, 2
    return lower, kind


LOWER, KIND = _tables()
_POWERS: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """step^0 .. step^(n-1) modulo 2^64; the worker keeps the longest table."""
    table = _POWERS.get(step)
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 20), step, np.uint64)
        steps[0] = 1
        table = _POWERS[step] = np.multiply.accumulate(steps)
    return table[:n]


class Words(NamedTuple):
    """Words of a blob: word i is ``data[start[i]:end[i]]``; words of one piece lie one space apart."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    doc: np.ndarray


def cut_words(blob: np.ndarray, doc_start: np.ndarray) -> Words:
    """Lower-cased words of a blob of texts that begin at ``doc_start`` and end with a break."""
    kind, low = KIND[blob], LOWER[blob]
    word = kind == 0
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(np.flatnonzero(kind == 2), start)
    joined = np.zeros(len(start), np.int64)
    joined[1:] = piece[1:] == piece[:-1]
    word[start[joined == 1] - 1] = True     # the blank before a word of the same piece
    size = end - start
    new_end = np.cumsum(size + joined)
    return Words(low[word], new_end - size, new_end, piece, np.searchsorted(doc_start, start, "right") - 1)


def blobs(texts: pa.Array, max_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, start of each text in them): the texts with breaks between, cut at breaks if they're long."""
    data = texts.cast(pa.binary()).to_pylist()
    size = np.array([len(t) + 1 for t in data], np.int64)
    start = np.cumsum(size) - size
    blob = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    at = 0
    if len(blob) > 2 * max_bytes:
        breaks = np.flatnonzero(KIND[blob] == 2) + 1
        while len(blob) - at > 2 * max_bytes:
            cut = int(breaks[np.searchsorted(breaks, at + max_bytes)])
            yield blob[at:cut], start - at
            at = cut
    yield blob[at:], start - at


class Filter:
    """Bit filter over fingerprints: their first ``bits`` bits name a bit. False positives only."""

    def __init__(self, bits: int, cells: np.ndarray) -> None:
        self.bits, self.cells = bits, cells

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return self.cells[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


class Prints:
    """Fingerprints of the n-grams of a blob, from prefix sums of its polynomial."""

    def __init__(self, words: Words, seeds: np.ndarray) -> None:
        n = len(words.data)
        self.words, self.seed = words, seeds[words.doc]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(powers(INVERSE, n) * (words.data.astype(np.uint64) + np.uint64(1)), out=self.prefix[1:])
        self.power = powers(BASE, n + 1)

    def runs(self, n: int) -> np.ndarray:
        """First words of all n-grams within pieces."""
        piece = self.words.piece
        return np.flatnonzero(piece[:max(0, len(piece) - n + 1)] == piece[n - 1:])

    def of(self, first: np.ndarray, n: int) -> np.ndarray:
        end = self.words.end[first + n - 1]
        h = (self.prefix[end] - self.prefix[self.words.start[first]]) * self.power[end]
        return mix64(h + self.seed[first] + np.uint64(n * 0xD1B54A32D192ED03 % (1 << 64)))

    def longer_runs(self, longest: int, has: Filter) -> Iterator[tuple[int, np.ndarray]]:
        """(n, first words) for n from 3: the n-grams all of whose pairs pass the filter."""
        pair = np.zeros(len(self.words.start), bool)
        first = self.runs(2)
        pair[first[has(self.of(first, 2))]] = True
        run = pair.copy()
        for n in range(3, longest + 1):     # a pair at the next word lies in the same piece
            run[:len(run) - n + 2] &= pair[n - 2:]
            run[max(0, len(run) - n + 2):] = False
            yield n, np.flatnonzero(run)


def _prints_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Prints, list[str], np.ndarray, np.ndarray]]:
    """(prints, language names, language and doc_id of each text) of every blob of a partition."""
    import xxhash

    for part in text_slices(batches, max_bytes=SLICE):
        langs = part.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        seeds = np.array([xxhash.xxh64_intdigest(x, 7) for x in names], np.uint64)
        lang, ids = langs.indices.to_numpy(), part.column("doc_id").to_numpy()
        for blob, start in blobs(part.column("text"), SLICE):
            words = cut_words(blob, start)
            if len(words.start):
                yield Prints(words, seeds[lang]), names, lang, ids


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k = k[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c[order], first) if len(k) else c


def _pieces(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, m, keys, counts): sorted fingerprints cut where their first ``bits`` bits change."""
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate([[0], edges, [len(keys)]])
    parts = np.flatnonzero(np.diff(edges))
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[edges[parts]] >> np.uint64(64 - bits)).cast(pa.int64()), pa.array(np.diff(edges)[parts]),
         pa.array([squeeze_keys(keys[edges[i]:edges[i + 1]]) for i in parts], pa.binary()),
         pa.array([squeeze(counts[edges[i]:edges[i + 1]]) for i in parts], pa.binary())], ["part", "m", "keys", "counts"])


def _counted(grams: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of a task as pieces, summed up ENTRIES at a time."""
    keys, size = [], 0
    for part in grams:
        keys.append(part)
        size += len(part)
        if size >= ENTRIES:
            yield from _pieces(*_summed(keys, [np.ones(size, np.int64)]), PART_BITS)
            keys, size = [], 0
    if size:
        yield from _pieces(*_summed(keys, [np.ones(size, np.int64)]), PART_BITS)


def _split(pieces: DataFrame, bits: int) -> DataFrame:
    """Pieces cut anew by their first ``bits`` bits."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from _pieces(unsqueeze_keys(row["keys"]), unsqueeze(row["counts"]), bits)

    return pieces.mapInArrow(run, PIECE)


def _filter(pieces: DataFrame, least: int, bits: int, part_entries: int = ENTRIES) -> Filter:
    """The filter of the fingerprints with ``least`` occurrences.

    Pieces meet by part of the key range; parts of more than
    ``part_entries`` entries are cut finer first. At most 2^bits / 64 words
    reach the driver, however many fingerprints pass.
    """
    entries = pieces.agg(F.sum("m")).first()[0] or 0
    finer = PART_BITS
    while entries >> finer > part_entries and finer < bits:
        finer += 1
    if finer > PART_BITS:
        pieces = _split(pieces, finer)

    def run(table: pa.Table) -> pa.Table:
        keys, total = _summed([unsqueeze_keys(k) for k in table.column("keys").to_pylist()],
                              [unsqueeze(c) for c in table.column("counts").to_pylist()])
        at = keys[total >= least] >> np.uint64(64 - bits)
        cell = (at >> np.uint64(6)).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        return pa.table([pa.array(cell[first]), pa.array(mask.view(np.int64))], names=["cell", "mask"])

    # a part's cells are its own (2^bits / 64 cells, more than parts), but for parts finer than a cell
    cells = (pieces.groupBy("part").applyInArrow(run, "cell long, mask long")
             .groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow())
    out = np.zeros(1 << bits - 6, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return Filter(bits, out)


def _same(words: Words, first: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-grams at ``first`` and ``other`` have the same bytes."""
    a, b = words.start[first], words.start[other]
    size = words.end[first + n - 1] - a
    equal = size == words.end[other + n - 1] - b
    at = np.flatnonzero(equal)
    for i in range(0, len(at), ROWS_AT_ONCE):
        part = at[i:i + ROWS_AT_ONCE]
        m = size[part]
        ends = np.cumsum(m)
        step = np.arange(ends[-1]) - np.repeat(ends - m, m)
        wrong = np.flatnonzero(words.data[np.repeat(a[part], m) + step] != words.data[np.repeat(b[part], m) + step])
        equal[part[np.searchsorted(ends, wrong, "right")]] = False
    return equal


def _strings(words: Words, first: np.ndarray, n: int) -> pa.Array:
    start = words.start[first]
    size = words.end[first + n - 1] - start
    ends = np.cumsum(size)
    data = words.data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
    return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])


def _verified(prints: Prints, first: np.ndarray, keys: np.ndarray, n: int, names: list[str], lang: np.ndarray,
              ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, lang, phrase, words, c, first_doc_id): occurrences that share a fingerprint and a text are one row."""
    words = prints.words
    order = np.argsort(keys, kind="stable")
    keys, first = keys[order], first[order]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    pointer = first[head][np.cumsum(head) - 1]
    doc = words.doc[first]
    same = _same(words, first, pointer, n) & (lang[doc] == lang[words.doc[pointer]])
    head |= ~same               # an occurrence with another text is a row of its own, and so is what follows it
    head[1:] |= ~same[:-1]
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(first)))
    low = np.minimum.reduceat(ids[doc], at)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys[at] >> np.uint64(64 - PART_BITS)).cast(pa.int64()), pa.array(names).take(pa.array(lang[doc[at]])), _strings(words, first[at], n), pa.array(np.full(len(at), n, np.int32)),
         pa.array(count), pa.array(low, mask=low == NO_ID)], ["part", *PHRASE])


def _merged(rows: pa.Table) -> pa.Table:
    """Rows of equal (part, lang, phrase, words) as one."""
    got = rows.group_by(["part", "lang", "phrase", "words"]).aggregate([("c", "sum"), ("first_doc_id", "min")])
    return got.rename_columns(["part", *PHRASE])


def _gathered(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, data): a task's phrases as compressed Arrow tables, one per part of the key range.

    Equal phrases are merged, PHRASES_AT_ONCE rows at a time.
    """
    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("part")
        part = rows.column("part").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
        data = []
        for x, y in zip(edges, edges[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.slice(x, y - x))
            data.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int64()), pa.array(data, pa.binary())], ["part", "data"])

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.num_rows
        if size >= PHRASES_AT_ONCE:
            rows = _merged(pa.Table.from_batches(held))
            held, size = rows.combine_chunks().to_batches(), rows.num_rows
            if size >= PHRASES_AT_ONCE / 2:
                yield from packed(rows)
                held, size = [], 0
    if size:
        yield from packed(_merged(pa.Table.from_batches(held)))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, words, a, first_doc_id) of 1 to ``longest`` words, and (lang, n): words per language.

    A-Z are lower-cased; texts (null: empty) are cut into pieces at
    ``. , ; : ! ?`` and \n to \r, pieces into words at spaces and tabs. Null
    languages are ``und``. ``a`` counts all contiguous occurrences within
    pieces and is at least ``least``; first_doc_id is the smallest doc_id
    with the phrase (null: only rows without). The counts are exact,
    whatever ``bits`` is.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def grams() -> Iterator[np.ndarray]:
            for p, names, lang, _ in _prints_of(batches):
                for i, m in enumerate(np.bincount(lang[p.words.doc], minlength=len(names)).tolist()):
                    total[names[i]] = total.get(names[i], 0) + m
                for n in (1, 2):
                    yield p.of(p.runs(n), n)

        for b in _counted(grams()):
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.string()), *b.columns], ["lang", *b.schema.names])
        none = [pa.nulls(len(total), t) for t in (pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), none[0], pa.array(list(total.values()), pa.int64()), *none[1:]],
                                         ["lang", "part", "m", "keys", "counts"])

    counted = materialise(rows.mapInArrow(short, f"lang string, {PIECE}"))
    sizes = counted.filter("lang is not null").groupBy("lang").agg(F.sum("m").alias("n"))
    pairs = spark.sparkContext.broadcast(_filter(counted.filter("lang is null").drop("lang"), least, bits))   # of fixed size

    def long(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(p.of(first, n) for p, *_ in _prints_of(batches) for n, first in p.longer_runs(longest, pairs.value))

    wide = spark.sparkContext.broadcast(_filter(materialise(rows.mapInArrow(long, PIECE)), least, bits))

    def text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(occurrences(batches))

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, *names in _prints_of(batches):
            runs = [(n, p.runs(n), pairs.value) for n in (1, 2)]
            for n, first, has in [*runs, *((n, first, wide.value) for n, first in p.longer_runs(longest, pairs.value))]:
                keys = p.of(first, n)
                ok = has(keys)
                if ok.any():
                    yield from _verified(p, first[ok], keys[ok], n, *names)

    def frequent(table: pa.Table) -> pa.Table:
        rows = _merged(pa.concat_tables([pa.ipc.open_stream(d.as_buffer()).read_all() for d in table.column("data")]))
        return rows.filter(pc.greater_equal(rows.column("c"), least)).select(PHRASE)

    exact = (rows.mapInArrow(text, "part long, data binary").groupBy("part")
             .applyInArrow(frequent, "lang string, phrase string, words int, c long, first_doc_id long")
             .filter(F.col("words") <= longest).withColumnRenamed("c", "a"))
    return materialise(exact), sizes


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score, first_doc_id): each language's best phrases of ``docs`` (doc_id, text, lang).

    Candidates are the frequent phrases of two words or more. A cut after k
    words gives l = f(first part), r = f(rest) and floor(1000 a n / (l r)),
    computed in decimals; the lowest score counts, ties to the smallest k. A
    candidate that lies inside a longer one that is as frequent goes: then
    some candidate longer by one word is as frequent too, so prefixes and
    suffixes tell. Ranks go by score and a descending, then phrase (byte
    order). Repeated rows count as often as they come; an empty table, or
    texts without words, give an empty result; other columns aren't read.
    """
    known, sizes = phrases(docs, least, longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored(known, sizes).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score", "first_doc_id"))


def scored(known: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score, first_doc_id) of the candidates that don't lie in a longer one as frequent."""
    candidates = known.filter("words > 1")
    parts = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice(parts, a, n), " ")
    inside = (candidates.filter("words > 2").select("lang", "a", F.explode(F.array(join(F.lit(1), F.col("words") - 1), join(F.lit(2), F.col("words") - 1))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (candidates.join(inside, ["lang", "phrase"], "left").filter("longer is null or longer < a").drop("longer"))
    cuts = (kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("head", join(F.lit(1), F.col("k"))).withColumn("tail", join(F.col("k") + 1, F.col("words"))))
    of_head = known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    of_tail = known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    joined = (cuts.join(of_head, ["lang", "head"]).join(of_tail, ["lang", "tail"]).join(sizes, "lang")
              .withColumn("above", (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n")).withColumn("below", wide("l") * wide("r"))
              .withColumn("score", F.expr("above div below")))
    best = joined.groupBy("lang", "phrase", "words", "a", "n", "first_doc_id").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", F.col("b.l"), F.col("b.r"), "n", F.col("b.score"), "first_doc_id")
