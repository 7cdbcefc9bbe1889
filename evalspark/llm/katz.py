"""Katz backoff language model over words, with Good-Turing discounts.

P_k(w | c) = d(r) r / total(c) if the n-gram (c, w) was seen r > 0 times, else
alpha(c) P_{k-1}(w | shorter c); a context that was never seen leaves it to
P_{k-1} alone. d is Good-Turing's discount for r up to 5 and 1 above. alpha is
normalised exactly: (1 - sum of the discounted probabilities seen after c) /
(1 - sum of P_{k-1} of the same words). Unigrams leave the mass of one more
type to unknown words, so every conditional distribution sums to 1.

Counts and context sums are totals over key ranges (``packed``): tables of the
checkpoint folder, dealt by range of the n-gram's hash, whose entries return
to the slices that hold the texts. There every token is evaluated recursively
from the highest order down. Sums over a context are integers (counts of
counts; probabilities in units of 2^-52), so they don't depend on the order
in which slices arrive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import packed
from evalspark.llm.common import hash_words, mix64, tokenise

ORDER = 2
MAX_DISCOUNTED = 5
SLICE = 8 << 20
END, START = b"", np.uint64(0x5851F42D4C957F2D)  # the end token is hashed as the empty word: no word is empty
STEP = np.uint64(0x9E3779B97F4A7C15)
UNIT = float(1 << 52)


def is_held_out(doc_id: int | None, mod: int = 5, rest: int = 1) -> bool:
    """crc32 of the id's decimal text modulo ``mod`` is ``rest`` (null: not)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


@dataclass(frozen=True)
class Stats:
    """Corpus figures: training tokens, types, and discounts d[k][r] of order k for counts 0 to 6 (6: more)."""

    tokens: int
    types: int
    discounts: tuple[tuple[float, ...], ...]
    unknown: float


def good_turing(counts: list[int]) -> list[float]:
    """Discounts for r = 0..6 from the numbers of n-grams seen 1..6 times (Katz's form, k = 5).

    Where the counts of counts don't give a value between 0 and 1, r - 1/2 of
    r is kept.
    """
    k, n = MAX_DISCOUNTED, [0, *counts]
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, k + 1):
        good = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out.append(good if 0 < good < 1 else (r - 0.5) / r)
    return [*out, 1.0]


class _Grams:
    """Tokens of a slice and the keys of the n-grams that end at each of them."""

    def __init__(self, row: dict, order: int) -> None:
        t = tokenise(pa.array(packed.slice_texts(row), pa.binary()).cast(pa.string()), lower=True)
        n = np.diff(t.offsets) + 1
        self.n_tokens, self.ids = n, row["ids"]
        last = np.cumsum(n) - 1
        size = int(n.sum())
        self.word = np.full(size, hash_words(pa.array([END], pa.binary()))[0], np.uint64)
        body = np.ones(size, bool)
        body[last] = False
        if len(t.codes):
            self.word[body] = hash_words(t.words)[t.codes]
        self.doc = np.repeat(np.arange(len(n)), n)
        first = last - n + 1
        self.train = np.repeat(np.array([not is_held_out(i) for i in row["ids"]], bool), n)
        self.context = [np.zeros(size, np.uint64)]  # of order 1: empty
        self.gram, begin = [], START
        for k in range(1, order + 1):
            self.gram.append(self._key(mix64(self.context[-1] * STEP + self.word), k))
            begin = mix64(np.array([begin + np.uint64(k)]))[0]
            c = np.empty(size, np.uint64)
            c[1:] = self.gram[-1][:-1]
            c[first] = begin
            self.context.append(c)
        self.order = order

    @staticmethod
    def _key(h: np.ndarray, k: int) -> np.ndarray:
        return (h & ~np.uint64(7)) | np.uint64(k)  # the order is in the key

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct n-gram keys of all orders, and their training counts here."""
        keys, at = np.unique(np.concatenate(self.gram), return_inverse=True)
        self.keys, self.at = keys, at.reshape(self.order, -1)
        return keys, np.bincount(at, np.tile(self.train, self.order), minlength=len(keys)).astype(np.int64)

    def probabilities(self, row: dict, stats: Stats, upto: int) -> list[np.ndarray]:
        """P_k of every token for k = 1..upto, from the replies in ``row``."""
        if not hasattr(self, "at"):
            self.counted()
        count, self.own = packed.received(row, "counts", 2)
        self.count = [count[a] if len(count) else np.zeros(0, np.int64) for a in self.at]
        c = self.count[0]
        d = np.array(stats.discounts[0])
        known = d[np.minimum(c, MAX_DISCOUNTED + 1)] * c / max(1, stats.tokens)
        p = [np.where(c > 0, known, stats.unknown)]
        for k in range(2, upto + 1):
            keys, at = np.unique(self.context[k - 1], return_inverse=True)
            alpha, total = packed.received(row, f"context{k}", 2)
            alpha, total, c = alpha.view(np.float64)[at], total[at], self.count[k - 1]
            d = np.array(stats.discounts[k - 1])
            seen = d[np.minimum(c, MAX_DISCOUNTED + 1)] * c / np.maximum(total, 1)
            p.append(np.where(c > 0, seen, np.where(total > 0, alpha, 1.0) * p[-1]))
        return p


def _send_counts(order: int, ranges: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            keys, n = _Grams(row, order).counted()
            yield packed.send(row["slice"], keys, [n], ranges)

    return run


def _sum_counts(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Corpus count of each entry; the first entry of a key also gets its order (others 0)."""
    order, starts, group = packed.grouped(keys)
    own = np.zeros(len(keys), np.int64)
    own[order[starts]] = (keys[order[starts]] & np.uint64(7)).astype(np.int64)
    return [np.add.reduceat(values[0][order], starts)[group], own]


def _histogram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, r, n, total): per order, keys seen r times (6: more often) and their summed counts."""
    for batch in batches:
        for out in batch.column("out").to_pylist():
            count, own = (packed.unsqueeze(x) for x in out)
            r = np.minimum(count, MAX_DISCOUNTED + 1)
            code = (own * 8 + r)[(own > 0) & (count > 0)]
            n = np.bincount(code)
            total = np.bincount(code, count[(own > 0) & (count > 0)])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at // 8), pa.array(at % 8), pa.array(n[at]), pa.array(total[at].astype(np.int64))],
                                             ["k", "r", "n", "total"])


def _send_contexts(order: int, k: int, stats: Stats, ranges: int):
    """Per context of order k: how many of its n-grams were seen 1..5 times, total count, sum of P_{k-1}."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in packed.rows_of(batches):
            g = _Grams(row, order)
            lower = g.probabilities(row, stats, k - 1)[-1]
            keys, context = np.unique(g.context[k - 1], return_inverse=True)
            _, where = np.unique(g.at[k - 1], return_index=True)  # one token of every n-gram
            where = where[(g.own[g.at[k - 1][where]] > 0) & (g.count[k - 1][where] > 0)]
            c, count = context[where], g.count[k - 1][where]
            values = [np.bincount(c[count == r], minlength=len(keys)).astype(np.int64) for r in range(1, MAX_DISCOUNTED + 1)]
            total, mass = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(total, c, count)
            np.add.at(mass, c, np.rint(lower[where] * UNIT).astype(np.int64))
            yield packed.send(row["slice"], keys, [*values, total, mass], ranges)

    return run


def _normalise(discounts: tuple[float, ...]):
    def run(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        order, starts, group = packed.grouped(keys)
        *seen, total, mass = (np.add.reduceat(v[order], starts) for v in values)
        left = sum(n * r * (1 - discounts[r]) for r, n in enumerate(seen, 1))
        size = np.where(left > 0, total, total + 1)  # no discounted count: one more keeps some mass
        alpha = np.where(left > 0, left, 1.0) / np.maximum(size, 1) / np.maximum(1 - mass / UNIT, 1e-12)
        return [alpha.astype(np.float64).view(np.int64)[group], np.where(total > 0, size, 0)[group]]

    return run


def _corpus_stats(reply: DataFrame, order: int) -> Stats:
    rows = (reply.mapInArrow(_histogram, "k long, r long, n long, total long").groupBy("k", "r")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())  # 6 rows per order
    n = {(r["k"], r["r"]): r["n"] for r in rows}
    tokens = sum(r["total"] for r in rows if r["k"] == 1)
    types = sum(r["n"] for r in rows if r["k"] == 1)
    discounts = [good_turing([n.get((k, r), 0) for r in range(1, MAX_DISCOUNTED + 2)]) for k in range(1, order + 1)]
    lost = sum(n.get((1, r), 0) * r * (1 - discounts[0][r]) for r in range(1, MAX_DISCOUNTED + 1))
    if lost <= 0 or not tokens:  # no rare word: the unknown one counts as one more token
        discounts[0] = [x * tokens / (tokens + 1) for x in discounts[0]]
        lost = 1.0 if not tokens else tokens / (tokens + 1)
    return Stats(tokens, types, tuple(map(tuple, discounts)), lost / max(1, tokens))


def score(docs: DataFrame, order: int = ORDER, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    A-Z are lower-cased; tokens are runs of other characters than space and
    \\t..\\r, then one end token (so an empty or null text has one). The model
    learns from rows whose crc32(doc_id as text) mod 5 isn't 1 (a null doc_id
    trains) and scores all rows: log10 probability of the text, end
    included. base_score is the add-half unigram score over the same tokens,
    n_known the number of tokens seen in training. Repeated rows count as
    often as they come. An empty table gives an empty result; other columns
    aren't read. Keys are 61-bit hashes of token sequences.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be between 1 and 7")
    corpus = packed.cut_slices(docs, slice_bytes)
    ranges = packed.ranges_for(corpus, 0.13 * order)
    counts = packed.totals(corpus.slices.mapInArrow(_send_counts(order, ranges), packed.ROW_KIND), _sum_counts)
    stats = _corpus_stats(counts, order)
    corpus = packed.with_reply(corpus, counts, "counts")
    for k in range(2, order + 1):
        sums = corpus.slices.mapInArrow(_send_contexts(order, k, stats, max(packed.LEAST_RANGES, ranges // 4)), packed.ROW_KIND)
        corpus = packed.with_reply(corpus, packed.totals(sums, _normalise(stats.discounts[k - 1])), f"context{k}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_total = stats.tokens + 0.5 * (stats.types + 1)
        for row in packed.rows_of(batches):
            g = _Grams(row, order)
            p = g.probabilities(row, stats, order)[-1]
            c = g.count[0]
            n = len(g.n_tokens)
            held = [is_held_out(i) for i in g.ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(g.n_tokens),
                 pa.array(np.bincount(g.doc[c > 0], minlength=n).astype(np.int64)), pa.array(np.full(n, stats.tokens, np.int64)),
                 pa.array(np.bincount(g.doc, np.log10((c + 0.5) / base_total), minlength=n)),
                 pa.array(np.bincount(g.doc, np.log10(p), minlength=n))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return corpus.slices.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
