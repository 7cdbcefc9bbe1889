"""Language ID by hyperdimensional profiles.

Every letter has a random vector of -1 and +1, drawn from its code point. An
n-gram binds (multiplies) the permuted (rolled) vectors of its letters, a text
bundles (adds) its n-grams, a language bundles the texts of its training
documents. A document gets the language whose profile has the largest cosine
with its own vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import text_slices

DIM = 1024
ORDER = 3
GAP = 0                  # code of everything that is no letter
SLICE = 1 << 20          # bytes of text in a slice
GRAMS_AT_ONCE = 4096     # n-gram vectors held at a time
DOCS_AT_ONCE = 512


def letter_vector(code: int, dim: int = DIM) -> np.ndarray:
    """The -1/+1 vector of a code point (0: the gap between words)."""
    return np.random.default_rng([7919, code]).integers(0, 2, dim, dtype=np.int8) * 2 - 1


class _Space:
    """Vectors of the letters seen so far in a task, and the n-grams of texts."""

    def __init__(self, dim: int, order: int) -> None:
        self.dim, self.order = dim, order
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.full(0x110000, -1, np.int8)

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased letters with single gaps around words, text of each code, letters per text."""
        lengths, parts = [], []
        for t in texts:
            cp = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            parts.append(cp)
            lengths.append(len(cp) + 1)
            parts.append(np.zeros(1, np.uint32))
        cp = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(len(texts)), lengths)
        new = np.unique(cp[self.is_letter[cp] < 0])
        self.is_letter[new] = [chr(c).isalpha() for c in new]
        letter = self.is_letter[cp] == 1
        out = np.where(letter, cp, GAP)
        keep = letter.copy()
        keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
        keep[:1] = True
        n = np.bincount(doc[letter], minlength=len(texts))
        out, doc = out[keep], doc[keep]
        return out, doc, n

    def grams(self, texts: list[str | None]):
        """Distinct n-grams as rows of code points, and the (text, n-gram) counts."""
        cp, doc, n = self.codes(texts)
        used, small = np.unique(cp, return_inverse=True)
        size = len(cp) - self.order + 1
        if size <= 0:
            return np.zeros((0, self.order), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n
        key = np.zeros(size, np.int64)
        for j in range(self.order):
            key = key * len(used) + small[j:j + size]
        ok = doc[:size] == doc[self.order - 1:]
        key, doc = key[ok], doc[:size][ok]
        space = len(used) ** self.order
        if space <= 1 << 22:
            present = np.bincount(key, minlength=space) > 0
            names = np.flatnonzero(present)
            gram = (np.cumsum(present) - 1)[key]
        else:
            names, gram = np.unique(key, return_inverse=True)
        pair = np.bincount(doc * len(names) + gram, minlength=1) if len(texts) * len(names) <= 1 << 23 else None
        if pair is not None:
            at = np.flatnonzero(pair)
            d, g, c = at // max(1, len(names)), at % max(1, len(names)), pair[at]
        else:
            at, c = np.unique(doc * len(names) + gram, return_counts=True)
            d, g = at // len(names), at % len(names)
        rows = np.zeros((len(names), self.order), np.int64)
        rest = names.copy()
        for j in range(self.order - 1, -1, -1):
            rows[:, j], rest = used[rest % len(used)], rest // len(used)
        return rows, d, g, c, n

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams: letter j is rolled by order - 1 - j places."""
        out = np.ones((len(rows), self.dim), np.float32)
        for j in range(self.order):
            letters, at = np.unique(rows[:, j], return_inverse=True)
            for c in letters:
                if int(c) not in self.letters:
                    self.letters[int(c)] = letter_vector(int(c), self.dim)
            table = np.stack([np.roll(self.letters[int(c)], self.order - 1 - j) for c in letters])
            out *= table[at]
        return out

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bundled vector of every text, and its number of letters."""
        rows, d, g, c, n = self.grams(texts)
        out = np.zeros((len(texts), self.dim), np.float32)
        for a in range(0, len(rows), GRAMS_AT_ONCE):
            part = (g >= a) & (g < a + GRAMS_AT_ONCE)
            counts = np.zeros((len(texts), min(GRAMS_AT_ONCE, len(rows) - a)), np.float32)
            counts[d[part], g[part] - a] = c[part]
            out += counts @ self.vectors(rows[a:a + GRAMS_AT_ONCE])
        return out, n


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, max_bytes=SLICE):
        for a in range(0, part.num_rows, DOCS_AT_ONCE):
            yield part.slice(a, DOCS_AT_ONCE)


def fit(docs: DataFrame, train: Column, dim: int = DIM, order: int = ORDER) -> dict[str, np.ndarray]:
    """Profile of every language among the rows where ``train`` holds and lang isn't null.

    Each task adds up its texts' n-gram counts per language and sends one
    vector per language; sums meet by (language, component). What reaches the
    driver is one vector per language, whatever the corpus size.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = _Space(dim, order), {}
        for part in _groups(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            rows, d, g, c, _ = space.grams(part.column("text").to_pylist())
            names, which = np.unique(langs.astype(str), return_inverse=True)
            for a in range(0, len(rows), GRAMS_AT_ONCE):
                at = (g >= a) & (g < a + GRAMS_AT_ONCE)
                counts = np.zeros((len(names), min(GRAMS_AT_ONCE, len(rows) - a)))
                np.add.at(counts, (which[d[at]], g[at] - a), c[at])
                add = counts @ space.vectors(rows[a:a + GRAMS_AT_ONCE])
                for name, v in zip(names, add):
                    sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))],
                ["lang", "i", "v"])

    learn = docs.filter(train & F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = learn.mapInArrow(run, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    profiles: dict[str, np.ndarray] = {}
    for r in sums.collect():
        profiles.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["v"]
    return profiles


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], dim: int = DIM, order: int = ORDER) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text); score is the cosine, 0 at least.

    A null text or one without a letter gets ``und`` and score 0, as does
    every text if there's no profile. Ties go to the first language by name.
    One row per input row, repeated rows included; other columns aren't read.
    """
    names = sorted(profiles)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _Space(dim, order)
        table = np.array([profiles[x] / max(1e-12, np.linalg.norm(profiles[x])) for x in names], np.float32).reshape(-1, dim)
        for part in _groups(batches):
            x, n = space.bundles(part.column("text").to_pylist())
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            cos = x @ table.T
            known = (n > 0) & bool(names)
            best = cos.argmax(axis=1) if names else np.zeros(len(n), int)
            top = np.where(known, np.clip(cos[np.arange(len(n)), best], 0, 1) if names else 0.0, 0.0)
            pred = [names[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(top.astype(np.float64))],
                                             ["doc_id", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))
