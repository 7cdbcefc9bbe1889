"""Toxicity by multiple-instance learning: sentence scores, noisy-or, document labels.

A document is a bag of sentences. Sentence s has p(s) = sigmoid(b + sum of
the weights of its words' features); the document is toxic with
P = 1 - product of (1 - p(s)). Only documents carry labels: the gradient of
the log-likelihood through the noisy-or hands each sentence its part, so the
fitted sentence scores locate the offending sentences.

Features of a word are the word and its prefixes (inflected forms share
them). Their document counts by label are taken on the executors, and the
few thousand features that favour label 1 most enter the fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import crc_mod, text_slices, tokenise

PUNCTUATION = ".,;:!?…\"'()[]{}<>|*#%&$@~_-–—«»„“”‘’¡¿"
PREFIXES = (3, 4, 5, 6, 7)
SAMPLE_ROWS = 20_000    # labelled documents that the model is fitted on, at most
MAX_FEATURES = 4096
MIN_EVIDENCE = 30.0     # likelihood ratio statistic of a feature against the label, at least
SHADOW = 3.0            # a longer feature must beat the odds of its prefixes by this factor
OFFENDING = 0.5         # sentence probability from which a sentence is reported


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]


def _features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)] if word else []


class _Bags:
    """Sentences of a slice: a sentence ends after a word that closes with . ! ? or …, or with its document."""

    def __init__(self, texts: pa.Array) -> None:
        t = tokenise(texts)
        raw = t.words.to_pylist()
        self.codes, self.offsets = t.codes, t.offsets
        self.words = [w.strip(PUNCTUATION).lower() for w in raw]
        closes = np.fromiter((w.rstrip("\"')]»”’")[-1:] in (".", "!", "?", "…") for w in raw), bool, len(raw))
        n = len(t.codes)
        starts = np.zeros(n, bool)
        if n:
            starts[1:] = closes[t.codes[:-1]]
            starts[t.offsets[:-1][t.offsets[:-1] < n]] = True
        self.starts = np.flatnonzero(starts)
        self.ends = np.append(self.starts[1:], n) if n else self.starts
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1


def _without_shadows(odds: dict[str, float]) -> list[str]:
    """Leave out a feature when a shorter prefix of the same word favours label 1 about as much."""
    def shorter(f: str) -> list[str]:
        return ["^" + f[1:1 + n] for n in PREFIXES if 1 + n < len(f) or f[0] == "=" and 1 + n == len(f)]

    return [f for f, x in odds.items() if all(x > SHADOW * odds[g] for g in shorter(f) if g in odds)]


def _label_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, pos, neg): documents of a slice with the feature, by label."""
    for part in text_slices(batches):
        bags, toxic = _Bags(part.column("text")), part.column("toxic").to_numpy(zero_copy_only=False)
        names = [_features(w) for w in bags.words]
        count = {0: Counter(), 1: Counter()}
        for i, y in enumerate(toxic):
            seen = np.unique(bags.codes[bags.offsets[i]:bags.offsets[i + 1]])
            count[int(y)].update({f for c in seen for f in names[c]})
        both = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.string()), pa.array([count[1][f] for f in both], pa.int64()),
             pa.array([count[0][f] for f in both], pa.int64())], ["feature", "pos", "neg"])


def _rows_of(features: list[str]):
    ids = {f: i for i, f in enumerate(features)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            bags, toxic = _Bags(part.column("text")), part.column("toxic").to_pylist()
            known = [[ids[f] for f in _features(w) if f in ids] for w in bags.words]
            has = np.fromiter((bool(k) for k in known), bool, len(known))
            sentences = [[] for _ in toxic]
            n = np.bincount(bags.doc, minlength=len(toxic))
            for s in np.flatnonzero(np.add.reduceat(has[bags.codes], bags.starts) if len(bags.starts) else []):
                codes = bags.codes[bags.starts[s]:bags.ends[s]]
                sentences[bags.doc[s]].append([f for c in codes[has[codes]] for f in known[c]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(n, pa.int64()), pa.array(sentences, pa.list_(pa.list_(pa.int32())))],
                ["toxic", "n", "active"])

    return run


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _descend(toxic, n, active, n_features: int, rounds: int = 600, rate: float = 0.2, shrink: float = 0.002):
    """Adam on the noisy-or log-likelihood; sentences without features only add the bias."""
    doc_of = np.repeat(np.arange(len(active)), [len(a) for a in active])
    flat = [s for a in active for s in a]
    sent = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    feat = np.fromiter((f for s in flat for f in s), np.int64, len(sent))
    plain = n - np.bincount(doc_of, minlength=len(n))
    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sent, theta[feat], minlength=len(flat))
        clean = -(plain * _softplus(theta[-1]) + np.bincount(doc_of, _softplus(z), minlength=len(n)))
        p = np.maximum(-np.expm1(clean), 1e-12)
        pull = np.where(toxic == 1, -np.exp(clean) / p, 1.0)
        gz = pull[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feat, gz[sent], minlength=n_features),
                         gz.sum() + (pull * plain).sum() / (1 + np.exp(-theta[-1]))) / len(n)
        grad[:-1] += shrink / len(n) * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return theta


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
        max_features: int = MAX_FEATURES) -> Model | None:
    """Fit on at most ``sample_rows`` labelled documents (lowest hash of doc_id).

    Rows of ``labels`` without doc_id or label are passed over; a doc_id with
    several labels counts as toxic if one of them says so. Returns None if
    either class is missing among the labelled documents.
    """
    marked = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").select("text", "toxic")
    by_label = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = by_label.get(1, 0), by_label.get(0, 0)
    if not pos or not neg:
        return None
    counts = (train.mapInArrow(_label_counts, "feature string, pos long, neg long").groupBy("feature")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    both = F.col("pos") + F.col("neg")

    def part(n, share):  # n log(n / expected), 0 for none
        return F.when(n > 0, n * F.log(n / (both * share))).otherwise(0.0)

    evidence = 2 * (part(F.col("pos"), pos / (pos + neg)) + part(F.col("neg"), neg / (pos + neg)))
    odds = (F.col("pos") + 0.5) / (F.col("neg") + 0.5)
    best = (counts.filter((F.col("pos") * neg > F.col("neg") * pos) & (evidence >= MIN_EVIDENCE))
            .orderBy(evidence.desc(), "feature").limit(max_features).select("feature", odds.alias("odds")))
    features = _without_shadows({r["feature"]: r["odds"] for r in best.collect()})
    rows = train.mapInArrow(_rows_of(features), "toxic int, n long, active array<array<int>>").toArrow()
    theta = _descend(rows.column("toxic").to_numpy(), rows.column("n").to_numpy(),
                     rows.column("active").to_pylist(), len(features))
    return Model(float(theta[-1]), {f: float(w) for f, w in zip(features, theta) if abs(w) > 1e-6})


def _scores(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Noisy-or score of every text, and its offending sentences."""
    n = len(texts)
    scores, spans = np.zeros(n), [[] for _ in range(n)]
    bags = _Bags(texts)
    if model and len(bags.starts):
        w = model.weights
        own = np.fromiter((sum(w.get(f, 0.0) for f in _features(x)) for x in bags.words), float, len(bags.words))
        z = model.bias + np.add.reduceat(own[bags.codes], bags.starts)
        scores = np.clip(-np.expm1(-np.bincount(bags.doc, _softplus(z), minlength=n)), 0.0, 1.0)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for s in np.flatnonzero(p >= OFFENDING):
            first = bags.offsets[bags.doc[s]]
            spans[bags.doc[s]].append({"start": int(bags.starts[s] - first), "end": int(bags.ends[s] - first), "score": float(p[s])})
    return scores, spans


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, offending) of every row of ``docs`` (doc_id, text).

    ``offending`` has the sentences of probability 0.5 or more, as word
    ranges: start, end (exclusive), score. An empty or null text has no
    sentence: score 0, predicted 0. Without a model every score is 0. One
    row per input row, repeated rows included; other columns are not read.
    """
    kind = "array<struct<start:int,end:int,score:double>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            scores, spans = _scores(part.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                ["doc_id", "score", "predicted", "offending"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, f"doc_id long, score double, predicted int, offending {kind}"))


def clean(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns."""
    row = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            scores, _ = _scores(part.column("text"), model)
            yield part.select(["row"]).filter(pa.array(scores < threshold))

    return row.mapInArrow(run, row.select("row").schema).select("row.*")


def train_labels(labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from: crc32(doc_id as text) mod 4 is not 2."""
    return labels.filter(crc_mod(F.col("doc_id"), 4) != 2)
