"""Exact top-k by TF-IDF cosine over a weighted inverted index.

The pool becomes postings (term, pool id, weight), and the vocabulary keeps
the largest weight of each term's postings: query weight times that is the
most a term can add to any score, its impact. Max-score pruning in two rounds
of Spark joins:

1. each query's terms of highest impact find pool rows; partial scores are
   lower bounds, so the k-th of them is a floor under the final k-th score;
2. terms are taken by falling impact until the impacts of the rest add up to
   less than ``NEED`` of the floor: a row that has none of them can't be returned. The
   k-th partial score over these terms is a floor too, and mostly a higher
   one. Rows whose partial score plus the rest can reach it are scored exactly.

Nothing is dense: a vector is the terms it has. Scores are compared after
rounding to 1e-9; ties go to the lower pool id, and rows that share no term
fill up to k in pool order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.indexing import broadcast_if_small, with_row_index
from evalspark.operators.cosine_index import SCORE_DIGITS

# TF-IDF settings of the retrieval fallback (vocabulary size,
# word pattern of two or more letters / digits / underscores, 1-2 word n-grams).
TFIDF_MAX_FEATURES = 8192
TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"

SEEDS = 4                # terms of highest impact that find the floor
CHUNK = 256              # rows scored at once for a query
NEED = 0.25              # share of the floor that the terms left out stay below: the less they can add, the fewer rows are scored
SLACK = 1e-8


def _tokens(text: Column) -> Column:
    """Lower-cased word tokens (two or more letters, digits or underscores)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TFIDF_TOKEN), 0)


def _with_terms(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """``(id, terms)``: tokens plus the bigrams of consecutive tokens.

    Tokens are computed in their own projection first, so the regex runs once
    per text (the bigram expression references the tokens several times).
    """
    t = df.select(id_col, _tokens(text).alias("_t"))
    m = F.greatest(F.size("_t") - 1, F.lit(0))
    bigrams = F.zip_with(F.slice("_t", 1, m), F.slice("_t", 2, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return t.select(t.columns[0], F.concat("_t", bigrams).alias("terms"))


def _exploded(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """(id, term) per occurrence; a text without terms has one null term.

    ``explode`` would make the planner filter on the array's size below the
    projection of the tokens, so the regex would run several times per text.
    """
    terms = _with_terms(df, id_col, text)
    return terms.select(terms.columns[0], F.explode_outer("terms").alias("term"))


def _counts(df: DataFrame, id_col: Column, text: Column) -> DataFrame:
    """(id, term, tf)."""
    terms = _exploded(df, id_col, text)
    key = terms.columns[0]
    return terms.filter(F.col("term").isNotNull()).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _vectors(counts: DataFrame, key: str, vocab: DataFrame) -> DataFrame:
    """(key, vec): unit tf-idf vectors as arrays of (idx, w) by idx; rows without a known term are left out."""
    rows = counts.join(vocab, "term").select(key, "idx", (F.col("tf") * F.col("idf")).alias("w"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return listed.withColumn("norm", norm).select(
        key, F.transform("v", lambda x: F.struct(x["idx"].alias("idx"), (x["w"] / F.col("norm")).alias("w"))).alias("vec"))


def tfidf_fit(pool: DataFrame, pool_id: str, text: str, max_features: int | None = TFIDF_MAX_FEATURES):
    """T9 fit on the pool only: vocabulary (``term, idx, idf``), unit pool vectors (``pid, vec``), pool size.

    Vocabulary = the ``max_features`` terms with the highest pool term
    frequency (ties: term order), all of them if None; ``idf =
    ln((1+n)/(1+df)) + 1``; pool vectors are ``tf·idf`` normalised to unit
    length. Both tables stay distributed.
    """
    tf = _counts(pool, F.col(pool_id).cast("bigint").alias("pid"), F.col(text)).checkpoint()
    n = pool.count()
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if max_features is not None:
        stats = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocab = with_row_index(stats, ["term"], "idx").select("term", "idx", idf.alias("idf")).checkpoint()
    return vocab, _vectors(tf, "pid", broadcast_if_small(vocab)[0]), n


def _flat(col: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Each element's row, and the elements."""
    return np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), col.flatten()


def _numbers(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False)


def _impacts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qid, qvec, led) of rows (qid, v): the unit vector by idx, and its terms by falling impact,
    each with what it and the terms after it can add."""
    for batch in batches:
        row, items = _flat(batch.column("v"))
        idx, w, top = (_numbers(items, x) for x in ("idx", "w", "top"))
        at = np.lexsort((idx, row))
        idx, w, top = idx[at], w[at], top[at]
        w = w / np.sqrt(np.bincount(row, w * w, minlength=batch.num_rows))[row]
        impact = w * top
        led = np.lexsort((idx, -impact, row))
        starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        onward = impact[led]
        for a, b in zip(starts[:-1], starts[1:]):  # per row: one running sum over all rows would lose digits
            onward[a:b] = np.cumsum(onward[a:b][::-1])[::-1]

        def listed(**cols: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in cols.values()], [*cols]))

        yield pa.RecordBatch.from_arrays([batch.column("qid"), listed(idx=idx, w=w), listed(idx=idx[led], w=w[led], onward=onward)], ["qid", "qvec", "led"])


def _dots(k: int):
    """(qid, pid, score) of rows (qid, qvec, rows): products of the terms that both have, of a row's first k rows (and ties)."""
    def dots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = _flat(batch.column("rows"))
            (qrow, qvec), (at, pvec) = _flat(batch.column("qvec")), _flat(rows.field("pvec"))
            qidx, pidx = _numbers(qvec, "idx"), _numbers(pvec, "idx")
            span = int(max(qidx.max(initial=0), pidx.max(initial=0))) + 1
            have, ask = qrow * span + qidx, of[at] * span + pidx   # have rises: vectors are sorted by idx
            place = np.minimum(np.searchsorted(have, ask), max(0, len(have) - 1))
            hit = have[place] == ask if len(have) else np.zeros(len(ask), bool)
            score = np.bincount(at[hit], _numbers(qvec, "w")[place[hit]] * _numbers(pvec, "w")[hit], minlength=len(of))
            order = np.lexsort((-score, of))
            starts = np.searchsorted(of, np.arange(batch.num_rows + 1))
            last = np.minimum(starts[:-1] + k, starts[1:]) - 1      # rows has one at least
            keep = score >= (score[order][last] - SLACK)[of]
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(of[keep])), rows.field("pid").filter(pa.array(keep)), pa.array(score[keep])],
                                             ["qid", "pid", "score"])
    return dots


def _reach(listed: DataFrame, postings: DataFrame, k: int, seeds: int) -> DataFrame:
    """(qid, pid, place) of the rows that can be among a query's first ``k``, by falling partial score.

    ``listed`` is (qid, led) of :func:`_impacts`, ``postings`` (idx, pid, pw).
    """
    def partial(chosen: DataFrame) -> DataFrame:
        # (partitioned by query before its rows multiply: no shuffle of them follows where the postings are broadcast;
        # inline would have the planner compute the arrays once more, to filter on their size)
        return (chosen.repartition("qid").select("qid", F.inline_outer("led")).join(postings, "idx").groupBy("qid", "pid")
                .agg(F.sum(F.col("w") * F.col("pw")).alias("part")))

    order = Window.partitionBy("qid").orderBy(F.desc("part"))
    floors = (partial(listed.select("qid", F.slice("led", 1, seeds).alias("led"))).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
              .groupBy("qid").agg(F.when(F.count("*") >= k, F.min("part")).alias("floor")))
    told = listed.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - SLACK)
    told = told.withColumn("n", F.size(F.filter("led", lambda t: t["onward"] >= F.col("floor") * NEED))).checkpoint()
    more = F.coalesce(F.get("led", F.col("n"))["onward"], F.lit(0.0))
    kth = F.nth_value("part", k).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))  # null before the k-th row
    parts = (partial(told.select("qid", F.slice("led", F.lit(1), F.col("n")).alias("led")))
             .select("qid", "pid", "part", F.row_number().over(order).alias("place"), (kth - SLACK).alias("kth")))
    return (parts.join(told.select("qid", "floor", more.alias("more")), "qid")
            .filter(F.col("part") + F.col("more") >= F.greatest("floor", "kth")).select("qid", "pid", "place"))


def tfidf_topk(queries: DataFrame, pool: DataFrame, k: int, query_id: str, query_text: str, pool_id: str,
               pool_text: str, max_features: int | None = TFIDF_MAX_FEATURES, seeds: int = SEEDS) -> DataFrame:
    """Top-k pool rows per query by TF-IDF cosine (fit on the pool; unseen terms dropped).

    Zero-similarity rows still fill ``k`` in pool order. Returns ``query_id,
    rank, pool_id, score``. Ids are distinct on both sides; a null text has no
    terms; an empty pool or ``k <= 0`` gives no rows.
    """
    ids = queries.select(F.col(query_id).alias("qid"))
    qtype = ids.schema["qid"].dataType.simpleString()
    none = queries.sparkSession.createDataFrame([], f"`{query_id}` {qtype}, rank int, `{pool_id}` bigint, score double")
    if k <= 0:
        return none
    vocab, pvec, n = tfidf_fit(pool, pool_id, pool_text, max_features)
    if not n:
        return none
    pvec = pvec.checkpoint()
    postings = pvec.select("pid", F.inline("vec")).withColumnRenamed("w", "pw").checkpoint()
    tops = postings.groupBy("idx").agg(F.max("pw").alias("top"))
    known, _ = broadcast_if_small(vocab.join(tops, "idx").select("term", "idx", "idf", "top").checkpoint())

    # one row per query: its terms by falling impact, each with what it and the terms after it can add
    # (terms that the pool doesn't have go before they're counted: most bigrams of a text do)
    said = _exploded(queries, F.col(query_id).alias("qid"), F.col(query_text))
    rows = (said.join(known, "term").groupBy("qid", "idx").agg(F.count("*").alias("tf"), F.max("idf").alias("idf"), F.max("top").alias("top"))
            .select("qid", "idx", "top", (F.col("tf") * F.col("idf")).alias("w")))
    vec = "array<struct<idx: bigint, w: double>>"
    listed = (rows.groupBy("qid").agg(F.collect_list(F.struct("idx", "w", "top")).alias("v"))
              .mapInArrow(_impacts, f"qid {qtype}, qvec {vec}, led array<struct<idx: bigint, w: double, onward: double>>").checkpoint())
    # a query's vector goes along once per CHUNK of its rows
    chunk = F.floor((F.col("place") - 1) / CHUNK).alias("chunk")
    reach = _reach(listed.select("qid", "led"), broadcast_if_small(postings)[0], k, seeds)
    found = (reach.join(broadcast_if_small(pvec.withColumnRenamed("vec", "pvec"))[0], "pid").groupBy("qid", chunk)
             .agg(F.collect_list(F.struct("pid", "pvec")).alias("rows")).join(listed.select("qid", "qvec"), "qid")
             .select("qid", "qvec", "rows").mapInArrow(_dots(k), f"qid {qtype}, pid bigint, score double")).checkpoint()

    # queries with fewer than k rows above 0 take the lowest pool ids that they share no term with: of k + k ids, k are left
    enough = (found.filter(F.round("score", SCORE_DIGITS) > 0).groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("qid"))
    lowest = [r["pid"] for r in pool.select(F.col(pool_id).cast("bigint").alias("pid")).orderBy("pid").limit(2 * k).collect()]
    fill = (ids.join(enough, "qid", "left_anti").select("qid", F.explode(F.lit(lowest).cast("array<bigint>")).alias("pid"))
            .join(found, ["qid", "pid"], "left_anti").withColumn("score", F.lit(0.0)))
    best = Window.partitionBy("qid").orderBy(F.desc(F.round("score", SCORE_DIGITS)), F.asc("pid"))
    out = found.unionByName(fill).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select(F.col("qid").alias(query_id), "rank", F.col("pid").alias(pool_id), "score")
