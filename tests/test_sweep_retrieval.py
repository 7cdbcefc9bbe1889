"""Sweeps, answer levers and retrieval."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import extras, retrieval, sweep, term_index


def test_grid_and_labels(spark):
    rows = sweep.with_cells(spark.range(1), "0.1, 0.8,", "0.5,1.0", "0,25").collect()
    assert {(r.cell, r.temperature, r.top_p, r.top_k) for r in rows} >= {("sweep_t0.1_p1_k25", 0.1, 1.0, 25), ("sweep_t0.8_p0.5_k0", 0.8, 0.5, 0)}
    assert len({r.cell for r in rows}) == len(rows) == 8
    with pytest.raises(sweep.SweepError):
        sweep.check_task("hellaswag")
    sweep.check_task("hellaswag", force=True)
    sweep.check_task("custom_qa")


def test_labels_print_numbers_like_g(spark):
    values = [0.0, 1.0, 0.3, 0.00001, 0.0001, 0.1234567, 123456.0, 1234567.0, 999999.5, 1e-7, 2.5e20, 0.1 + 0.2, 100.0, -0.5, 0.99999949, 9.9999995e-5, 1e100]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sweep._short(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in rows} == {v: f"{v:g}" for v in values}


def test_expand_cells(spark):
    items = spark.range(3).select(F.col("id").alias("i"))
    x = sweep.with_cells(items, "0.0,0.3", "1.0", "0")
    assert x.count() == 6 and set(x.columns) >= {"cell", "temperature", "top_p", "top_k"}


def test_majority_vote_tie_goes_to_first_seen(spark):
    s = spark.createDataFrame([("q", 0, "b"), ("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("r", 0, "z")],
                              "ind string, sample int, answer string")
    out = {r["ind"]: r for r in extras.majority_vote(s).collect()}
    assert out["q"]["answer"] == "b" and out["q"]["votes"] == 2 and out["r"]["answer"] == "z"


def test_confidence(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([10.0, 0.0, 0.0],)], "s array<double>")
    rows = df.select(*extras.confidence("s")).collect()
    assert rows[0]["p_max"] == pytest.approx(0.5) and rows[0]["entropy"] == pytest.approx(np.log(2))
    assert rows[1]["margin"] > 0.99


def test_topk_cosine_brute_force(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(30, 8))
    p = rng.normal(size=(50, 8))
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, v array<double>")
    pdf = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(p)], "pid long, v array<double>")
    got = retrieval.topk_cosine(qdf, pdf, 3, "qid", "pid", "v").collect()
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    pn = p / np.linalg.norm(p, axis=1, keepdims=True)
    sims = qn @ pn.T
    for r in got:
        best = np.argsort(-sims[r["qid"]], kind="stable")[r["rank"] - 1]
        assert r["pid"] == 100 + best
    assert len(got) == 90


def top_by_hand(q, p, k, exclude_self):
    """All pairs in numpy: rows (qid, rank, pid, score), rounded scores first, then lower pool ids."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    out = []
    for i, v in q:
        if not ok(v):
            continue
        scores = sorted((-round(float(unit(v) @ unit(w)), 9), j) for j, w in p if ok(w) and len(w) == len(v) and not (exclude_self and i == j))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return {(i, r): (j, pytest.approx(s, abs=1e-8)) for i, r, j, s in out}


def vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(i, (centres[i % 8] + rng.normal(size=dim) * 0.2).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]                                   # copies
    return rows + [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [None] + rows[0][1][1:]), (2004, [float("nan")] * dim),
                   (2005, [1.0, 2.0]), (2006, [2.0, 1.0]), (2007, [0.0] * dim), (2008, [-x for x in rows[0][1]])]


@pytest.mark.parametrize("cell_rows,chunk_rows,exclude_self,k", [(4096, 20_000, True, 5), (10, 7, True, 5), (10, 7, False, 3), (3, 50, True, 400)])
def test_cosine_cells_equal_all_pairs(spark, cell_rows, chunk_rows, exclude_self, k):
    rows = vectors(2, 160)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = retrieval.topk_cosine(df, df.withColumnRenamed("id", "pid"), k, "id", "pid", "v", exclude_self, cell_rows, chunk_rows).collect()
    assert len({(r.id, r.rank) for r in got}) == len(got)
    assert {(r.id, r.rank): (r.pid, r.score) for r in got} == top_by_hand(rows, rows, k, exclude_self)


def test_cells_leave_most_pairs_out(spark):
    df = spark.createDataFrame([r for r in vectors(4, 400) if r[0] < 400], "id long, v array<double>")
    index = retrieval.CosineIndex(df.withColumnRenamed("id", "pid"), 5, "pid", "v", cell_rows=20)
    assert 0 < index.share_scored(df, "id", "v", True) < 0.5


def test_cosine_query_of_string_ids_and_empty_pool(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "q string, v array<float>")
    p = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.1])], "p long, v array<float>")
    assert [tuple(r)[:3] for r in retrieval.topk_cosine(q, p, 1, "q", "p", "v").collect()] == [("a", 1, 2)]
    assert retrieval.topk_cosine(q, p.limit(0), 1, "q", "p", "v").count() == 0
    assert retrieval.topk_cosine(q, p, 0, "q", "p", "v").count() == 0


def tfidf_by_hand(queries, pool, k, features):
    terms = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\w{2,}", (t or "").lower()))
    tf = {i: Counter(terms(t)) for i, t in pool}
    total, df = Counter(), Counter()
    for c in tf.values():
        total.update(c)
        df.update(c.keys())
    vocab = {t: np.log((1 + len(pool)) / (1 + df[t])) + 1 for t in sorted(total, key=lambda t: (-total[t], t))[:features]}

    def unit(c):
        w = {t: n * vocab[t] for t, n in c.items() if t in vocab}
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vecs = {i: unit(c) for i, c in tf.items()}
    out = {}
    for i, t in queries:
        q = unit(Counter(terms(t)))
        scores = sorted((-round(sum(x * v.get(t, 0) for t, x in q.items()), 9), j) for j, v in vecs.items())
        out |= {(i, r): (j, pytest.approx(-s, abs=1e-8)) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("k,features,seeds", [(5, 8192, 4), (5, None, 1), (3, 12, 2), (70, None, 1)])
def test_tfidf_index_equals_all_pairs(spark, k, features, seeds):
    rng = np.random.default_rng(6)
    words = ["the", "of"] * 6 + [f"w{i}" for i in range(25)] + ["rare", "x"]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 25)))
    pool = [(100 + i, text()) for i in range(50)] + [(200, None), (201, ""), (202, "the of"), (203, "the of")]
    queries = [(i, text()) for i in range(40)] + [(90, None), (91, "unseen words"), (92, "the"), (93, "rare rare the")]
    q = spark.createDataFrame(queries, "qid long, text string")
    p = spark.createDataFrame(pool, "pool_id long, ctx string")
    got = retrieval.tfidf_topk(q, p, k, "qid", "text", "pool_id", "ctx", features, seeds).collect()
    assert len({(r.qid, r.rank) for r in got}) == len(got)
    assert {(r.qid, r.rank): (r.pool_id, r.score) for r in got} == tfidf_by_hand(queries, pool, k, features)


def test_tfidf_scores_few_rows_under_a_weak_floor(spark):
    """One seed term that fewer than k rows have gives no floor; the partial scores over all terms do."""
    led = [(7, 1.0, 1.7), (0, 0.5, 0.7), (1, 0.2, 0.2)]
    listed = spark.createDataFrame([(1, led)], "qid long, led array<struct<idx: bigint, w: double, onward: double>>")
    rows = [(7, 3, 0.7)] + [(0, i, i / 100) for i in range(40)] + [(1, i, 0.5) for i in range(40)]
    postings = spark.createDataFrame(rows, "idx long, pid long, pw double")
    got = sorted(term_index._reach(listed, postings, 3, 1).collect(), key=lambda r: r.place)
    assert [(r.qid, r.pid) for r in got] == [(1, 3), (1, 39), (1, 38)]


def test_tfidf_keeps_rows_whose_left_out_terms_decide(spark):
    """Rows within reach of the k-th partial score stay, whatever the terms left out add."""
    led = [(7, 0.9, 0.96), (8, 0.3, 0.06)]
    listed = spark.createDataFrame([("a", led)], "qid string, led array<struct<idx: bigint, w: double, onward: double>>")
    postings = spark.createDataFrame([(7, 1, 0.9), (7, 2, 0.88), (7, 3, 0.5), (8, 2, 0.2), (8, 3, 0.2)], "idx long, pid long, pw double")
    assert {r.pid for r in term_index._reach(listed, postings, 1, 1).collect()} == {1, 2}


def test_tfidf_tokens_are_found_once_per_text(spark):
    """The planner's filter on an exploded array's size would repeat the regex below the projection of the tokens."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "two words"), (2, None), (3, "")], "qid long, text string")
    out = term_index._exploded(df, F.col("qid"), F.col("text"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.qid, r.term or "") for r in out.collect()) == [(1, "two"), (1, "two words"), (1, "words"), (2, ""), (3, "")]


def test_tfidf_prefers_shared_words_and_fills_k(spark):
    pool = spark.createDataFrame([(1, "A chef slices onions in the kitchen"), (2, "A runner ties shoes"),
                                  (3, "A scientist writes equations")], "pool_id long, ctx string")
    q = spark.createDataFrame([(0, "The chef chops onions"), (1, "zzz qqq")], "qid long, text string")
    out = retrieval.tfidf_topk(q, pool, 2, "qid", "text", "pool_id", "ctx").orderBy("qid", "rank").collect()
    assert out[0]["pool_id"] == 1 and out[0]["score"] > 0
    # No shared term: zero scores, filled in pool order.
    assert [(r["pool_id"], r["score"]) for r in out if r["qid"] == 1] == [(1, 0.0), (2, 0.0)]


def test_tfidf_empty_pool_and_k0(spark):
    pool = spark.createDataFrame([], "pool_id long, ctx string")
    q = spark.createDataFrame([(0, "x y")], "qid long, text string")
    assert retrieval.tfidf_topk(q, pool, 2, "qid", "text", "pool_id", "ctx").count() == 0


def test_topk_capped_at_pool_size(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, v array<double>")
    p = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0])], "pid long, v array<double>")
    out = retrieval.topk_cosine(q, p, 5, "qid", "pid", "v").orderBy("rank").collect()
    assert [(r["rank"], r["pid"]) for r in out] == [(1, 10), (2, 11)]


def test_tfidf_vocabulary_cap(spark):
    pool = spark.createDataFrame([(1, "aa aa bb cc"), (2, "aa bb dd")], "pool_id long, ctx string")
    vocab, vec, n = retrieval.tfidf_fit(pool, "pool_id", "ctx", max_features=3)
    terms = sorted(r["term"] for r in vocab.collect())
    # pool term frequencies: aa=3, bb=2, "aa bb"=2 (a bigram of both texts); the others occur once
    assert terms == ["aa", "aa bb", "bb"] and n == 2
    capped = sorted(r["term"] for r in retrieval.tfidf_fit(pool, "pool_id", "ctx", max_features=4)[0].collect())
    assert capped == ["aa", "aa aa", "aa bb", "bb"]  # the 1-count tie is broken by term order


def test_risk_coverage_against_plain_python(spark):
    rng = np.random.default_rng(8)
    rows = [(float(c), bool(rng.random() < c)) for c in np.r_[rng.random(300).round(2), [1.0] * 40, [0.0]]] + [(None, True), (float("nan"), True), (0.5, None)]
    df = spark.createDataFrame(rows, "p_max double, correct boolean").repartition(7)
    good = [r for r in rows if r[0] is not None and r[0] == r[0] and r[1] is not None]
    got = {r.threshold: r for r in extras.risk_coverage(df).collect()}
    assert set(got) == {c for c, _ in good}
    area = 0.0
    for t in got:
        kept = [y for c, y in good if c >= t]
        assert (got[t].kept, got[t].coverage, got[t].accuracy) == (len(kept), pytest.approx(len(kept) / len(good)), pytest.approx(np.mean(kept)))
        area += sum(c == t for c, _ in good) / len(good) * (1 - np.mean(kept))
    assert all(r.area == pytest.approx(area) for r in got.values())
    assert extras.risk_coverage(df.limit(0)).count() == 0


def test_cosine_vectors_travel_once_per_region(spark):
    """Vectors without any structure: every query visits nearly every cell, yet travels to each region at most once."""
    from evalspark.operators import cosine_index

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = retrieval.CosineIndex(df.withColumnRenamed("id", "pid"), 5, "pid", "v", cell_rows=8)
    queries = df.select(F.col("id").alias("qid"), retrieval.l2_normalize("v").alias("v"), F.lit(16).alias("dim"), F.lit(-2.0).alias("floor"))
    sent = cosine_index._visits(queries, index.cells, 5, False, 3)
    assert len(index.cells.size) > 40 and sent.count() == 600 * 3 == sent.select("qid", "region").distinct().count()
    got = index.top(df, "id", "v", True).collect()
    assert {(r.qid, r.rank): (r.pid, r.score) for r in got} == top_by_hand(rows, rows, 5, True)


def test_cosine_cell_larger_than_a_region_is_spread(spark):
    from evalspark.operators import cosine_index

    cells = cosine_index._Cells({2: np.eye(2)}, {2: 0}, np.array([10, 85, 5]), np.ones(3), np.ones(3))
    low, high = cells.spans(4)
    assert low.tolist() == [0, 0, 3] and high.tolist() == [0, 3, 3]
