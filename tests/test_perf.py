"""Request-log analytics against plain Python over generated logs."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark import schemas
from evalspark.functions.joins import join_keys
from evalspark.functions.quantiles import exact_percentiles
from evalspark.operators import perf
from evalspark.sources.readers import parse_gpu_samples, read_requests

LOG = "idx long, prompt_kind string, mode string, wall_s double, ttft_s double, output_tokens int, status string, " \
      "started_at double, ended_at double"
PS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0)


def request_log(seed=11, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start, wall = 5000 + rng.random() * 900, rng.choice([rng.expovariate(0.7), 0.0, None, float("nan")] + [rng.random()] * 6)
        first = rng.choice([None, float("nan"), wall and wall * rng.random(), 3.0])
        rows.append((i, rng.choice("abc"), rng.choice(["batch", "live"]), wall, first, rng.randint(-1, 90),
                     rng.choice(["ok"] * 7 + ["error", "timeout", None]), start, start + (wall if wall and wall == wall else 0.0)))
    return rows


def usable(values):
    return [v for v in values if v is not None and not math.isnan(v)]


def decode_rate(wall, first, tokens):
    if tokens <= 0 or wall is None or wall <= 0:
        return None if wall is None and tokens > 0 else 0.0
    if math.isnan(wall):
        return math.nan
    return tokens / (wall - first) if first is not None and 0 < first < wall else tokens / wall


SHAPES = {
    "even": np.arange(1000.0), "ties": np.repeat([3.0, -1.0, 7.5], [700, 5, 400]), "one value": np.full(900, 2.5), "two": np.array([4.0, 9.0]),
    "spread": np.array([s * 10.0 ** e for e in range(-300, 300, 2) for s in (-1, 1)]), "outlier": np.r_[np.random.default_rng(1).normal(size=2000), 1e300, -1e308],
    "infinite": np.r_[np.linspace(0, 1, 500), np.inf, -np.inf, np.inf], "denormal": np.arange(60) * 5e-324, "close": 1 + np.arange(300) * 2.3e-16,
}


@pytest.mark.parametrize("limit,cells", [(4096, 1024), (40, 64)])
def test_percentiles_of_every_shape(spark, limit, cells):
    shapes = SHAPES
    rows = [(k, float(v)) for k, vs in shapes.items() for v in vs] + [("even", None), ("ties", float("nan")), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: tuple(r)[1:] for r in exact_percentiles(df, ["k"], "x", PS, limit=limit, cells=cells).collect()}
    assert set(got) == {*shapes, None}
    for k, vs in (shapes | {None: np.array([1.0, 2.0])}).items():
        s = np.sort(vs)
        for p, v in zip(PS, got[k]):
            h = p * (len(s) - 1)
            lo, hi = s[math.floor(h)], s[math.ceil(h)]
            want = lo if h == math.floor(h) else lo + (h - math.floor(h)) * (hi - lo)
            assert v == want or v == pytest.approx(want, rel=1e-12), (k, p)


def test_percentiles_of_a_large_group_collect_little(spark):
    n = 300_000
    df = spark.range(n).select((F.pow(F.lit(1.00005), F.col("id") * 7919 % n)).alias("x"))
    got = exact_percentiles(df, [], "x", (0.5, 0.999), limit=50).first()
    assert list(got) == pytest.approx(np.percentile(1.00005 ** np.arange(n), [50, 99.9]).tolist(), rel=1e-9)


def test_percentiles_without_values_are_zero(spark):
    for rows in ([], [(None,), (float("nan"),)]):
        assert list(perf.percentiles(spark.createDataFrame(rows, "x double"), "x").first()) == [0.0, 0.0, 0.0]


def test_tpot_of_every_case(spark):
    cases = list(itertools.product([None, math.nan, -1.0, 0.0, 0.8, 6.0], [None, math.nan, -2.0, 0.0, 0.3, 0.8, 50.0], [-3, 0, 7, 120]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, wall_s double, ttft_s double, output_tokens int")
    for r in df.select("i", perf.tpot().alias("t")).collect():
        want = decode_rate(*cases[r.i])
        assert (r.t is None) == (want is None) and (want is None or r.t == pytest.approx(want, nan_ok=True)), cases[r.i]


def summary_by_hand(rows, keys):
    out = {}
    for group in {keys(r) for r in rows}:
        own = [r for r in rows if keys(r) == group]
        ok = [r for r in own if r[6] == "ok"]
        rates = [x for x in (decode_rate(*r[3:6]) for r in ok) if x is not None and math.isfinite(x)]
        pct = lambda v, p: float(np.percentile(v, p)) if v else 0.0
        window = max((r[8] for r in ok), default=0) - min((r[7] for r in ok), default=0)
        out[group] = dict(n=len(own), ok=len(ok), errors=len(own) - len(ok), error_rate=(len(own) - len(ok)) / len(own),
                          wall_s_p50=pct(usable(r[3] for r in ok), 50), wall_s_p99=pct(usable(r[3] for r in ok), 99), ttft_s_p95=pct(usable(r[4] for r in ok), 95),
                          tpot_mean=float(np.mean(rates)) if rates else 0.0, tpot_p50=pct(rates, 50), throughput_rps=len(ok) / window if window > 0 else None)
    return out


def test_summary_against_plain_python(spark):
    rows = request_log() + [(900, "lonely", "batch", 0.0, None, 4, "ok", 7.0, 7.0), (901, "broken", "live", 1.0, None, 0, "error", 7.0, 8.0)]
    df = spark.createDataFrame(rows, LOG)
    got = {(r.prompt_kind, r["mode"]): r for r in perf.summarise_requests(df).collect()}
    want = summary_by_hand(rows, lambda r: r[1:3])
    assert set(got) == set(want)
    for group, values in want.items():
        assert {c: got[group][c] for c in values} == {c: v if v is None else pytest.approx(v) for c, v in values.items()}
    (whole,) = perf.summarise_requests(df, keys=[]).collect()
    for c, v in summary_by_hand(rows, lambda r: ())[()].items():
        assert whole[c] == pytest.approx(v)


@pytest.mark.parametrize("exact", [True, False])
def test_summary_of_an_empty_log(spark, exact):
    empty = spark.createDataFrame([], LOG)
    assert perf.summarise_requests(empty, exact=exact).count() == 0
    (r,) = perf.summarise_requests(empty, keys=[], exact=exact).collect()
    assert (r.n, r.ok, r.error_rate, r.wall_s_p50, r.throughput_rps) == (0, 0, None, 0.0, None)


def test_approximate_summary_is_within_its_rank_error(spark):
    rows = [r for r in request_log(5, 3000) if r[6] == "ok" and r[3] is not None and not math.isnan(r[3])]
    r = perf.summarise_requests(spark.createDataFrame(rows, LOG), keys=[], exact=False, accuracy=200).first()
    walls = sorted(x[3] for x in rows)
    for p, v in ((0.5, r.wall_s_p50), (0.95, r.wall_s_p95)):
        below, upto = sum(w < v for w in walls), sum(w <= v for w in walls)
        assert below - len(walls) / 200 - 1 <= p * len(walls) <= upto + len(walls) / 200 + 1


def test_box_takes_the_extremes_from_the_values(spark):
    rows = [r for r in request_log(3) if r[3] is None or not math.isnan(r[3])]
    for r in perf.latency_box(spark.createDataFrame(rows, LOG)).collect():
        walls = usable(x[3] for x in rows if x[1] == r.prompt_kind and x[6] == "ok")
        assert (r.n, r.min, r.max) == (len(walls), min(walls), max(walls)) and r.median == pytest.approx(np.median(walls))


def test_a_join_without_keys_is_no_cross_join(spark):
    many, one = spark.range(3), spark.range(1).select(F.lit(7).alias("x"))
    assert join_keys(many, one, []).count() == 3
    with pytest.raises(ValueError, match="one row"):
        join_keys(many, many.toDF("y"), [])


def test_request_csv_coerces_bad_numbers(spark, scratch):
    path = f"{scratch}/log.csv"
    texts = [["7", "story", "90", "64", "live", "1.25", "n/a", "31", "ok", "", "20.5", "21.75"],
             ["8", "story", "90", "64", "live", "-", "0.5", "-", "timeout", "gone", "30", "30"]]
    with open(path, "w") as f:
        f.writelines(",".join(r) + "\n" for r in [list(schemas.REQUEST_COLUMNS), *texts])
    got = {r.idx: r for r in read_requests(spark, path).collect()}
    assert (got[7].wall_s, got[7].ttft_s, got[7].output_tokens) == (1.25, None, 31)
    assert (got[8].wall_s, got[8].ttft_s, got[8].output_tokens) == (None, 0.5, 0)


@pytest.mark.parametrize("bin_s", [0.5, 3.0, 60.0, 1e5])
def test_gpu_join_against_all_pairs(spark, bin_s):
    rng = random.Random(4)
    reqs = [(i, t, t + rng.choice([0.0, rng.random() * 3, rng.random() * 400])) for i, t in enumerate(rng.uniform(-200, 700) for _ in range(60))]
    reqs += [(3, *reqs[3][1:]), (3, 10.0, 90.0), (70, 50.0, 20.0), (71, None, 5.0), (72, 0.0, 60.0), (None, 0.0, 60.0)]
    smps = [(rng.uniform(-250, 1200), rng.choice([None, rng.random() * 100])) for _ in range(300)] + [(60.0, 1.0), (0.0, 2.0), (None, 5.0)]
    got = perf.join_gpu(spark.createDataFrame(reqs, "idx long, started_at double, ended_at double"),
                        spark.createDataFrame(smps, "timestamp double, util_gpu double"), bin_s).collect()
    want = []
    for i, a, b in reqs:
        inside = [u for t, u in smps if t is not None and a is not None and a <= t <= b]
        known = [u for u in inside if u is not None]
        want.append((i, len(inside), pytest.approx(np.mean(known)) if known else None, max(known, default=None)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_a_year_long_request_reads_few_blocks(spark):
    cover = perf._cover(F.col("a"), F.col("b"), 26)
    for a, b in ((0, 31_536_000), (17, 17), (5, 4), (1, 6), (-9, 1000)):
        blocks = spark.createDataFrame([(a, b)], "a long, b long").select(cover.alias("c")).first().c
        assert len(blocks) <= 2 * max(1, (b - a + 1).bit_length())
        if b < 10_000:
            assert sorted(x for k in blocks for x in range(k.node << k.level, (k.node + 1) << k.level)) == list(range(a, b + 1))


STREAM = "request_id long, ts double, seq long, value string"


def chunk(text):
    return 'data: {"choices": [{"text": "%s", "finish_reason": null}]}' % text


def test_chunks_stop_at_the_marker_by_arrival(spark):
    lines = [(4, 2.0, 5, chunk("b c ")), (4, 1.0, 1, chunk("")), (4, 1.5, 2, chunk("a ")), (4, 2.0, 6, "data: [DONE]"), (4, 2.0, 7, chunk("late")),
             (4, 3.0, 8, "data: [DONE]"), (4, 1.7, 3, ": ping"), (5, 9.0, 1, chunk("open"))]
    chunks = perf.parse_sse_lines(spark.createDataFrame(lines, STREAM), arrival="seq")
    got = {r.request_id: r for r in perf.fold_chunks(chunks).collect()}
    assert (got[4].ttft_s, got[4].wall_s, got[4].output_tokens, got[4].n_chunks) == (0.5, 1.0, 3, 3)
    assert {r.request_id: r.text for r in perf.fold_text(chunks, "seq").collect()} == {4: "a b c ", 5: "open"}
    tied = perf.parse_sse_lines(spark.createDataFrame([(1, 1.0, 0, chunk("a")), (1, 2.0, 0, chunk("b")), (1, 2.0, 0, "data: [DONE]")], STREAM))
    assert perf.fold_text(tied).first().text == "ab"


def test_text_of_one_time_follows_arrival(spark):
    rows = [(1, 5.0, s, d) for s, d in ((3, "z"), (1, "m"), (2, None), (0, "q"))]
    assert perf.fold_text(spark.createDataFrame(rows, "request_id long, ts double, seq long, delta string"), "seq").first().text == "qmz"


def test_gpu_lines_keep_what_parses(spark):
    lines = ["3, 41.5, 7, 100, 200, 55, 9.25", "  ", "4, ?, 8, 100, 200, 56, 1e1", "5"]
    got = {r["index"]: r for r in parse_gpu_samples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got[3].util_gpu == 41.5 and got[3].power == 9.25 and got[4].util_gpu is None and got[4].power == 10.0
    assert Counter(got.keys()) == Counter([3, 4, 5]) or Counter(got.keys()) == Counter([3, 4])
