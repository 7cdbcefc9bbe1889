"""Log-prob scoring: tails, greedy check, score modes, prediction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark.functions import logprob as LP
from evalspark.functions.text import truncate_at_stops, word_count
from evalspark.operators import scoring

PAYLOAD = "tokens array<string>, token_logprobs array<double>, top_logprobs array<map<string,double>>"


def _payload(spark):
    """Five positions; the model's first choice differs from the text at position 2 only."""
    steps = [("snow", None, None), ("fell", -1.5, "lay"), ("all", -2.25, "over"), ("night", -0.125, "day"), ("long", -0.375, "through")]
    tops = [None if lp is None else {tok: lp, other: -2.0 if tok == "all" else lp - 3} for tok, lp, other in steps]
    return spark.createDataFrame([([t for t, _, _ in steps], [lp for _, lp, _ in steps], tops)], PAYLOAD)


def test_tail_sum_and_greedy(spark):
    df = _payload(spark)
    r = df.select(LP.loglikelihood("token_logprobs", 2).alias("ll"),
                  LP.is_greedy("tokens", "top_logprobs", 2).alias("g")).first()
    assert r["ll"] == pytest.approx(-0.5) and r["g"] is True
    assert df.select(LP.is_greedy("tokens", "top_logprobs", 3)).first()[0] is False


def test_tail_longer_than_list_takes_all(spark):
    r = _payload(spark).select(LP.loglikelihood("token_logprobs", 10)).first()[0]
    assert r == pytest.approx(-4.25)


def test_not_greedy(spark):
    df = spark.createDataFrame([(["a", "b"], [None, -2.0], [None, {"c": -1.0, "b": -2.0}])], PAYLOAD)
    assert df.select(LP.is_greedy("tokens", "top_logprobs", 1)).first()[0] is False


def test_greedy_tie_first_entry_wins(spark):
    df = spark.createDataFrame([(["a", "b"], [None, -1.0], [None, {"b": -1.0, "c": -1.0}])], PAYLOAD)
    assert df.select(LP.is_greedy("tokens", "top_logprobs", 1)).first()[0] is True


def test_rolling_constant_logprobs(spark):
    # N tokens with -1 each and the echoed first null: sum = -(N-1).
    for n, expected in [(5, -4.0), (2, -1.0), (1, 0.0)]:
        df = spark.createDataFrame([([None] + [-1.0] * (n - 1),)], "lp array<double>")
        assert df.select(LP.rolling_loglikelihood("lp")).first()[0] == pytest.approx(expected)


def test_score_modes_differ_by_their_divisor(spark):
    lps, continuation = [-0.5, -4.5, -2.0, -1.0], " snow fell late"
    df = spark.createDataFrame([(lps, continuation)], "lp array<double>, c string")
    got = df.select(*[LP.score(m, F.col("lp"), F.col("c")).alias(m) for m in LP.SCORING_MODES]).first()
    assert got["sum"] == pytest.approx(sum(lps))
    assert got["length_norm"] == pytest.approx(sum(lps) / len(lps))
    assert got["byte_norm"] == pytest.approx(sum(lps) / len(continuation.encode()))


def test_score_empty_and_unknown(spark):
    df = spark.createDataFrame([([], "anything")], "lp array<double>, c string")
    assert df.select(LP.score("length_norm", F.col("lp"), F.col("c"))).first()[0] == 0.0
    with pytest.raises(ValueError):
        LP.score("bogus", F.col("lp"), F.col("c"))


def test_byte_norm_counts_utf8_bytes(spark):
    df = spark.createDataFrame([([-4.0], " Café")], "lp array<double>, c string")
    assert df.select(LP.score("byte_norm", F.col("lp"), F.col("c"))).first()[0] == pytest.approx(-4.0 / 6)


def test_predict_first_index_on_ties(spark):
    wide = spark.createDataFrame([([-1.0, -0.5, -0.5, -2.0],)], "s array<double>")
    assert wide.select(LP.predict_wide("s")).first()[0] == 1
    long = spark.createDataFrame([("a", 0, -1.0), ("a", 1, -0.5), ("a", 2, -0.5)], "ind string, option int, score double")
    assert scoring.predict_long(long, "score").first()["predicted"] == 1


def test_cont_len_rules(spark):
    df = spark.createDataFrame([(5, 5, 7), (5, 9, 3), (5, 4, 0)], "a int, b int, n int")
    rows = df.select(LP.cont_len_eval("a", "b"), LP.cont_len_ablation("a", "b", "n")).collect()
    assert [tuple(r) for r in rows] == [(0, 1), (4, 3), (0, 1)]


def test_eval_path_zero_length_continuation(spark):
    df = spark.createDataFrame([("i", 0, "ctx here", "   ", ["ctx", "here"], [None, -1.0], [None, None])],
                               "ind string, option int, ctx string, ending string, " + PAYLOAD)
    r = scoring.loglikelihood_eval(df).first()
    assert r["n_cont"] == 0 and r["ll"] == 0.0 and r["is_greedy"] is True


def test_stops_in_list_order(spark):
    df = spark.createDataFrame([("Paris. Yes?\nNo", ["\n", ".", "?"]), ("abc", ["", "b"]), ("abc", None)],
                               "t string, s array<string>")
    assert [r[0] for r in df.select(truncate_at_stops("t", "s")).collect()] == ["Paris", "", "abc"]


def test_word_count(spark):
    df = spark.createDataFrame([("",), ("  a  b\tc\n",), (None,)], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [0, 3, 0]


def test_exact_match_normalisation(spark):
    df = spark.createDataFrame([("  Paris!", "paris"), ("New-York", "new york")], "p string, t string")
    assert [r[0] for r in df.select(scoring.exact_match(F.col("p"), F.col("t"))).collect()] == [True, False]


def test_parse_payload_missing_block(spark):
    df = spark.createDataFrame([('{"choices": [{"text": "x"}]}',),
                                ('{"choices": [{"logprobs": {"tokens": ["a"], "token_logprobs": [null]}}]}',)], "raw string")
    rows = df.select(LP.parse_payload("raw").alias("p")).collect()
    assert rows[0]["p"]["tokens"] == [] and rows[1]["p"]["tokens"] == ["a"]
    assert rows[1]["p"]["top_logprobs"] == []


def test_perplexities(spark):
    import math
    df = spark.createDataFrame([(-10.0, 5, 20)], "ll double, w long, b long")
    r = df.select(*LP.perplexities("ll", "w", "b")).first()
    assert r["word_perplexity"] == pytest.approx(math.exp(2.0))
    assert r["bits_per_byte"] == pytest.approx(10.0 / (20 * math.log(2)))


def test_md5_buckets_equal_hashlib(spark):
    """Arrays of hashes in one call; keys of several MD5 blocks, null counts and empty ones among them."""
    import hashlib

    from evalspark.functions.hashing import md5_bucket, md5_buckets

    keys = ["7:0", "", "x" * 47, "x" * 52, "y" * 200, "é:1", "9:3"]
    rows = [(k, n) for k, n in zip(keys, [1200, 3, 1100, 12, 5, 9000, 0])] + [("z", None)]
    df = spark.createDataFrame(rows, "key string, n int").coalesce(1)
    for salt in ("", ":alt"):
        got = df.select("key", md5_buckets(F.col("key"), F.col("n"), 1000, salt).alias("h")).collect()
        assert {r.key: r.h for r in got} == {
            k: [int(hashlib.md5(f"{k}:{i}{salt}".encode()).hexdigest()[:8], 16) % 1000 for i in range(n or 0)] for k, n in rows}
    one = spark.range(1).select(md5_bucket(F.lit("9:3:0"), 1000).alias("h")).first().h
    assert one == int(hashlib.md5(b"9:3:0").hexdigest()[:8], 16) % 1000


def test_logprob_hashes_are_vector_operations(spark):
    """The payload's hashes aren't made by interpreted string functions, one token at a time."""
    import os

    from evalspark.plans import views as V

    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        plan = V.logprob_payloads(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "md5(" not in plan and "conv(" not in plan


def test_argmax_key_ties_nan_and_nulls(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 2.0, "c": 2.0}), (2, {"a": None, "b": 2.0}), (3, {"a": 1.0, "b": None}),
                                (4, {"a": 1.0, "b": float("nan")}), (5, {"a": -0.0, "b": 0.0})], "id int, m map<string,double>")
    got = {r.id: r.k for r in df.select("id", LP.argmax_key("m").alias("k")).collect()}
    assert got == {1: "b", 2: "a", 3: "a", 4: "b", 5: "a"}
