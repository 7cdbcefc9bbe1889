"""Option scoring from log-prob payloads.

``payloads`` have one row per (item, option) with ``ind, option, prompt or
ctx, continuation or ending, tokens, token_logprobs, top_logprobs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions import logprob as LP
from evalspark.functions.text import as_continuation, normalise_answer, word_count


def with_continuation(payloads: DataFrame) -> DataFrame:
    """Add ``continuation`` (T2 of ``ending``) and the full text token counts."""
    cont = as_continuation("ending")
    return payloads.withColumn("continuation", cont).select(
        "*",
        word_count("ctx").alias("n_ctx"),
        word_count(F.concat("ctx", "continuation")).alias("n_full"),
    )


def loglikelihood_eval(payloads: DataFrame) -> DataFrame:
    """L2 (a) + L4 + L5: ``(ll, is_greedy)`` per option; a continuation adding no tokens
    scores ``(0.0, true)`` without looking at the payload."""
    p = with_continuation(payloads)
    n = LP.cont_len_eval("n_ctx", "n_full")
    return p.select(
        "ind", "option", n.alias("n_cont"),
        F.when(n == 0, F.lit(0.0)).otherwise(LP.loglikelihood("token_logprobs", n)).alias("ll"),
        F.when(n == 0, F.lit(True)).otherwise(LP.is_greedy("tokens", "top_logprobs", n)).alias("is_greedy"),
    )


def option_scores(payloads: DataFrame, modes: Sequence[str] = LP.SCORING_MODES) -> DataFrame:
    """L2 (b) + L7: one score column per mode (``score_<mode>``) on the ablation path.

    The log-probs are fetched once per prompt; every mode is a projection of the
    same tail, so adding a mode costs no extra scan or model call.
    """
    p = with_continuation(payloads)
    n = LP.cont_len_ablation("n_ctx", "n_full", F.size("tokens"))
    t = LP.tail("token_logprobs", n)
    return p.select(
        "ind", "option", n.alias("n_cont"),
        *[LP.score(m, t, F.col("continuation")).alias(f"score_{m}") for m in modes],
    )


def predict_long(scores: DataFrame, score_col: str, keys: Sequence[str] = ("ind",)) -> DataFrame:
    """L8 on long rows: per item the option with the max score, lowest option on ties.

    A partial aggregate (``max_by`` over ``(score, -option)``), so it merges map-side.
    """
    best = F.max_by("option", F.struct(F.col(score_col), -F.col("option")))
    return scores.groupBy(*keys).agg(
        best.cast("int").alias("predicted"),
        F.count("*").alias("n_options"),
    )


def mark_correct(pred: DataFrame, labels: DataFrame, keys: Sequence[str] = ("ind",)) -> DataFrame:
    """``correct = predicted == label``."""
    return pred.join(labels, list(keys)).withColumn("correct", F.col("predicted") == F.col("label"))


def exact_match(pred_col, target_col):
    """Equality after lower-casing, dropping leading whitespace and ASCII punctuation."""
    return normalise_answer(pred_col) == normalise_answer(target_col)
