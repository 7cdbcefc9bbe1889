"""Log-prob payload columns.

A payload is ``tokens ARRAY<STRING>, token_logprobs ARRAY<DOUBLE>,
top_logprobs ARRAY<MAP<STRING,DOUBLE>>`` (null elements allowed). All
functions are higher-order Catalyst expressions evaluated per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import schemas
from evalspark.functions.text import word_count

SCORING_MODES = ("sum", "length_norm", "byte_norm")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_payload(raw) -> Column:
    """L3: the ``choices[0].logprobs`` block of a raw JSON response; missing → empty arrays."""
    choice = T.StructType([T.StructField("logprobs", schemas.LOGPROB_PAYLOAD)])
    whole = F.from_json(_c(raw), T.StructType([T.StructField("choices", T.ArrayType(choice))]))
    block = F.get(whole.getField("choices"), F.lit(0)).getField("logprobs")
    return F.struct(
        F.coalesce(block.getField("tokens"), F.array().cast("array<string>")).alias("tokens"),
        F.coalesce(block.getField("token_logprobs"), F.array().cast("array<double>")).alias("token_logprobs"),
        F.coalesce(block.getField("top_logprobs"), F.array().cast("array<map<string,double>>")).alias("top_logprobs"),
    )


def tail(arr, n) -> Column:
    """The last ``n`` elements (Python ``arr[-n:]``: whole list when n exceeds it or n <= 0)."""
    a = _c(arr)
    n = _c(n) if not isinstance(n, int) else F.lit(n)
    size = F.size(a)
    m = F.least(n, size)
    return F.when((size == 0) | (n <= 0) | (m <= 0), a).otherwise(F.slice(a, -m, m))


def nonnull(arr) -> Column:
    return F.filter(_c(arr), lambda x: x.isNotNull())


def sum_nonnull(arr) -> Column:
    """Sum of the non-null elements (0.0 when none)."""
    return F.aggregate(nonnull(arr), F.lit(0.0), lambda acc, x: acc + x)


def cont_len_eval(n_ctx, n_full) -> Column:
    """L2 (a): continuation tokens on the evaluation path: ``max(0, n_full - n_ctx)``."""
    return F.greatest(F.lit(0), _c(n_full) - _c(n_ctx))


def cont_len_ablation(n_prompt, n_full, n_tokens) -> Column:
    """L2 (b): ablation path, clamped to ``[1, len(tokens)]`` (no clamp above when tokens is empty)."""
    d = _c(n_full) - _c(n_prompt)
    upper = F.when(_c(n_tokens) > 0, F.least(_c(n_tokens), d)).otherwise(d)
    return F.greatest(F.lit(1), upper)


def argmax_key(m) -> Column:
    """Key of the largest value of a map; the first such entry in map order wins ties."""
    keys, values = F.map_keys(_c(m)), F.map_values(_c(m))
    best = F.array_position(values, F.array_max(values)).cast("int")
    # an entry is only replaced by a larger one, so a first value of null stays
    return F.get(keys, F.when(F.get(values, 0).isNull(), 0).otherwise(best - 1))


def is_greedy(tokens, top_logprobs, n) -> Column:
    """Every tail token equals the argmax of its top-log-prob map; missing maps skipped; empty → true."""
    pairs = F.arrays_zip(tail(tokens, n).alias("t"), tail(top_logprobs, n).alias("m"))
    # arrays_zip pads the shorter side with nulls; Python's zip stops at the shorter.
    return F.forall(
        pairs,
        lambda p: p.getField("t").isNull() | p.getField("m").isNull() | (F.size(p.getField("m")) == 0)
        | (argmax_key(p.getField("m")) == p.getField("t")),
    )


def loglikelihood(token_logprobs, n) -> Column:
    """L4: sum of the last ``n`` log-probs, nulls skipped."""
    return sum_nonnull(tail(token_logprobs, n))


def rolling_loglikelihood(token_logprobs) -> Column:
    """Sum over the whole echoed text, nulls skipped."""
    return sum_nonnull(token_logprobs)


def score(mode: str, tail_logprobs, continuation) -> Column:
    """``sum``; ``length_norm`` = sum / max(1, non-null count); ``byte_norm`` =
    sum / max(1, UTF-8 bytes of the continuation including its leading space)."""
    total = sum_nonnull(tail_logprobs)
    if mode == "sum":
        return total
    if mode == "length_norm":
        return total / F.greatest(F.lit(1), F.size(nonnull(tail_logprobs))).cast("double")
    if mode == "byte_norm":
        return total / F.greatest(F.lit(1), F.octet_length(_c(continuation))).cast("double")
    raise ValueError(f"unknown ScoringMode: {mode}")


def score_by_name(mode_col, tail_logprobs, continuation) -> Column:
    """L7 with the mode as a column (one projection serves every variant's mode)."""
    m = _c(mode_col)
    return (
        F.when(m == "sum", score("sum", tail_logprobs, continuation))
        .when(m == "length_norm", score("length_norm", tail_logprobs, continuation))
        .when(m == "byte_norm", score("byte_norm", tail_logprobs, continuation))
        .otherwise(F.raise_error(F.concat(F.lit("unknown ScoringMode: "), m.cast("string"))))
    )


def predict_wide(scores) -> Column:
    """Index of the max score, first index on ties (0-based)."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


# Decoding defaults used when neither a run override nor the task sets a value.
DEFAULT_TEMPERATURE = 0.0
DEFAULT_TOP_P = 1.0
DEFAULT_MAX_TOKENS = 256


def effective(override, task, default) -> Column:
    """Run override > task value > default."""
    return F.coalesce(_c(override), _c(task), F.lit(default))


def total_tokens(prompt_tokens, completion_tokens) -> Column:
    """L12."""
    return _c(prompt_tokens) + _c(completion_tokens)


def perplexities(sum_ll, sum_words, sum_bytes) -> list[Column]:
    """Word perplexity, byte perplexity and bits per byte from summed log-likelihoods."""
    ll, w, b = _c(sum_ll), _c(sum_words).cast("double"), _c(sum_bytes).cast("double")
    return [
        F.exp(-ll / w).alias("word_perplexity"),
        F.exp(-ll / b).alias("byte_perplexity"),
        (-ll / (b * F.lit(math.log(2.0)))).alias("bits_per_byte"),
    ]


def n_words(text) -> Column:
    return word_count(text)
