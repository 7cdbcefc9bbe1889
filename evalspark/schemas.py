"""Declared schemas of the library's tables (D1-D21 in the design notes)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ITEMS = _struct(("ind", S), ("ctx", S), ("activity_label", S), ("endings", T.ArrayType(S)), ("label", I))
RAW_ITEMS = _struct(
    ("ind", S), ("ctx", S), ("ctx_a", S), ("ctx_b", S), ("activity_label", S),
    ("endings", T.ArrayType(S)), ("label", S),
)
QA_ITEMS = _struct(("question", S), ("answer", S))

DECODING_PARAMS = _struct(
    ("max_tokens", I), ("temperature", D), ("top_p", D), ("top_k", I), ("stop", T.ArrayType(S)),
    ("seed", L), ("n", I), ("logprobs", I), ("echo", B),
)

LOGPROB_PAYLOAD = _struct(
    ("tokens", T.ArrayType(S)),
    ("token_logprobs", T.ArrayType(D)),
    ("top_logprobs", T.ArrayType(T.MapType(S, D))),
)

# Column order of the request log (fixed by the log format).
REQUEST_COLUMNS = (
    "idx", "prompt_kind", "prompt_chars", "max_tokens", "mode", "wall_s", "ttft_s",
    "output_tokens", "status", "error", "started_at", "ended_at",
)
REQUEST_METRICS_RAW = _struct(*[(c, S) for c in REQUEST_COLUMNS])
REQUEST_METRICS = _struct(
    ("idx", L), ("prompt_kind", S), ("prompt_chars", I), ("max_tokens", I), ("mode", S),
    ("wall_s", D), ("ttft_s", D), ("output_tokens", I), ("status", S), ("error", S),
    ("started_at", D), ("ended_at", D),
)

GPU_SAMPLES = _struct(
    ("timestamp", D), ("index", I), ("util_gpu", D), ("util_mem", D), ("mem_used", D),
    ("mem_total", D), ("temp", D), ("power", D),
)

# Column order of the result log (fixed by the log format).
RESULT_LOG_COLUMNS = (
    "run_id", "timestamp", "commit", "model", "task", "method", "limit", "num_fewshot", "seed",
    "metric", "value", "stderr", "delta", "ci95_low", "ci95_high", "wall_s", "mock_backend", "notes",
)
RESULT_LOG_RAW = _struct(*[(c, S) for c in RESULT_LOG_COLUMNS])
RESULT_LOG = _struct(
    ("run_id", L), ("timestamp", T.TimestampType()), ("commit", S), ("model", S), ("task", S),
    ("method", S), ("limit", I), ("num_fewshot", I), ("seed", L), ("metric", S), ("value", D),
    ("stderr", D), ("delta", D), ("ci95_low", D), ("ci95_high", D), ("wall_s", D),
    ("mock_backend", B), ("notes", S),
)

EXAMPLE_RESULTS = _struct(
    ("run_id", L), ("variant", S), ("ind", S), ("label", I), ("predicted", I), ("correct", B),
    ("scores", T.ArrayType(D)),
)

CACHE = _struct(
    ("key", S), ("model", S), ("prompt", S), ("params", S), ("response", S), ("created_at", D),
    ("batch_id", L),
)

TASK_METRICS = _struct(("task", S), ("pos", I), ("metric", S), ("value", D))
