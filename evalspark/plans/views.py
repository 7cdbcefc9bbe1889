"""Bindings of the library's tables onto the driver's test data.

Each function reads base parquet tables and derives one of the library's
input tables (request log, paired correctness, benchmark items, ...) with
plain projections, so the derived table grows with the base data. The same
derivations are written in DuckDB SQL in :mod:`evalspark.plans.views_sql`;
the two must stay expression-for-expression equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.hashing import md5_buckets
from evalspark.sources.readers import read_table


def _epoch_seconds(ts: Column) -> Column:
    # Test timestamps load as TIMESTAMP_NTZ; interpret them as UTC.
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log (D13) derived from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("user_id") % 2 == 0, "short").otherwise("long")
    mode = F.when(F.col("event_id") % 3 == 0, "generate").otherwise("stream")
    wall = F.col("value") / F.lit(50.0)
    status = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 400), "timeout")
        .when(F.col("event_type") == "error", "error")
        .otherwise("ok")
    )
    started = _epoch_seconds(F.col("ts"))
    return ev.select(
        F.col("event_id").alias("idx"),
        kind.alias("prompt_kind"),
        F.when(kind == "short", 18).otherwise(384).alias("prompt_chars"),
        F.when(kind == "short", 32).otherwise(256).alias("max_tokens"),
        mode.alias("mode"),
        wall.alias("wall_s"),
        F.when(mode == "stream", wall * k / F.lit(200.0)).alias("ttft_s"),
        k.alias("output_tokens"),
        status.alias("status"),
        F.when(status != "ok", F.concat(F.lit("HTTP "), F.col("event_type"))).alias("error"),
        started.alias("started_at"),
        (started + wall).alias("ended_at"),
    )


def gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPU samples (D14): one sample per minute, utilisation = mean event value."""
    ev = read_table(spark, sf_dir, "events")
    minute = _epoch_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    return (
        ev.groupBy(minute.alias("timestamp"))
        .agg(F.avg("value").alias("util_gpu"), F.max("value").alias("mem_used"))
        .select("timestamp", F.lit(0).alias("index"), "util_gpu", "mem_used")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired correctness: baseline = quality, improved = 1 - toxic."""
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("ind"),
        F.col("quality").alias("baseline"),
        (F.lit(1) - F.col("toxic")).alias("improved"),
        "lang",
        "source",
    )


def pieces(text: Column, n: int) -> list[Column]:
    """The whole text in ``n`` consecutive parts of equal length (the last ones may be one character longer)."""
    size = F.char_length(text)
    at = [F.floor(size * i / n).cast("int") for i in range(n + 1)]
    return [F.substring(text, at[i] + 1, at[i + 1] - at[i]) for i in range(n)]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice items (D1): a document's first fifth is the context, the others are the endings."""
    d = read_table(spark, sf_dir, "documents")
    p = pieces(F.col("text"), 5)
    return d.select(
        F.col("doc_id").cast("string").alias("ind"),
        F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("source"), F.lit(": "),
                 p[0]).alias("ctx"),
        F.col("source").alias("activity_label"),
        F.array(*p[1:]).alias("endings"),
        (F.col("doc_id") % 4).cast("int").alias("label"),
    )


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items (D2): ctx sometimes missing, split ctx_a / ctx_b, string labels; the parts are a document's sixths."""
    d = read_table(spark, sf_dir, "documents")
    p = pieces(F.col("text"), 6)
    return d.select(
        F.col("doc_id").alias("ind"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.lit(""))
        .otherwise(p[0]).alias("ctx"),
        p[0].alias("ctx_a"),
        p[1].alias("ctx_b"),
        F.col("source").alias("activity_label"),
        F.array(*p[2:]).alias("endings"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(""))
        .when(F.col("doc_id") % 7 == 1, F.lit(None))
        .otherwise((F.col("doc_id") % 4).cast("string")).alias("label"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplar pool from ``benchmark``: the first fifth is the context, the others are the endings."""
    b = read_table(spark, sf_dir, "benchmark")
    p = pieces(F.col("text"), 5)
    return b.select(
        F.col("item_id").alias("pool_id"),
        p[0].alias("ctx"),
        F.lit("bench").alias("activity_label"),
        F.array(*p[1:]).alias("endings"),
        (F.col("item_id") % 4).cast("int").alias("label"),
    )


def logprob_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring payloads (D8) for every (item, option): echoed prompt + continuation.

    Tokens are whitespace tokens of ``ctx || ' ' || ending``; the log-prob of a
    position is a hash of (ind, option, pos) so both engines derive the same
    value; the first position is null (echo). Each position also carries a
    two-entry top-log-prob map (the token and one alternative).
    """
    it = items(spark, sf_dir)
    ex = it.select("ind", "ctx", F.posexplode("endings").alias("option", "ending"))
    toks = F.filter(F.split(F.concat_ws(" ", "ctx", "ending"), r"\s+"), lambda x: x != "")

    key = F.concat_ws(":", "ind", F.col("option").cast("string"))
    lp = lambda hashes, i: -F.get(hashes, i).cast("bigint") / F.lit(100.0)
    return ex.select(
        "ind",
        F.col("option").cast("int").alias("option"),
        "ctx",
        "ending",
        toks.alias("tokens"),
    ).select(
        "ind", "option", "ctx", "ending", "tokens",
        md5_buckets(key, F.size("tokens"), 1000).alias("_said"),
        md5_buckets(key, F.size("tokens"), 1000, ":alt").alias("_other"),
    ).select(
        "ind", "option", "ctx", "ending", "tokens",
        F.transform("_said", lambda h, i: F.when(i > 0, -h.cast("bigint") / F.lit(100.0))).alias("token_logprobs"),
        F.transform(
            "tokens",
            lambda t, i: F.when(i > 0, F.create_map(t, lp(F.col("_said"), i), F.lit("<alt>"), lp(F.col("_other"), i))),
        ).alias("top_logprobs"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt / output pairs: each user turn with the assistant turn that follows it.

    Turns are numbered consecutively per conversation, so the next turn is an
    equi-join on ``(conv_id, turn + 1)``: no conversation, however long, is
    gathered into one task (as a window over the conversation would).
    """
    c = read_table(spark, sf_dir, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    nxt = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(nxt, ["conv_id", "turn"]).select(
        "conv_id",
        "turn",
        F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model"),
        "prompt",
        "output",
    )


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated generations: prompt = source, run = doc_id, text = the whole document."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("prompt"), F.col("doc_id").alias("run"), "text", "lang")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result-log rows (D15) from ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    delta = F.when(key % 3 == 0, F.lit(None)).otherwise((F.col("o_totalprice") - 250000.0) / F.lit(1e6))
    return o.select(
        key.alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.substring(F.md5(key.cast("string")), 1, 7).alias("commit"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"),
        F.col("o_orderpriority").alias("task"),
        F.col("o_orderstatus").alias("method"),
        F.when(key % 2 == 0, 200).alias("limit"),
        (F.col("o_custkey") % 6).cast("int").alias("num_fewshot"),
        F.lit(42).alias("seed"),
        F.lit("acc").alias("metric"),
        F.col("o_totalprice").alias("value"),
        F.when(key % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / F.lit(1e7)).alias("stderr"),
        delta.alias("delta"),
        (delta - 0.05).alias("ci95_low"),
        (delta + 0.05).alias("ci95_high"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("wall_s"),
        (key % 10 == 0).alias("mock_backend"),
        F.when(key % 11 == 0, F.lit("line one\nline two")).otherwise(F.lit("")).alias("notes"),
    )


def qa_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA items (D3): question = a user turn, answer = the whole reply."""
    g = generations(spark, sf_dir)
    return g.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("prompt").alias("question"),
        F.col("output").alias("answer"),
    )


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent-event lines of token streams, one per event: request = user, time = ts.

    Views are keep-alive comments, errors are the ``[DONE]`` marker, other events
    carry a JSON chunk whose text is the event type (``purchase`` an empty delta).
    """
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    text = F.when(et == "purchase", F.lit("")).otherwise(
        F.concat(et, F.lit(" "), (F.col("event_id") % 3).cast("string")))
    line = (
        F.when(et == "view", F.lit(": keep-alive"))
        .when(et == "error", F.lit("data: [DONE]"))
        .otherwise(F.concat(F.lit('data: {"choices": [{"text": "'), text, F.lit('", "finish_reason": null}]}')))
    )
    return ev.select(F.col("user_id").alias("request_id"), _epoch_seconds(F.col("ts")).alias("ts"),
                     F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").alias("seq"), line.alias("value"))


def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-task metric dictionaries (D16) in long form, one task per order.

    Four shapes by ``o_orderkey % 4``: accuracy with stderr and a normalised
    accuracy; exact match under a non-preferred filter name plus a preferred
    one; a perplexity trio (no preferred name); and only a string alias.
    """
    o = read_table(spark, sf_dir, "orders")
    p = F.col("o_totalprice")

    def m(pos, name, value):
        return F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("metric"), value.cast("double").alias("value"))

    alias = m(0, "alias", F.lit(None))
    kind = F.col("o_orderkey") % 4
    rows = (
        F.when(kind == 0, F.array(alias, m(1, "acc,none", p / 1e6), m(2, "acc_stderr,none", p / 1e8),
                                  m(3, "acc_norm,none", p / 2e6), m(4, "acc_norm_stderr,none", p / 2e8)))
        .when(kind == 1, F.array(alias, m(1, "exact_match,strict-match", p / 1e6),
                                 m(2, "exact_match_stderr,strict-match", p / 1e8), m(3, "exact_match,none", p / 3e6)))
        .when(kind == 2, F.array(alias, m(1, "word_perplexity,none", p / 1e3), m(2, "byte_perplexity,none", p / 1e4),
                                 m(3, "bits_per_byte,none", p / 1e5)))
        .otherwise(F.array(alias))
    )
    return o.select(F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("task"),
                    F.explode(rows).alias("r")).select("task", "r.pos", "r.metric", "r.value")
