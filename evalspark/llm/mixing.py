"""Mixing sources to target weights by iterative proportional fitting.

Every document is in a cell (source, language, topic) with its token count.
IPF rakes the cells' token weights until the three marginals meet their
targets: weight = tokens * a(source) * b(language) * c(topic), where each
factor table is rescaled in turn. A document is then drawn with probability
proportional to the product of its factors, so the expected tokens of the
sample have the target marginals.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import WORD, materialise

DIMENSIONS = ("source", "lang", "topic")
# Topic of a document: the first rule whose text it contains.
TOPICS = (("tabular", "|"), ("legal", "icense"), ("contact", "@"))
DEFAULT_TOPIC = "prose"
# A target share is the natural share to this power, normalised: 1 keeps the mix, 0 makes it uniform.
FLATTEN = {"source": 0.8, "lang": 0.9, "topic": 0.95}
TOLERANCE = 1e-6
MAX_SWEEPS = 50


def topic_of(text: Column, rules=TOPICS, default: str = DEFAULT_TOPIC) -> Column:
    out = F.lit(default)
    for name, part in reversed(rules):
        out = F.when(F.contains(text, F.lit(part)), name).otherwise(out)
    return out


def _key(c: Column) -> Column:
    """Category as a non-null text; null is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def token_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with the keys s, l, t of their cell and n tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = [_key(F.col("source")).alias("s"), _key(F.col("lang")).alias("l"),
            _key(topic_of(text) if topic is None else topic).alias("t")]
    return docs.select(F.struct("*").alias("row"), *keys, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n"))


def _targets(cells: DataFrame, key: str, total: int, power: float, given: Mapping[str | None, float] | None) -> DataFrame:
    """(key, share): target shares of the categories that have tokens, summing to 1."""
    sums = cells.groupBy(key).agg(F.sum("n").alias("have")).filter("have > 0")
    if given is None:
        raw = F.pow(F.col("have") / total, F.lit(float(power)))
    else:
        items = [x for k, v in given.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))]
        raw = F.coalesce(F.create_map(*items)[F.col(key)] if items else F.lit(None), F.lit(0.0))
    rows = materialise(sums.select(key, raw.alias("raw")))
    all_ = rows.agg(F.sum("raw")).first()[0] or 0.0
    if all_ <= 0:
        raise ValueError("the targets give no weight to any category that has tokens")
    return rows.select(key, (F.col("raw") / all_).alias("share"))


def rake(cells: DataFrame, flatten: Mapping[str, float] = FLATTEN, targets: Mapping[str, Mapping] | None = None,
         tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS) -> tuple[list[DataFrame], float] | None:
    """Factor tables (key, f) of the three dimensions after IPF, and the largest product of factors of a cell.

    ``cells`` (s, l, t, n) may have several rows for a cell; they're summed
    first. Cells, targets and factors stay tables. Returns None if there are
    no tokens. Stops when no marginal is off by more than ``tolerance`` (or
    after ``max_sweeps``, when targets contradict each other: then a warning
    gives the largest difference of shares that is left in each dimension).
    """
    cells = materialise(cells.groupBy("s", "l", "t").agg(F.sum("n").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    keys = ["s", "l", "t"]
    share = [_targets(cells, k, total, flatten[d], (targets or {}).get(d)) for k, d in zip(keys, DIMENSIONS)]
    factors: list[DataFrame | None] = [None, None, None]

    def product(but: int | None) -> DataFrame:
        out = cells.withColumn("w", F.col("n") / total)
        for i, k in enumerate(keys):
            if i != but and factors[i] is not None:
                out = out.join(factors[i].select(k, F.col("f").alias("_f")), k, "left").withColumn(
                    "w", F.col("w") * F.coalesce("_f", F.lit(1.0))).drop("_f")
        return out

    for _ in range(max_sweeps):
        off = 0.0
        for i, k in enumerate(keys):
            sums = product(i).groupBy(k).agg(F.sum("w").alias("have"))
            fitted = sums.join(share[i], k, "left").select(
                k, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) / F.col("have")).otherwise(F.lit(0.0)).alias("f"),
                "have", F.coalesce("share", F.lit(0.0)).alias("share"))
            if factors[i] is not None:
                old = factors[i].select(k, F.col("f").alias("old"))
                fitted = fitted.join(old, k).withColumn("off", F.abs(F.col("have") * F.col("old") - F.col("share")))
            else:
                fitted = fitted.withColumn("off", F.abs(F.col("have") - F.col("share")))
            factors[i] = materialise(fitted.select(k, "f", "off"))
            off = max(off, factors[i].agg(F.max("off")).first()[0] or 0.0)
        if off <= tolerance:
            break
    else:
        left = {}
        for i, (k, d) in enumerate(zip(keys, DIMENSIONS)):
            sums = product(None).groupBy(k).agg(F.sum("w").alias("have"))
            diff = F.abs(F.col("have") - F.coalesce("share", F.lit(0.0)))
            left[d] = sums.join(share[i], k, "left").agg(F.max(diff)).first()[0] or 0.0
        if max(left.values()) > tolerance:
            warnings.warn(f"targets not met after {max_sweeps} sweeps; shares are off by up to "
                          + ", ".join(f"{d} {x:.3g}" for d, x in left.items()), RuntimeWarning, stacklevel=2)
    top = (product(None).filter("n > 0").agg(F.max(F.col("w") * total / F.col("n"))).first()[0])
    return [f.select(k, "f") for f, k in zip(factors, keys)], float(top)


def draw(docs: DataFrame, topic: Column | None = None, fraction: float = 1.0, seed: int = 17, **options) -> DataFrame:
    """(row, topic, n_tokens, weight, prob, sampled) of every row of ``docs``.

    ``row`` is the input row (doc_id, text, source, lang, whatever else).
    weight is the product of the factors of its cell; prob = fraction *
    weight / largest weight, so no probability passes 1 and expected token
    shares are the raked ones: the targets, if they don't contradict each
    other (else ``rake`` warns, and only topic meets its). ``sampled`` compares prob with a uniform
    number made from doc_id and ``seed`` (rows that repeat a doc_id share
    it). Null source or lang is a category of its own; a null or empty text
    has no tokens and follows its cell (weight 0 if a whole source, language
    or topic has none). An empty table gives an empty result.
    """
    cells = token_cells(docs, topic)
    fitted = rake(cells.select("s", "l", "t", "n"), **options)
    out, top = cells.withColumn("weight", F.lit(1.0)), 1.0
    if fitted:
        for table, k in zip(fitted[0], "slt"):
            out = out.join(table, k, "left").withColumn("weight", F.col("weight") * F.coalesce("f", F.lit(0.0))).drop("f")
        top = fitted[1] or 1.0
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("row.doc_id").cast("long")), 11) / F.lit(float(1 << 53))
    name = F.when(F.col("t") == "null", F.lit(None)).otherwise(F.expr("substring(t, 2)"))
    return (out.withColumn("prob", F.least(F.lit(1.0), F.lit(fraction) * F.col("weight") / F.lit(top)))
            .select("row", name.alias("topic"), F.col("n").alias("n_tokens"), "weight", "prob", (uniform < F.col("prob")).alias("sampled")))
