"""Answer-level levers (X1-X4): majority vote, prompt ensembling, regex
extraction, confidence filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.indexing import with_running_sums
from evalspark.operators.scoring import predict_long


def majority_vote(samples: DataFrame, key: str = "ind", answer: str = "answer", sample: str = "sample") -> DataFrame:
    """The most frequent answer per item; ties go to the answer seen first (lowest sample).

    Two partial aggregates (answer counts, then a ``max_by`` per item), so an
    item with very many samples never gathers them in one task.
    """
    counts = samples.groupBy(key, answer).agg(F.count("*").alias("votes"), F.min(sample).alias("first_sample"))
    return counts.groupBy(key).agg(
        F.max_by(F.struct(F.col(answer).alias("answer"), F.col("votes")),
                 F.struct(F.col("votes"), -F.col("first_sample"))).alias("_w"),
        F.sum("votes").alias("n_samples"),
    ).select(key, F.col("_w.answer").alias("answer"), F.col("_w.votes").alias("votes"), "n_samples")


def ensemble_scores(scores: DataFrame, keys: Sequence[str] = ("ind", "option"), score: str = "score",
                    digits: int | None = None) -> DataFrame:
    """Mean score per (item, option) over phrasings (variants), then L8 prediction.

    ``digits`` rounds the mean before the argmax (so summation order cannot
    flip exact ties).
    """
    mean = scores.groupBy(*keys).agg(F.avg(score).alias("score"), F.count("*").alias("n_variants"))
    if digits is not None:
        mean = mean.withColumn("score", F.round("score", digits))
    item_keys = [k for k in keys if k != "option"]
    return predict_long(mean, "score", item_keys)


def extract_answer(text: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex answer extraction (empty string when the pattern does not match)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract(t, pattern, group)


def confidence(scores: Column | str) -> list[Column]:
    """Softmax over an item's option scores: max probability, top-2 margin, entropy."""
    s = F.col(scores) if isinstance(scores, str) else scores
    m = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - m))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    p = F.transform(e, lambda x: x / z)
    srt = F.sort_array(p, asc=False)
    ent = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0)))
    return [
        F.element_at(srt, 1).alias("p_max"),
        (F.element_at(srt, 1) - F.coalesce(F.try_element_at(srt, F.lit(2)), F.lit(0.0))).alias("margin"),
        ent.alias("entropy"),
    ]


def coverage_curve(conf: DataFrame, thresholds: Sequence[float], by: str = "p_max",
                   correct: str = "correct") -> DataFrame:
    """For each threshold, the share of items kept (``by >= t``) and their accuracy."""
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    x = conf.select(F.explode(arr).alias("threshold"), F.col(by).alias("_c"), F.col(correct).cast("double").alias("_y"))
    return x.groupBy("threshold").agg(
        F.avg((F.col("_c") >= F.col("threshold")).cast("double")).alias("coverage"),
        F.avg(F.when(F.col("_c") >= F.col("threshold"), F.col("_y"))).alias("accuracy"),
        F.count_if(F.col("_c") >= F.col("threshold")).alias("kept"),
    )


def risk_coverage(conf: DataFrame, by: str = "p_max", correct: str = "correct") -> DataFrame:
    """The whole risk-coverage curve: a row (threshold, kept, coverage, accuracy, area) per distinct confidence.

    Keeping the items with ``by >= threshold`` gives ``kept``, their share
    and their accuracy. ``area``, the same on every row, is the area under risk
    (1 - accuracy) over coverage, as a step at every threshold. Items of one
    confidence are added up before the sort, and the counts above a threshold
    are distributed prefix sums. Items without confidence or flag are left
    out; no item gives no row.
    """
    points = (conf.filter(F.col(by).isNotNull() & ~F.isnan(by) & F.col(correct).isNotNull()).groupBy(F.col(by).cast("double").alias("threshold"))
              .agg(F.count("*").alias("_n"), F.sum(F.col(correct).cast("bigint")).alias("_y")))
    curve = with_running_sums(points, [F.desc("threshold")], {"kept": "_n", "_right": "_y"}).checkpoint()
    risk = 1 - F.col("_right") / F.col("kept")
    total, area = curve.agg(F.max("kept"), F.sum(F.col("_n") * risk)).first()
    return curve.select("threshold", "kept", (F.col("kept") / F.lit(total)).alias("coverage"), (F.col("_right") / F.col("kept")).alias("accuracy"),
                        F.lit(area / total if total else None).cast("double").alias("area"))
