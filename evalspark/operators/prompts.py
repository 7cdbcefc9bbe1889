"""Prompt construction and exemplar selection.

Items carry ``ind, ctx, activity_label, endings, label``; prompt pairs are
one row per (item, option) with ``prompt`` and ``continuation``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.hashing import md5_u32, seeded_key
from evalspark.functions.indexing import broadcast_if_small, with_row_index
from evalspark.functions.text import as_continuation, lstrip_ws, strip_artifacts

DEMO_SEPARATOR = "\n\n"

# Fixed value: the QA prompt template of the custom task.
QA_INSTRUCTION = "Answer the question with a single short answer (one or two words)."


def _pairs(items: DataFrame, prompt: Column, keep: Sequence[str] = ()) -> DataFrame:
    # A prompt is built before the endings multiply its item, so once. (posexplode would have the planner filter
    # on the number of endings, below everything that builds them.)
    built = items.select("ind", *keep, prompt.alias("prompt"), F.col("endings").alias("_endings"))
    return built.select(
        "ind", *keep, "prompt", F.posexplode_outer("_endings").alias("option", "_ending"),
    ).filter(F.col("option").isNotNull()).select(
        "ind", *keep, F.col("option").cast("int").alias("option"), "prompt",
        as_continuation("_ending").alias("continuation"),
    )


def baseline_pairs(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One pair per ending, prompt = raw context."""
    return _pairs(items, F.col("ctx"), keep)


def clean_pairs(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """T4: as T3 with header tags and the activity prefix stripped from the context."""
    return _pairs(items, strip_artifacts("ctx", "activity_label"), keep)


def demo_text(pool: DataFrame, clean: bool = True) -> DataFrame:
    """Demonstration text of each pool row: (cleaned) context, one space, gold ending."""
    ctx = strip_artifacts("ctx", "activity_label") if clean else F.col("ctx")
    gold = F.try_element_at("endings", (F.col("label") + 1).cast("int"))
    return pool.select("pool_id", F.concat(ctx, F.lit(" "), lstrip_ws(F.coalesce(gold, F.lit("")))).alias("demo"))


def fewshot_random(items: DataFrame, pool: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``min(k, |pool|)`` distinct pool rows per item, seeded.

    The pool is put in a seeded order (``md5(seed:pool_id)``) and indexed
    0..P-1; item ``ind`` draws a uniform ``k``-subset of the positions by
    Floyd's method: for p from P-k to P-1 it takes ``md5(seed:ind:p) mod (p+1)``,
    or p itself if that position is taken. The choice is a pure function of
    (seed, ind, pool): no cross product of items and pool is formed, only
    ``k`` rows per item joined on the position. Returns ``(ind, j, pool_id)``,
    ``j`` = demo order.
    """
    if k <= 0:
        return items.sparkSession.createDataFrame([], "ind string, j int, pool_id bigint")
    indexed = with_row_index(
        pool.select("pool_id", F.md5(seeded_key(seed, F.col("pool_id"))).alias("_pk")),
        ["_pk", "pool_id"], "_pos",
    ).select("pool_id", "_pos")
    pool_side, n_pool = broadcast_if_small(indexed)
    if n_pool == 0:
        return items.sparkSession.createDataFrame([], "ind string, j int, pool_id bigint")
    kk = min(k, n_pool)
    def taken(chosen: Column, p: Column) -> Column:
        drawn = F.pmod(md5_u32(seeded_key(seed, F.col("ind"), p)), p + 1)
        return F.array_append(chosen, F.when(F.array_contains(chosen, drawn), p).otherwise(drawn))

    places = F.sequence(F.lit(n_pool - kk).cast("bigint"), F.lit(n_pool - 1).cast("bigint"))
    drawn = F.aggregate(places, F.array().cast("array<bigint>"), taken)
    picks = items.select("ind", F.posexplode(drawn).alias("j", "_pos"))
    return picks.join(pool_side, "_pos").select("ind", "j", "pool_id")


def fewshot_pairs(items: DataFrame, picks: DataFrame, pool: DataFrame, clean: bool = True,
                  keep: Sequence[str] = ()) -> DataFrame:
    """T5: prompt = demos (``ctx + ' ' + gold``, in pick order, blank-line separated),
    a blank line, then the (cleaned) context. Items without demos get T4 pairs.

    ``picks`` is ``(ind, j, pool_id)`` from T7 or T8/T9; each item's demos are
    gathered from its ``k`` picks only.
    """
    demos_side, _ = broadcast_if_small(demo_text(pool, clean))
    demos = (
        picks.join(demos_side, "pool_id")
        .groupBy("ind")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "demo"))),
                                      lambda s: s.getField("demo")), DEMO_SEPARATOR).alias("_demos"))
    )
    ctx = strip_artifacts("ctx", "activity_label") if clean else F.col("ctx")
    with_demos = items.join(demos, "ind", "left")
    prompt = F.when(F.col("_demos").isNull(), strip_artifacts("ctx", "activity_label")).otherwise(
        F.concat(F.col("_demos"), F.lit(DEMO_SEPARATOR), ctx))
    return _pairs(with_demos, prompt, keep)


def qa_prompt(question: Column | str = "question") -> Column:
    """The QA template (instruction, blank line, ``Question: ...``, ``Answer:``)."""
    q = F.col(question) if isinstance(question, str) else question
    return F.concat(F.lit(QA_INSTRUCTION + "\n\nQuestion: "), q, F.lit("\nAnswer:"))


# The prompt variants as (variant, prompt kind, score mode, demonstrations).
VARIANTS = (
    ("baseline", "baseline", "sum", 0),
    ("length_norm", "baseline", "length_norm", 0),
    ("byte_norm", "baseline", "byte_norm", 0),
    ("clean_prompt", "clean", "sum", 0),
    ("clean_length_norm", "clean", "length_norm", 0),
    ("fewshot_random_5", "fewshot_random", "length_norm", 5),
    ("fewshot_semantic_5", "fewshot_semantic", "length_norm", 5),
)
VARIANT_KIND = "variant string, kind string, scoring string, k int"


def variant_rows(names: Sequence[str] | None = None) -> list[tuple]:
    """Registry rows of the named variants (all by default); an unknown name is a KeyError."""
    by_name = {row[0]: row for row in VARIANTS}
    return [by_name[n] for n in (by_name if names is None else names)]


def variants_frame(spark, names: Sequence[str] | None = None) -> DataFrame:
    """The variant registry (D21) as a small DataFrame."""
    return spark.createDataFrame(variant_rows(names), VARIANT_KIND)


def build_ladder(items: DataFrame, pool: DataFrame, names: Sequence[str] | None = None, seed: int = 42,
                 semantic_picks: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Prompt pairs of every requested variant in one DataFrame.

    Pairs are built once per distinct prompt kind (and k), then attached to the
    variants that share them, so scoring modes of one kind reuse the same
    prompts. Output: ``variant, kind, scoring, ind, option, prompt, continuation``.
    """
    chosen = variant_rows(names or None)
    frames = []
    for kind, k in sorted({(row[1], row[3]) for row in chosen}):
        if kind == "baseline":
            pairs = baseline_pairs(items)
        elif kind == "clean":
            pairs = clean_pairs(items)
        elif kind == "fewshot_random":
            pairs = fewshot_pairs(items, fewshot_random(items, pool, k, seed), pool)
        elif kind == "fewshot_semantic":
            if semantic_picks is None:
                raise ValueError("fewshot_semantic needs a semantic_picks function")
            pairs = fewshot_pairs(items, semantic_picks(items, pool, k), pool)
        else:
            raise KeyError(f"unknown variant kind: {kind}")
        frames.append(pairs.withColumn("kind", F.lit(kind)).withColumn("k", F.lit(k)))
    allp = frames[0]
    for f in frames[1:]:
        allp = allp.unionByName(f)
    reg = F.broadcast(variants_frame(items.sparkSession, [row[0] for row in chosen]))
    return allp.join(reg, ["kind", "k"]).select(
        "variant", "kind", "scoring", "ind", "option", "prompt", "continuation")
