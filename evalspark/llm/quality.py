"""Quality rules with thresholds that adapt to each language and source.

Fixed cut-offs that suit one source throw away good text of another. Here
every (language, source) gets its own: the measures of its documents go into
mergeable quantile sketches, the quartiles read from a sketch give fences,
and documents are joined with the fences of their group.

A sketch is a log-linear histogram in a table (group, measure, bucket,
count): values under 64 have a bucket each, larger ones 32 buckets per power
of two, so a quantile is exact up to 1/32 of its value. Merging is adding
counts; it doesn't depend on order, partitions or retries. A group with few
documents takes the sketch of its language, a small language that of all
documents: both are merged from the sketches, the documents aren't read
again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, text_slices, tokenise

SYMBOLS = "#*$%&|<>"
WINDOW = 8               # words in a window that may repeat
LEAST_WORDS = 20         # base rule: fewer words fail
MOST_REPEATED = 30       # base rule: more repeated words, in a hundred, fail
LEAST_DOCS = 200         # documents that a group's own fences need
REACH = 4                # quartile distances between a quartile and its fence
FINE = 32                # buckets per power of two
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Measure:
    """A ratio of two counts in whole ``scale`` parts, its fenced sides and the least quartile distance."""

    name: str
    part: str
    whole: str
    scale: int
    least: int
    low: bool = False


MEASURES = (
    Measure("word_length", "word_chars", "n_words", 100, 50, low=True),
    Measure("symbols", "n_symbols", "n_words", 1000, 25),
    Measure("dup_lines", "n_dup_lines", "n_lines", 1000, 75),
    Measure("repeats", "n_repeat_words", "n_words", 1000, 50),
)


def _repeated(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text: words covered by a window of WINDOW words that its text has twice or more.

    Windows get exact numbers by doubling: pairs of words, then pairs of
    pairs, then of those.
    """
    ids, size = codes, 1
    while size < WINDOW:
        left, right = ids[:max(0, len(ids) - size)], ids[size:]
        span = int(ids.max(initial=0)) + 1
        ids = np.unique(left * span + right, return_inverse=True)[1] if len(left) else left
        size *= 2
    if not len(ids):
        return np.zeros(n_docs, np.int64)
    inside = np.flatnonzero(doc[:len(ids)] == doc[WINDOW - 1:WINDOW - 1 + len(ids)])
    _, which, count = np.unique(doc[inside] * (int(ids.max()) + 1) + ids[inside], return_inverse=True, return_counts=True)
    start = inside[count[which] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of every text (null: empty)."""
    n = len(texts)
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    tokens = tokenise(col)
    n_words = np.diff(tokens.offsets)
    doc = np.repeat(np.arange(n), n_words)
    chars = pc.utf8_length(tokens.words).to_numpy(zero_copy_only=False).astype(np.int64)

    def per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])

    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS.encode())] = True
    raw = np.frombuffer("".join(col.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))])
    lists = pc.split_pattern(col, "\n")
    lines = lists.flatten()
    line_doc = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    line_code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    line_doc = line_doc[full]
    different = np.unique(line_doc * (int(line_code.max(initial=0)) + 1) + line_code, return_index=True)[1]
    n_lines = np.bincount(line_doc, minlength=n)
    return {
        "n_words": n_words, "word_chars": per_text(chars[tokens.codes], tokens.offsets),
        "n_symbols": per_text(is_symbol[raw], ends),
        "n_dup_lines": n_lines - np.bincount(line_doc[different], minlength=n),
        "n_repeat_words": _repeated(tokens.codes, doc, n), "n_lines": n_lines}


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, COUNTS, base_failed) of every row of ``docs``; one row per input row.

    Words are runs of other characters than space and \\t..\\r, lines are
    what \\n separates and holds a word. A null or empty text has counts 0
    and fails.
    """
    kind = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            got = measure_texts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(got[c].astype(np.int64)) for c in COUNTS],
                ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("lang", "source", "text")])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(run, kind).withColumn("base_failed", failed)


def value(m: Measure) -> Column:
    return F.expr(f"({m.scale} * {m.part}) div greatest({m.whole}, 1)")


def bucket(v: Column) -> Column:
    """Bucket of a whole number >= 0: itself under 2 * FINE, then FINE buckets per power of two."""
    power = F.char_length(F.bin(v)) - FINE.bit_length()
    return F.when(v < 2 * FINE, v).otherwise(power * FINE + F.floor(v / F.pow(F.lit(2.0), power)).cast("long"))


def bucket_ends(b: Column) -> tuple[Column, Column]:
    """Smallest and largest value of a bucket."""
    power = F.floor(b / FINE) - 1
    step = F.pow(F.lit(2.0), power).cast("long")
    mantissa = b - FINE * power
    small = b < 2 * FINE
    return F.when(small, b).otherwise(mantissa * step), F.when(small, b).otherwise((mantissa + 1) * step - 1)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): one histogram per group and measure; a hot group is one partial row per bucket and task."""
    cells = F.array(*[F.struct(F.lit(m.name).alias("measure"), bucket(value(m)).alias("bucket")) for m in MEASURES])
    return rows.select(*keys, F.inline(cells)).groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts of equal buckets are added."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, docs, q1, q3) read from the sketches: q1 rounded down to its bucket's start, q3 up to its end."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    low, high = bucket_ends(F.col("bucket"))
    ranked = sketch.withColumn("docs", F.sum("n").over(group)).withColumn("seen", F.sum("n").over(upto))
    reached = lambda p: F.col("seen") >= F.expr(f"({p} * docs + 99) div 100")
    return ranked.groupBy(*keys, "measure").agg(
        F.max("docs").alias("docs"), F.min(F.when(reached(25), low)).alias("q1"), F.min(F.when(reached(75), high)).alias("q3"))


def fences(sketch: DataFrame, least_docs: int = LEAST_DOCS, reach: int = REACH) -> DataFrame:
    """(lang, source, low, high): maps from measure to fence for every group of the sketches.

    A group of fewer than ``least_docs`` documents takes the quartiles of its
    language, a language with fewer those of all.
    """
    keys = ["lang", "source"]
    least = F.create_map(*[x for m in MEASURES for x in (F.lit(m.name), F.lit(m.least))])
    own = quartiles(sketch, keys)
    langs = quartiles(merge(sketch, ["lang"]), ["lang"]).select(
        F.col("lang").alias("l"), F.col("measure").alias("lm"), F.struct("docs", "q1", "q3").alias("by_lang"))
    every = quartiles(merge(sketch, []), []).select(F.col("measure").alias("am"), F.struct("q1", "q3").alias("of_all"))
    wide = (own.join(langs, own.lang.eqNullSafe(langs.l) & (own.measure == langs.lm))
            .join(every, F.col("measure") == F.col("am")))
    enough, lang_enough = F.col("docs") >= least_docs, F.col("by_lang.docs") >= least_docs
    q = {c: F.when(enough, F.col(c)).when(lang_enough, F.col(f"by_lang.{c}")).otherwise(F.col(f"of_all.{c}")) for c in ("q1", "q3")}
    gap = reach * F.greatest(q["q3"] - q["q1"], least[F.col("measure")])
    ends = wide.select(*keys, "measure", (q["q1"] - gap).alias("low"), (q["q3"] + gap).alias("high"))
    return ends.groupBy(*keys).agg(*[
        F.map_from_entries(F.collect_list(F.struct("measure", side))).alias(side) for side in ("low", "high")])


def judge(docs: DataFrame, least_docs: int = LEAST_DOCS, reach: int = REACH) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept, failed) of every row of ``docs`` (doc_id, text, lang, source).

    A document is kept if it passes the base rules and all its measures lie
    within the fences of its (lang, source); null is a group like any other.
    ``failed`` names the measures outside. Documents that fail the base rules
    don't take part in the sketches; their ``failed`` is empty. Repeated rows
    are judged each, and count each. An empty table gives an empty result;
    other columns aren't read.
    """
    rows = materialise(measures(docs))
    ends = fences(sketches(rows.filter("not base_failed"), ["lang", "source"]), least_docs, reach)
    ends = ends.select(F.col("lang").alias("l"), F.col("source").alias("s"), "low", "high")
    outside = F.array_compact(F.array(*[
        F.when((value(m) > F.col("high")[m.name]) | (F.lit(m.low) & (value(m) < F.col("low")[m.name])), F.lit(m.name)) for m in MEASURES]))
    both = rows.join(ends, rows.lang.eqNullSafe(F.col("l")) & rows.source.eqNullSafe(F.col("s")), "left")
    failed = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(outside)
    return both.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
                       F.array_join(failed, ",").alias("failed"))

