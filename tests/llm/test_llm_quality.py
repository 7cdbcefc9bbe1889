import re
from collections import Counter

import pytest
from llm_cases import DOC_KIND, awkward_docs, docs, prose, with_clashes, words

from evalspark.llm import quality


def counts(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    return (len(ws), sum(len(w.decode()) for w in ws), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), len(lines))


def ratios(c):
    n, chars, symbols, dup, rep, lines = c
    return {"word_length": 100 * chars // max(n, 1), "symbols": 1000 * symbols // max(n, 1), "dup_lines": 1000 * dup // max(lines, 1),
            "repeats": 1000 * rep // max(n, 1)}


def rounded(v, up):
    """A value's bucket end: 32 buckets per power of two from 64 on."""
    step = 1
    while v // step >= 64:
        step *= 2
    return v // step * step + (step - 1 if up else 0)


def verdicts(rows, least_docs):
    measured = [(r[0], r[2], r[3], counts(r[1])) for r in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for *_, c in measured]
    good = [(lang, source, ratios(c)) for (_, lang, source, c), f in zip(measured, failed) if not f]
    out = []
    for (doc_id, lang, source, c), f in zip(measured, failed):
        bad = []
        if not f:
            for group in ([g for g in good if g[:2] == (lang, source)], [g for g in good if g[0] == lang], good):
                if len(group) >= least_docs:
                    break
            for m in quality.MEASURES:
                v = sorted(g[2][m.name] for g in group)
                q1, q3 = rounded(v[-(-len(v) // 4) - 1], False), rounded(v[-(-3 * len(v) // 4) - 1], True)
                gap = 4 * max(q3 - q1, m.least)
                x = ratios(c)[m.name]
                if x > q3 + gap or (m.low and x < q1 - gap):
                    bad.append(m.name)
        out.append((doc_id, *c, f, not f and not bad, ",".join(bad)))
    return Counter(out)


def varied():
    rows = awkward_docs()
    for i in range(120):
        text = prose(i, 30 + i % 50)
        if i % 17 == 0:
            text += " #" * 12
        if i % 13 == 0:
            text = "\n".join([text, "a line of text"] * 2)
        if i % 23 == 0:
            text = text.replace(" ", "", 25)
        rows.append((100 + i, text, ["en", "de", None][i % 3], ["web", "book", None, "rare"][min(i % 7, 3)], 1))
    return rows


@pytest.mark.parametrize("least_docs", [1, 12, 10**6])
def test_measures_and_fences_against_brute_force(spark, least_docs):
    rows = varied()
    got = quality.judge(with_clashes(docs(spark, rows)), least_docs=least_docs).collect()
    assert Counter(tuple(r) for r in got) == verdicts(rows, least_docs)
    assert {f for r in got for f in r.failed.split(",")} > {"symbols", "word_length"}


def test_windows_that_overlap_themselves_and_span_no_texts():
    import pyarrow as pa

    half = "a b c d e f g h"
    texts = ["x " * 9, half, half, f"{half} {half}", f"{half} i {half}", "a b c d e f g", None, " \n\n "]
    assert quality.measure_texts(pa.array(texts))["n_repeat_words"].tolist() == [9, 0, 0, 16, 16, 0, 0, 0]
    assert quality.measure_texts(pa.array(["z z\nz z\n \nz z ", "\n\n"]))["n_dup_lines"].tolist() == [1, 0]


def test_merging_sketches_equals_one_sketch(spark):
    df = quality.measures(docs(spark, varied()))
    halves = [quality.sketches(df.filter(f"doc_id % 2 = {i}"), ["lang", "source"]) for i in (0, 1)]
    merged = quality.merge(halves[0].union(halves[1]), ["lang"])
    whole = quality.sketches(df.filter("doc_id is not null"), ["lang"])
    assert set(map(tuple, merged.collect())) == set(map(tuple, whole.collect()))


def test_buckets_hold_their_values(spark):
    values = spark.range(0, 5000).union(spark.range(2**40 - 3, 2**40 + 3)).toDF("v")
    from pyspark.sql import functions as F

    low, high = quality.bucket_ends(quality.bucket(F.col("v")))
    for v, a, b in values.select("v", low, high).collect():
        assert (a, b) == (rounded(v, False), rounded(v, True))


def test_empty_table_and_texts(spark):
    assert quality.judge(spark.createDataFrame([], DOC_KIND)).count() == 0
    got = quality.judge(docs(spark, [(1, None, None, None, None), (2, "", "en", "x", 0)])).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in got] == [(0, True, False)] * 2
