from hashlib import sha256

from llm_cases import awkward_docs, docs, prose, with_clashes, words

from evalspark.llm import substring_dedup


def brute(rows, k):
    low = {}
    for i, t, *_ in rows:
        ws = words(t)
        for a in range(len(ws) - k + 1):
            if i is not None:
                key = tuple(ws[a:a + k])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        ws = words(t)
        gone = set()
        for a in range(len(ws) - k + 1):
            if i is not None and low[tuple(ws[a:a + k])] < i:
                gone.update(range(a, a + k))
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, k):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, k).collect()), key=str)


def test_awkward_rows_against_brute_force(spark):
    for k in (13, 4):
        assert result(with_clashes(docs(spark)).repartition(3), k) == brute(awkward_docs(), k)


def test_shared_passages_in_the_middle_overlapping_and_repeated(spark):
    a, b, c = prose(20, 60), prose(21, 60), prose(22, 25)
    rows = [(30, f"{a} {c} {b}"), (10, f"{c} {prose(23, 20)}"), (20, f"{prose(24, 30)} {a[:200]} {c} {c}"), (40, f"{b} {a} {b}"),
            (50, prose(25, 12)), (60, f"{prose(25, 12)} x"), (70, prose(26, 13)), (80, prose(26, 13)), (90, f"{c} " * 5)]
    rows = [(i, t, None, None, None) for i, t in rows]
    assert result(docs(spark, rows).repartition(4), 13) == brute(rows, 13)


def test_spans_name_their_source(spark):
    from evalspark.llm import packed

    c = prose(31, 40)
    rows = [(1, f"{prose(32, 9)} {c}", None, None, None), (2, f"{c} {prose(33, 20)}", None, None, None)]
    got = substring_dedup.repeated_spans(packed.cut_slices(docs(spark, rows))).collect()
    assert [(r.start, r.size, r.source, r.source_start) for r in got] == [(0, 40 - 12, 1, 9)]


def test_empty_table(spark):
    assert substring_dedup.dedup(docs(spark, [])).count() == 0
