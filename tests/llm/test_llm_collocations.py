import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import DOC_KIND, awkward_docs, docs, prose, with_clashes

from evalspark.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER))]


def brute(rows, least, longest, top):
    f, n, low = Counter(), Counter(), {}
    for doc_id, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for m in range(1, longest + 1):
                for i in range(len(p) - m + 1):
                    key = lang, tuple(p[i:i + m])
                    f[key] += 1
                    if doc_id is not None:
                        low[key] = min(low.get(key, doc_id), doc_id)
    often = {k: a for k, a in f.items() if a >= least}
    found = {}
    for (lang, ws), a in often.items():
        inside = any(g == lang and len(o) > len(ws) and often[g, o] >= a and any(o[i:i + len(ws)] == ws for i in range(len(o) - len(ws) + 1))
                     for g, o in often)
        if len(ws) < 2 or inside:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]])
                                    for k in range(1, len(ws)))
        found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), len(ws), left, right, low.get((lang, ws))))
    return {(lang, rank, p.decode(), m, -a, left, right, n[lang], -s, d)
            for lang, rows_ in found.items() for rank, (s, a, p, m, left, right, d) in enumerate(sorted(rows_)[:top], 1)}


def corpus():
    rows = awkward_docs()
    small = "the of to a red blue Big house, river. ran\tinto É"
    rows += [(100 + i, prose(i, 60, small) + f" it ran  over\tthe hill; x{i} y", ["en", "de", None, "und"][i % 4], "s", 1) for i in range(40)]
    return rows


def test_phrases_against_brute_force(spark):
    rows = corpus()
    for least, longest, top in ((5, 5, 10**6), (12, 3, 7)):
        want = brute(rows, least, longest, top)
        got = collocations.mine(with_clashes(docs(spark, rows)).repartition(5), least=least, longest=longest, top=top).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert {r.lang for r in got} >= {"de", "und"}


def test_colliding_fingerprints_change_nothing(spark, monkeypatch):
    rows = corpus()

    def few(self, first, n):    # a hash of a few bits: almost everything collides
        return self.words.end[first + n - 1].astype(np.uint64) * 0 + (self.words.data[self.words.start[first]] % 5).astype(np.uint64) << np.uint64(61)

    texts = [t or "" for _, t, *_ in rows[:12]]
    import pyarrow as pa

    monkeypatch.setattr(collocations.Prints, "of", few)
    count = Counter()
    blob, start = next(collocations.blobs(pa.array(texts), 1 << 30))
    words = collocations.cut_words(blob, start)
    p = collocations.Prints(words, np.zeros(1, np.uint64)[np.zeros(len(texts), int)])
    for n in (1, 3):
        first = p.runs(n)
        for b in collocations._verified(p, first, p.of(first, n), n, ["en"], np.zeros(len(texts), int), np.arange(len(texts))):
            for r in b.to_pylist():
                count[r["phrase"]] += r["c"]
    want = Counter(" ".join(q[i:i + n]) for t in texts for q in pieces(t) for n in (1, 3) for i in range(len(q) - n + 1))
    assert count == want


def test_long_texts_are_cut_at_breaks_only():
    import pyarrow as pa

    texts = [prose(9, 4000, "a b c d. e f, g"), "no break here " * 300, "", "tail end."]
    want = Counter(tuple(p) for t in texts for p in pieces(t) if p)
    for size in (64, 1000, 1 << 20):
        got, doc = Counter(), set()
        for blob, start in collocations.blobs(pa.array(texts), size):
            w = collocations.cut_words(blob, start)
            doc |= set(w.doc.tolist())
            for piece in np.unique(w.piece):
                got[tuple(w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.piece == piece], w.end[w.piece == piece]))] += 1
        assert got == want and doc == {0, 1, 3}


def test_scores_past_64_bits(spark):
    a, n, left, right = 3 * 10**9, 10**13, 4 * 10**9, 5 * 10**9
    known = spark.createDataFrame([("en", "p q", 2, a, 1), ("en", "p", 1, left, 1), ("en", "q", 1, right, 1)], "lang string, phrase string, words int, a long, first_doc_id long")
    sizes = spark.createDataFrame([("en", n)], "lang string, n long")
    assert [r.score for r in collocations.scored(known, sizes).collect()] == [1000 * a * n // (left * right)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", None, 0), (3, " .,\t", "en", None, 0)]])
def test_no_words(spark, rows):
    df = spark.createDataFrame(rows, DOC_KIND)
    assert collocations.mine(df, least=1).count() == 0


def test_filter_holds_the_frequent_fingerprints_in_parts_of_any_size(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    grams = [np.repeat(keys, rng.integers(1, 9, len(keys))) for _ in range(3)]
    total = Counter(np.concatenate(grams).tolist())
    pieces = spark.createDataFrame([r for g in grams for b in collocations._counted([g]) for r in map(lambda x: tuple(x.values()), b.to_pylist())],
                                   collocations.PIECE)
    often = np.array([k for k, c in total.items() if c >= 15], np.uint64)
    for bits, entries in ((26, 1 << 20), (26, 3), (10, 1)):
        f = collocations._filter(pieces, 15, bits, entries)
        assert f(often).all()
        want = np.zeros(1 << bits, bool)
        want[often >> np.uint64(64 - bits)] = True
        assert (f(keys) == want[keys >> np.uint64(64 - bits)]).all()
