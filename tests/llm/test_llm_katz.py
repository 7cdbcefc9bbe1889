import functools
import math
from collections import Counter, defaultdict

import pytest
from llm_cases import awkward_docs, docs, prose, with_clashes

from evalspark.llm import katz


def model(rows, order):
    """Katz model in dictionaries: (training tokens, types, probability function, per-row scores)."""
    seqs = [[w for w in (t or "").encode().lower().split()] + [b""] for _, t, *_ in rows]
    n = [Counter() for _ in range(order + 1)]
    for (i, *_), s in zip(rows, seqs):
        if not katz.is_held_out(i):
            pad = [None] * (order - 1) + s
            for j in range(order - 1, len(pad)):
                for k in range(1, order + 1):
                    n[k][tuple(pad[j - k + 1:j + 1])] += 1
    tokens, d = sum(n[1].values()), [None]
    for k in range(1, order + 1):
        h = Counter(min(c, 6) for c in n[k].values())
        d.append(katz.good_turing([h[r] for r in range(1, 7)]))
    unknown = 1 - sum(d[1][min(c, 6)] * c for c in n[1].values()) / tokens
    after = defaultdict(list)
    for k in range(2, order + 1):
        for g, c in n[k].items():
            after[g[:-1]].append((g[-1], c))

    @functools.cache
    def context(c):
        if c not in after:
            return 1.0, 0
        total, kept = sum(x for _, x in after[c]), sum(d[len(c) + 1][min(x, 6)] * x for _, x in after[c])
        total += abs(total - kept) < 1e-9
        return (1 - kept / total) / (1 - sum(p(c[1:], w) for w, _ in after[c])), total

    @functools.cache
    def p(c, w):
        x = n[len(c) + 1][c + (w,)]
        if not c:
            return d[1][min(x, 6)] * x / tokens if x else unknown
        alpha, total = context(c)
        return d[len(c) + 1][min(x, 6)] * x / total if x else alpha * p(c[1:], w)

    base = lambda w: math.log10((n[1][(w,)] + 0.5) / (tokens + 0.5 * (len(n[1]) + 1)))
    out = []
    for s in seqs:
        pad = [None] * (order - 1) + s
        out.append((len(s), sum((w,) in n[1] for w in s), sum(map(base, s)),
                    sum(math.log10(p(tuple(pad[j - order + 1:j]), pad[j])) for j in range(order - 1, len(pad)))))
    return tokens, [w for (w,) in n[1]], p, after, out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_dictionaries(spark, order):
    rows = [r for r in awkward_docs() if r[0] != 11] + [(100 + i, prose(i, 40 + i), None, None, None) for i in range(40)]
    tokens, vocabulary, p, after, want = model(rows, order)
    got = katz.score(with_clashes(docs(spark, rows)).repartition(3), order, slice_bytes=2000).collect()
    assert {r.train_tokens for r in got} == {tokens}
    key = lambda x: (str(x[0]), x[1:])
    a = sorted([(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6), r.held_out) for r in got], key=key)
    b = sorted([(i, *w[:2], round(w[2], 6), round(w[3], 6), katz.is_held_out(i)) for (i, *_), w in zip(rows, want)], key=key)
    assert [x[:3] + x[5:] for x in a] == [x[:3] + x[5:] for x in b]
    assert all(abs(x[3] - y[3]) < 2e-6 and abs(x[4] - y[4]) < 2e-6 for x, y in zip(a, b))
    for c in [c for c in after if len(c) == order - 1][:20]:  # every distribution sums to 1, the unknown word included
        assert math.isclose(sum(p(c, w) for w in vocabulary) + p(c, "unknown"), 1, abs_tol=1e-9)


def test_discounts():
    assert katz.good_turing([0] * 6) == [0.0, 0.5, 0.75, 2.5 / 3, 0.875, 0.9, 1.0]
    d = katz.good_turing([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1.0 and d[1] < d[2] < d[4]


def test_empty_and_untrained_tables(spark):
    assert katz.score(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if katz.is_held_out(i))
    (r,) = katz.score(docs(spark, [(held, "a b", None, None, None)])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score) and math.isclose(r.base_score, 0)
