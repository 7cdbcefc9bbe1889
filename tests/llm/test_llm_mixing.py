import re
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import awkward_docs, docs, prose, with_clashes

from evalspark.llm import mixing


def brute(rows, flatten, given=None, sweeps=400):
    cells = defaultdict(float)
    for _, text, lang, source, _ in rows:
        topic = next((n for n, p in mixing.TOPICS if p in (text or "")), mixing.DEFAULT_TOPIC)
        cells[source, lang, topic] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total = sum(cells.values())
    factor = [defaultdict(lambda: 1.0) for _ in range(3)]
    share = []
    for i, d in enumerate(mixing.DIMENSIONS):
        have = defaultdict(float)
        for c, n in cells.items():
            have[c[i]] += n
        raw = {k: (given or {}).get(d, {}).get(k, 0.0) if d in (given or {}) else (n / total) ** flatten[d] for k, n in have.items() if n}
        share.append({k: v / sum(raw.values()) for k, v in raw.items()})
    weight = lambda c: factor[0][c[0]] * factor[1][c[1]] * factor[2][c[2]]
    for _ in range(sweeps):
        for i in range(3):
            have = defaultdict(float)
            for c, n in cells.items():
                have[c[i]] += n / total * weight(c)
            for k in have:
                factor[i][k] = factor[i][k] * share[i].get(k, 0.0) / have[k] if have[k] else 0.0
    return {c: weight(c) for c in cells}, cells, share


def corpus():
    rows = [r for r in awkward_docs() if r[0] != 11 and r[2] != "fr" and not (r[1] or "").startswith("...")]  # else targets contradict
    for i in range(120):
        extra = (" | a | b", " License text", " me@x", "")[i % 4 if i % 3 else 3]
        rows.append((1000 + i, prose(i, 20 + i % 50) + extra, ("en", "de", None)[i % 5 % 3], ("web", "web", "book", None)[i % 7 % 4], None))
    return rows


@pytest.mark.parametrize("given", [None, {"lang": {"en": 0.5, "de": 0.25, None: 0.25}}])
def test_weights_meet_marginals_as_in_brute_force(spark, given):
    rows = corpus()
    want, cells, share = brute(rows, mixing.FLATTEN, given)
    got = mixing.draw(with_clashes(docs(spark, rows)), targets=given, tolerance=1e-12, max_sweeps=60).collect()
    assert len(got) == len(rows)
    top = max(w for c, w in want.items() if cells[c])
    for r in got:
        c = (r["row"].source, r["row"].lang, r.topic)
        assert r.weight == pytest.approx(want[c], abs=1e-6)
        assert r.prob == pytest.approx(min(1, want[c] / top), abs=1e-6)
    for i, name in enumerate(("source", "lang")):  # expected token shares are the targets
        total = sum(r.prob * r.n_tokens for r in got if r.weight)
        for k, s in share[i].items():
            mine = sum(r.prob * r.n_tokens for r in got if r["row"][name] == k)
            assert mine / total == pytest.approx(s, abs=1e-6)


def test_draw_follows_the_probabilities_and_is_repeatable(spark):
    rows = [(i, "a b c", "en", "big" if i % 10 else "small", None) for i in range(4000)]
    take = lambda: {r["row"].doc_id for r in mixing.draw(docs(spark, rows), flatten={"source": 0.0, "lang": 1.0, "topic": 1.0}).filter("sampled").collect()}
    a = take()
    assert a == take()
    assert sum(i % 10 == 0 for i in a) == 400
    assert abs(sum(i % 10 > 0 for i in a) - 400) < 5 * np.sqrt(400)


def test_awkward_rows_all_come_back(spark):
    got = mixing.draw(with_clashes(docs(spark))).collect()
    assert len(got) == len(awkward_docs()) and all(0 <= r.prob <= 1 for r in got)


def test_tables_without_rows_or_tokens(spark):
    assert mixing.draw(docs(spark, [])).count() == 0
    assert [(r.n_tokens, r.prob) for r in mixing.draw(docs(spark, [(1, None, "en", "x", 0)])).collect()] == [(0, 1.0)]
