import numpy as np
import pytest
import xxhash
from llm_cases import awkward_docs, classes, docs, prose, with_clashes, words

from evalspark.llm import simhash


def brute_fp(text, k=3):
    ws = [w.lower() for w in words(text)]
    if not ws:
        return 0
    grams = [b" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_classes_of_awkward_rows(spark):
    got = simhash.near_duplicates(with_clashes(docs(spark))).collect()
    rows = [(r[0], brute_fp(r[1])) for r in awkward_docs() if r[0] != 11]
    assert sorted(((r.doc_id, r.fp % 2**64) for r in got if r.doc_id != 11), key=str) == sorted(rows, key=str)
    everything = [(r.doc_id, r.fp % 2**64) for r in got]
    root = classes({f for _, f in everything}, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, f in everything:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, low.get(root[f])) for i, f in everything}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("max_bits", [0, 1, 3, 5])
def test_links_find_every_class_even_in_hot_lists(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    seeds = rng.integers(0, 2**63, 12, dtype=np.int64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(15):  # a chain of flips, so classes are wider than the distance
            s = s ^ np.int64(1 << int(rng.integers(0, 62)))
            fps.add(int(s))
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), max_bits, block_rows=4).collect()
    linked = lambda a, b: ((a ^ b) % 2**64).bit_count() <= max_bits
    assert all(linked(r.a, r.b) or max_bits for r in got)
    pairs = {(r.a, r.b) for r in got} | {(r.b, r.a) for r in got}
    assert classes(fps, linked) == classes(fps, lambda a, b: (a, b) in pairs)


def test_masks_cover_every_choice_of_differing_bytes():
    from itertools import combinations

    for d in range(8):
        masks = [m % 2**64 for m in simhash._masks(d)]
        for bad in combinations(range(8), d):
            diff = sum(0xFF << 8 * p for p in bad)
            assert any(m & diff == 0 for m in masks)


def test_keep_one_keeps_the_smallest_of_each_group_and_all_columns(spark):
    base = prose(9, 80)
    rows = [(5, base, "en", "a", 1), (3, base, "de", "b", 2), (3, base, "de", "b", 2), (9, prose(10, 80), None, None, None), (None, base, "x", "y", 1)]
    out = simhash.keep_one(with_clashes(docs(spark, rows)))
    assert out.columns == with_clashes(docs(spark, rows)).columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 3, 9]
