import random
from hashlib import sha256

from llm_cases import awkward_docs, classes, docs, prose, with_clashes

from evalspark.llm import edit_embedding as ee


def test_few_edits_keep_most_digits():
    rng = random.Random(1)
    for i in range(10):
        t = prose(i, 300)
        p = rng.randrange(len(t))
        a, edited_, other = ee.content_prints([t, t[:p] + "#" + t[p:], prose(100 + i, 300)])
        assert ee.content_likeness(a, edited_) > 0.75 > 0.4 > ee.content_likeness(a, other)


def edited(rows):
    rows = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        t, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        out.append((doc_id, t, t[:len(t) - k] + nxt[:k], nxt))
    return out


def test_edited_texts_and_likeness(spark):
    seen, rows = set(), []
    for r in awkward_docs():  # one row per doc_id: among repeats the order is by hash
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    for range_rows in (3, 4096):
        got = {r.doc_id: r for r in ee.with_next(with_clashes(docs(spark, rows)).repartition(4), range_rows=range_rows).collect()}
        assert len(got) == len(rows)
        for doc_id, t, new, nxt in edited(rows):
            r, (a, b, c) = got[doc_id], ee.content_prints([t, new, nxt])
            assert (r.n_chars, r.edited_sha256) == (len(t), sha256(new.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (a, b)
            assert (r.near_edited, r.near_next) == (ee.content_likeness(a, b), ee.content_likeness(a, c))


def test_repeated_ids_single_rows_and_empty_tables(spark):
    assert ee.with_next(docs(spark)).count() == len(awkward_docs())
    (r,) = ee.with_next(docs(spark, [(5, "abcdefgh", None, None, None)])).collect()
    assert r.edited_sha256 == sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert ee.with_next(docs(spark, [])).count() == 0
    assert ee.fingerprints(docs(spark, [])).count() == 0


def test_near_duplicates_by_bands_and_verification(spark):
    rows = [(50, "a short one"), (51, "a short one!"), (1, prose(1, 200)), (2, prose(1, 200) + " end"), (3, prose(2, 200)), (7, prose(2, 200)), (5, ""), (6, None), (8, prose(3, 200))]
    rows += [(100 + i, prose(9, 200) + " x" * i) for i in range(12)]
    prints = ee.fingerprints(docs(spark, [(i, t, None, None, None) for i, t in rows]))
    digits = {i: ee.content_prints([t or ""])[0] for i, t in rows}
    want = classes(digits, lambda a, b: ee.content_likeness(digits[a], digits[b]) >= 0.8)
    for block_rows in (3, 256):
        assert {r.doc_id: r.component_id for r in ee.near_duplicates(prints, block_rows=block_rows).collect()} == want
