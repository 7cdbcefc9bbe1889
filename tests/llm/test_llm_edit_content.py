import random
from itertools import pairwise

import numpy as np
import pytest
from llm_cases import awkward_docs, docs, prose

from evalspark.llm import edit_embedding as ee
from evalspark.llm.common import mix64

WORD64 = 1 << 64


def scramble(x):
    return int(mix64(np.array([x % WORD64], np.uint64))[0])


def plain_cuts(text):
    """Bounds of the content blocks, one place at a time."""
    marks = [scramble(ord(c)) for c in text]
    cuts = [0]
    for i in range(1, len(text) + 1):
        h = sum(marks[i - 1 - k] * 0x9E3779B97F4A7C15**k for k in range(8)) if i >= 8 else 0
        if i == len(text) or i - cuts[-1] == ee.BLOCK or (i >= 8 and scramble(h) % ee.CUT_EVERY == 0):
            cuts.append(i)
    return cuts


def plain_print(text, seed=7):
    move, steps, is_later, digit = ee._walk_tables(seed)
    head, bodies = "", []
    for a, b in pairwise(plain_cuts(text)):
        block, i, row = [*ee._classes(np.array([ord(c) for c in text[a:b]], np.uint32)).tolist(), 0], 0, [0] * len(steps)
        for j in range(3 * (b - a)):
            for k in np.flatnonzero(steps == j):
                row[k] = int(digit[k, block[i]])
            i += int(move[j, block[i]])
        row = np.array(row, np.uint8)
        head = head if a else ee.to_text(row[~is_later]).rstrip("0")
        bodies.append(ee.to_text(row[is_later]).rstrip("0"))
    return ".".join([head, *bodies]) if text else ""


def test_content_prints_match_the_definition():
    texts = ["", "a", "é🎉", prose(1, 30), prose(2, 400)[:1200], "x" * 1300, *[(r[1] or "")[:700] for r in awkward_docs()], ""]
    assert ee.content_prints(texts) == [plain_print(t) for t in texts]
    assert ee.content_prints(["", ""]) == ["", ""] and ee.content_likeness("", "") == 1.0


@pytest.mark.parametrize("size", [10, 30, 50])
def test_an_early_insertion_is_paid_for_once(size):
    rng = random.Random(size)
    for i in range(8):
        t = prose(1000 + i, 3900)[:20_000]
        p = rng.randrange(200)
        a, near, cut, far = ee.content_prints([t, t[:p] + "".join(rng.choices("abcdefgh ", k=size)) + t[p:], t[size:], prose(2000 + i, 3900)])
        assert min(ee.content_likeness(a, near), ee.content_likeness(cut, a)) > 0.85 > 0.2 > ee.content_likeness(a, far)
        assert ee.content_likeness(a, near) == ee.content_likeness(near, a)


def test_next_document_with_an_inserted_sentence_is_near(spark):
    t = prose(5, 3000)
    rows = [(1, t, None, None, None), (2, t[:90] + " one more sentence, put in early. " + t[90:], None, None, None), (3, prose(6, 3000), None, None, None)]
    got = {r.doc_id: r for r in ee.with_next(docs(spark, rows)).collect()}
    assert got[1].near_next > 0.85 > 0.2 > max(got[2].near_next, got[3].near_next)
    for r in got.values():
        assert r.near_edited == ee.content_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.fingerprint == ee.content_prints([rows[r.doc_id - 1][1]])[0]


def test_near_copies_meet_wherever_they_differ(spark):
    t = prose(7, 900)
    half = len(t) // 2
    rows = [(1, t), (2, "Another title, 3 May. " + t[200:]), (3, t[:half] + " put in the middle " + t[half:]), (4, "Header\n" * 5 + t[:half] + t[half + 30:])]
    same = t[:600]  # one opening, different texts
    rows += [(10 + i, same + prose(20 + i, 900)) for i in range(6)] + [(20, prose(40, 900)), (21, "Date: today. " + prose(40, 900))]
    prints = ee.fingerprints(docs(spark, [(i, x, None, None, None) for i, x in rows]))
    held = {r.doc_id: r for r in prints.collect()}
    assert all(len(r.bands) == len(set(r.bands)) for r in held.values())
    want = {1: 1, 2: 1, 3: 1, 4: 1, 20: 20, 21: 20} | {10 + i: 10 + i for i in range(6)}
    for block_rows in (3, 256):
        assert {r.doc_id: r.component_id for r in ee.near_duplicates(prints, block_rows=block_rows).collect()} == want
