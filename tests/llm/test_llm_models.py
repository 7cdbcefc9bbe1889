import random

import numpy as np
from llm_cases import awkward_docs, docs, with_clashes
from pyspark.sql import functions as F

from evalspark.llm import common, langid, toxicity

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "ch ei un te ge ver en sch lich ü", "fr": "ou le eau é è la tion que ment eux"}


def text_of(lang, seed, n=60):
    rng = random.Random(seed)
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n=160):
    langs = list(SYLLABLES)
    return [(i, text_of(langs[i % 3], i), langs[i % 3], "web", None) for i in range(n)]


def brute_bundle(text, dim, order):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = ([0] if not letters[:1].isalpha() else []) + [ord(c) for c in " ".join(letters.split())]
    letters = [0 if c == 32 else c for c in letters] + [0]
    out = np.zeros(dim)
    for i in range(len(letters) - order + 1):
        v = np.ones(dim)
        for j in range(order):
            v = v * np.roll(langid.letter_vector(letters[i + j], dim), order - 1 - j)
        out += v
    return out


def test_bundles_match_the_definition():
    texts = ["Abc dé, fgh!", "  x yz", "", None, "1 2 3", "ab" * 300]
    got, n = langid._Space(64, 3).bundles(texts)
    for t, v in zip(texts, got):
        if any(c.isalpha() for c in t or ""):
            assert np.array_equal(v, brute_bundle(t, 64, 3)), t
    assert n.tolist() == [8, 3, 0, 0, 0, 600]


def test_language_of_held_out_documents_and_awkward_rows(spark):
    df = docs(spark, corpus())
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    profiles = langid.fit(df, ~held)
    assert sorted(profiles) == sorted(SYLLABLES)
    got = {r.doc_id: r for r in langid.predict(df, profiles).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, *_ in corpus())
    odd = langid.predict(with_clashes(docs(spark)), profiles).collect()
    assert len(odd) == len(awkward_docs())
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {4, 5, 6, 9, None}
    assert all(0 <= r.score <= 1 for r in odd)
    assert langid.predict(docs(spark, []), profiles).count() == 0
    assert {r.lang_pred for r in langid.predict(docs(spark), langid.fit(docs(spark, []), F.lit(True))).collect()} == {"und"}


def toxic_corpus(n=1200):
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        sentences = [text_of("en", 10_000 + 7 * i + j, 9) for j in range(rng.randint(1, 12))]
        bad = i % 6 == 0
        if bad:
            for j in rng.sample(range(len(sentences)), max(1, len(sentences) // 3)):
                sentences[j] = sentences[j].replace(" ", f" {rng.choice(['vermin', 'zorkish', 'zorkoid', 'zork' + str(i)])} ", 1)
        rows.append((i, " ".join(sentences), "en", "web", None))
        if i % 10 < 8:
            labels.append((i, 1, int(bad)))
    return rows, labels + [(None, 1, 1), (3, 1, None), (10**6, 0, 1)]


def test_toxicity_on_held_out_documents_and_offending_sentences(spark):
    rows, labels = toxic_corpus()
    df, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, toxicity.train_labels(marks))
    got = {r.doc_id: r for r in toxicity.score(with_clashes(df), model).collect()}
    right = sum(got[i].predicted == (i % 6 == 0) for i in range(len(rows)))
    assert right >= 0.985 * len(rows)
    for i, text, *_ in rows[:240:6]:
        words = text.split()
        for s in got[i].offending:
            assert any(w.lower().strip(".").startswith(("vermin", "zork")) for w in words[s.start:s.end])
    kept = toxicity.clean(with_clashes(df), model)
    assert kept.columns == with_clashes(df).columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}
    odd = toxicity.score(with_clashes(docs(spark)), model).collect()
    assert len(odd) == len(awkward_docs()) and all(r.score == 0 for r in odd if r.doc_id in (4, 5, 6))


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs(spark), none) is None
    assert {r.score for r in toxicity.score(docs(spark), None).collect()} == {0.0}
    assert toxicity.clean(docs(spark), None).count() == len(awkward_docs())
    assert toxicity.score(docs(spark, []), None).count() == 0


def test_noisy_or_gradient_finds_the_shared_feature():
    theta = toxicity._descend(np.array([1, 1, 1, 0, 0, 0]), np.array([4, 4, 4, 4, 4, 4]), [[[0]], [[0], [1]], [[0, 1]], [[1]], [[1]], []], 2)
    assert theta[0] > theta[1] + 3
