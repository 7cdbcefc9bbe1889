"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import math
import os

import pytest
import sentencepiece
from llm_cases import DOC_KIND, classes, prose
from pyspark.sql import functions as F
from test_llm_mixing import brute as mixing_brute
from test_llm_models import toxic_corpus
from test_llm_secrets import TEXTS
from test_llm_secrets import brute as spans_of
from test_llm_simhash import brute_fp

import corpus_pipeline
from evalspark.llm import mixing, toxicity
from evalspark.llm.queries import MODEL_PATH

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = toxic_corpus(400)
    rows = [(i, t, ("en", "de")[i % 2], ("web", "book")[i % 3 % 2], None) for i, t, *_ in rows]
    rows += [(1000 + i, t, "en", "web", None) for i, t in enumerate(TEXTS)]
    copy = prose(77, 90)
    rows += [(2000 + i, copy, "en", "book", len(copy)) for i in range(5)] + [(2010, None, None, "web", None), (2011, "", "de", None, 0)]
    spark.createDataFrame(rows, DOC_KIND).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    return path


def plain_score(text, model):
    clean, sentence = 1.0, []

    def close():
        nonlocal clean
        if sentence:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for w in sentence for f in toxicity._features(w)))))
            sentence.clear()

    for w in (text or "").split():
        sentence.append(w.strip(toxicity.PUNCTUATION).lower())
        if w.rstrip("\"')]»”’")[-1:] in (".", "!", "?", "…"):
            close()
    close()
    return 1 - clean


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = [tuple(r) for r in docs.collect()]
    model = toxicity.fit(docs, toxicity.train_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        frames[name] = docs
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
            rows = sorted(tuple(r) for r in docs.collect())
        if name == "toxicity":
            want = sorted(r for r in at if plain_score(r[1], model) < 0.3)
        elif name == "simhash_near_dedup":
            fp = {r[0]: brute_fp(r[1]) for r in at}
            root = classes(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
            want = sorted(r for r in at if root[r[0]] == r[0])
        elif name == "secret_scan":
            def masked(text):
                if not text or not spans_of(text)[3]:
                    return text
                out, end = "", 0
                for a, _, _, b in spans_of(text)[3]:
                    if a >= end:
                        out += text[end:a] + "[SECRET]"
                    end = max(end, b)
                return out + text[end:]

            want = sorted((i, masked(t), lang, s, (len(masked(t)) if t and masked(t) != t else n)) for i, t, lang, s, n in at)
            rows = [r if r[4] is not None or w[4] is None else r for r, w in zip(rows, want)]
        elif name == "source_mixing":
            weight, cells, _ = mixing_brute(at, mixing.FLATTEN)
            top = max(w for c, w in weight.items() if cells[c])
            ids = spark.createDataFrame([(r[0],) for r in at], "doc_id long")
            u = {r.doc_id: r.u for r in ids.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) / float(1 << 53)).collect()}
            topic = lambda t: next((n for n, p in mixing.TOPICS if p in (t or "")), mixing.DEFAULT_TOPIC)
            want = sorted(r for r in at if u[r[0]] < weight[r[3], r[2], topic(r[1])] / top)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
            assert sorted((r.doc_id, r.ids) for r in docs.collect()) == sorted((r[0], sp.encode(r[1] or "")) for r in at)
            break
        assert [r[:2] for r in rows] == [w[:2] for w in want], name
        at = rows
    assert 0 < len(at) < 400
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids) for r in again) == sorted((r.doc_id, r.ids) for r in frames["sentencepiece"].collect())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOC_KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
