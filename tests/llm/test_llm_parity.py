import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from llm_cases import awkward_docs, docs, prose

import corpus_pipeline
from evalspark.llm import sentencepiece_codec
from evalspark.llm.queries import MODEL_PATH, QUERIES


def test_query_and_last_stage_ask_parity_for_every_document(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": [prose(i, 20) for i in range(40)]}), tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for out in (QUERIES["op9_sentencepiece"](spark, str(tmp_path)), corpus_pipeline.encode_pieces(spark, docs, str(tmp_path))):
        assert [r.parity for r in out.collect()] == [True] * 40


def test_word_by_word_equals_whole_texts(spark):
    """Ids, hashes, round trip and parity are those of the per-document way, for texts of every kind of spacing."""
    rng = random.Random(8)
    odd = ["", " ", "a", "a ", " a", "a  b", "a b", "\u2581", "a \u2581 b", "x\u2581y z", "\n a\tb \n", "a\u00a0b \u3000 c", "\u65e5\u672c \u8a9e\U0001f389 \u200d x",
           "<s> </s> <0x41> <unk>", "\x00 \x01z", "z" * 5000 + " " + "z" * 5000, "e\u0301 \u00e9", "word " * 3000 + "end", "don't can't", "\ufeffbom x"]
    letters = "abc .,\n\t\u00e9\u65e5\U0001f600 <>0"
    rows = [(i, t, None, None, None) for i, t in enumerate([*odd, None, *("".join(rng.choices(letters, k=rng.randint(0, 200))) for _ in range(300))])]
    rows += [(1000 + i, prose(i, 60), None, None, None) for i in range(50)] + [*awkward_docs()]
    with open(MODEL_PATH, "rb") as f:
        model = f.read()
    for every in (1, 3, 0):
        got, want = (Counter(map(str, sentencepiece_codec.encode(docs(spark, rows), model, verify_every=every, by_words=w).collect())) for w in (True, False))
        assert got == want


def test_a_wrong_word_shows_in_its_texts_only(spark, monkeypatch):
    data = pa.array(["good bad", "good good", "bad"])
    plain, words, codes, offsets = sentencepiece_codec._by_words(data)
    assert plain.all() and words.to_pylist() == ["good", "bad"]
    source = sentencepiece_codec._Encoded(np.array([5, 6, 7], np.int32), np.array([0, 2, 3]), np.array([True, True]), np.array([True, False]))
    got = sentencepiece_codec._gather(source, codes, offsets)
    assert got.ids.tolist() == [5, 6, 7, 5, 6, 5, 6, 7] and got.cuts.tolist() == [0, 3, 7, 8]
    assert got.parity.tolist() == [False, True, False] and got.trip.all()


def test_runs_of_words_that_fail_are_done_word_by_word():
    with open(MODEL_PATH, "rb") as f:
        data = f.read()
    model, tok = sentencepiece_codec._tokenizer(data, 2)
    starts = np.array([p.startswith("\u2581") for p, _, _ in model.pieces])

    class Wrong:
        """A library that disagrees about one word, wherever it stands."""

        def encode(self, texts, num_threads):
            good = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            return [ids[:-1] if "odd" in t.split(" ") else ids for ids, t in zip(good, texts)]

    words = [f"w{i}" for i in range(sentencepiece_codec.WORDS_AT_ONCE + 30)]
    words[7] = "odd"
    got = sentencepiece_codec._encode_words(words, starts, model, tok, Wrong(), 2)
    want = sentencepiece_codec._encode_texts(words, model, tok, Wrong(), 2)
    assert all((a == b).all() for a, b in zip(got, want)) and got.parity.sum() == len(words) - 1 and not got.parity[7]
