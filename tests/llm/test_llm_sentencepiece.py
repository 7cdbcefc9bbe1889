import random
import struct

import pytest
import sentencepiece
from llm_cases import awkward_docs, docs, prose, with_clashes

from evalspark.llm import sentencepiece_codec as codec
from evalspark.llm.queries import MODEL_PATH

ODD = ["", " ", "  a  b ", "▁x", "a▁▁ b", "<s> </s> <unk> <0x41>", "\x00z", "x" * 3000, "日本語 🎉‍", "tab\tnew\n\nline", "trail ", "é" * 50, "﻿bom"]


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) if number < 16 else bytes([(number << 3) & 0x7F | 0x80, number >> 4])
            while value > 0x7F:
                out, value = out + bytes([value & 0x7F | 0x80]), value >> 7
            out += bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            size, head = len(value), b""
            while size > 0x7F:
                head, size = head + bytes([size & 0x7F | 0x80]), size >> 7
            out += bytes([number << 3 | 2]) + head + bytes([size]) + value
    return out


def unigram_model():
    """A small unigram model with byte fallback, written field by field."""
    rng = random.Random(3)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    texts = {"▁", *"abcdefgh"} | {"".join(rng.choices("abcdefgh", k=rng.randint(2, 4))) for _ in range(60)}
    texts |= {"▁" + t for t in list(texts) if "▁" not in t}
    pieces += [(t, -rng.uniform(1, 9) - 0.5 * len(t), 1) for t in sorted(texts)]
    body = [(1, message([(1, p.encode()), (2, s), (3, k)])) for p, s, k in pieces]
    return message(body + [(2, message([(3, 1), (35, 1)])), (3, message([(1, b"identity"), (3, 1), (4, 1), (5, 1)]))])


@pytest.fixture(scope="module")
def model():
    with open(MODEL_PATH, "rb") as f:
        return f.read()


def test_parity_with_the_sentencepiece_library(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    parsed = codec.parse_model(model)
    assert len(parsed.pieces) == sp.get_piece_size() and all(sp.id_to_piece(i) == p for i, (p, _, _) in enumerate(parsed.pieces))
    tok = codec.build(parsed)
    texts = ODD + [prose(i, 80) for i in range(30)]
    assert [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)] == sp.encode(texts)


def test_unigram_parity_with_squeezed_spaces():
    data = unigram_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    tok = codec.build(codec.parse_model(data))
    rng = random.Random(4)
    texts = ["abc defg", "", "  a  b ", "aé b", "hgfedcba" * 40] + [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20)) for _ in range(40)]
    assert [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)] == sp.encode(texts)


def test_round_trip_of_awkward_rows(spark, model):
    rows = awkward_docs() + [(200 + i, t, None, None, None) for i, t in enumerate(ODD)]
    out = codec.encode(with_clashes(docs(spark, rows)), model, verify_every=1)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.parity for r in got)
    assert all(len(r.ids) == r.n_tokens for r in got)
    back = codec.decode(out, model).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted([(i, (t or "").replace("▁", " ")) for i, t, *_ in rows], key=str)
    assert codec.encode(docs(spark, []), model).count() == 0
    assert [r.text for r in codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), model).collect()] == ["", ""]


def test_wire_format_errors():
    with pytest.raises(ValueError):
        codec.parse_model(message([(2, message([(3, 3)]))]))
    with pytest.raises(ValueError):
        list(codec._fields(b"\x0b"))
