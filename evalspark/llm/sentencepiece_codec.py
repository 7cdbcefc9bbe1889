"""SentencePiece encoding and decoding through the tokenizers library.

The model file is a protobuf message; the few fields that matter are read
from its wire format, and a tokenizers pipeline is rebuilt from them:
normaliser (identity, or the model's own character map), space marker, the
pieces with their scores (unigram lattice, or BPE with the merges that the
scores imply) and byte fallback. The sentencepiece library itself only serves
to verify parity.

Public wire format and fields (fixed values): ModelProto pieces=1,
trainer_spec=2, normalizer_spec=3; SentencePiece piece=1, score=2, type=3;
TrainerSpec model_type=3, unk_id=40; NormalizerSpec
precompiled_charsmap=2, add_dummy_prefix=3, remove_extra_whitespaces=4,
escape_whitespaces=5; piece types normal=1, unknown=2, control=3,
user_defined=4, unused=5, byte=6; model types unigram=1, bpe=2.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import text_slices

MARK = "▁"
SLICE = 8 << 20
THREADS = 2
WORDS_AT_ONCE = 2000
VERIFY_EVERY = 1         # documents checked against the sentencepiece library: crc32(doc_id) mod this is 0 (1: all)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message; varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) if kind != 2 else varint()
        if size is None:
            raise ValueError(f"wire type {kind} isn't used by model files")
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    mark_spaces: bool = True

    @property
    def byte_fallback(self) -> bool:
        return any(t == 6 for _, _, t in self.pieces)


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            if spec.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models are supported")
            m.bpe, m.unk_id = spec.get(3, 1) == 2, spec.get(40, 0)
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.squeeze, m.mark_spaces = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces in the order in which the scores apply them (best score first)."""
    score = {p: s for p, s, t in m.pieces if t in (1, 4)}
    ids = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    pairs = []
    for piece, s in score.items():
        cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
        pairs += [(-s, ids[a], ids[b], a, b) for a, b in cuts]
    return [(a, b) for *_, a, b in sorted(pairs)]


def splits_words(m: Model) -> bool:
    """Whether no piece goes on over a space, so that words can be encoded on their own."""
    return m.mark_spaces and not any(MARK in p.lstrip(MARK) for p, _, t in m.pieces if t in (1, 4))


def build(m: Model):
    """The tokenizers pipeline of a model."""
    import tokenizers as tk

    steps = [tk.normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [tk.normalizers.Replace(tk.Regex(" {2,}"), " "), tk.normalizers.Strip(left=True, right=True)]
    if m.dummy_prefix:
        steps.append(tk.normalizers.Prepend(MARK if m.mark_spaces else " "))
    if m.mark_spaces:
        steps.append(tk.normalizers.Replace(" ", MARK))
    if m.bpe:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        core = tk.models.BPE(vocab=vocab, merges=_merges(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True,
                             byte_fallback=m.byte_fallback)
    else:
        core = tk.models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    out = tk.Tokenizer(core)
    if steps:
        out.normalizer = tk.normalizers.Sequence(steps)
    if splits_words(m):
        out.pre_tokenizer = tk.pre_tokenizers.Split(tk.Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    ends = [tk.decoders.Replace(MARK, " "), tk.decoders.ByteFallback(), tk.decoders.Fuse()]
    out.decoder = tk.decoders.Sequence(ends + ([tk.decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    out.encode_special_tokens = True
    return out


@lru_cache(maxsize=2)
def _tokenizer(data: bytes, threads: int):
    """One pipeline per Python worker; the thread count holds from the worker's first batch on."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    model = parse_model(data)
    return model, build(model)


@lru_cache(maxsize=2)
def _reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def read_model(spark, path: str) -> bytes:
    """The model file's bytes: by Spark if the path names a file system, else from the driver's disk."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def expected_text(model: Model, tokenizer, text: str) -> str:
    """What decoding gives back: the normalised text, its space marks as spaces."""
    if model.charsmap or model.squeeze:
        text = tokenizer.normalizer.normalize_str(text)
        plain = text.replace(MARK, " ")
        return plain[1:] if model.dummy_prefix and plain.startswith(" ") else plain
    return text.replace(MARK, " ")


class _Encoded(NamedTuple):
    """Ids of several texts, ``ids[cuts[i]:cuts[i + 1]]``, whether decoding gives each back, and whether the library agrees."""

    ids: np.ndarray
    cuts: np.ndarray
    trip: np.ndarray
    parity: np.ndarray


def _encode_texts(texts: list[str], model: Model, tokenizer, library, threads: int) -> _Encoded:
    """Whole texts by both libraries (``library`` None: parity isn't asked)."""
    ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    back = tokenizer.decode_batch(ids, skip_special_tokens=False)
    trip = [b == expected_text(model, tokenizer, t) for b, t in zip(back, texts)]
    same = [a == b for a, b in zip(ids, library.encode(texts, num_threads=threads))] if library and texts else [False] * len(texts)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)
    return _Encoded(np.fromiter((x for row in ids for x in row), np.int32, cuts[-1]), cuts, np.array(trip, bool), np.array(same, bool))


def _encode_words(words: list[str], starts: np.ndarray, model: Model, tokenizer, library, threads: int) -> _Encoded:
    """Distinct words by both libraries, many at a time with spaces between.

    A word's first piece is the one that begins with the space mark
    (``starts``), so the pieces of a run of words fall apart into theirs. A
    run that doesn't come out right as a whole (number of words, decoded text,
    parity) is done word by word.
    """
    runs = [words[a:a + WORDS_AT_ONCE] for a in range(0, len(words), WORDS_AT_ONCE)]
    texts = [" ".join(r) for r in runs]
    ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    back = tokenizer.decode_batch(ids, skip_special_tokens=False)
    wanted = library.encode(texts, num_threads=threads) if library else ids
    parts = []
    for run, text, row, plain, want in zip(runs, texts, ids, back, wanted):
        flat = np.array(row, np.int32)
        first = np.flatnonzero(starts[flat])
        if len(first) != len(run) or plain != text or want != row:
            parts.append(_encode_texts(run, model, tokenizer, library, threads))
            continue
        good = np.ones(len(run), bool)
        parts.append(_Encoded(flat, np.append(first, len(flat)), good, good))
    ends = np.cumsum([0] + [len(p.ids) for p in parts])
    return _Encoded(np.concatenate([p.ids for p in parts]), np.concatenate([p.cuts[:-1] + e for p, e in zip(parts, ends)] + [ends[-1:]]),
                    np.concatenate([p.trip for p in parts]), np.concatenate([p.parity for p in parts]))


def _gather(source: _Encoded, codes: np.ndarray, offsets: np.ndarray) -> _Encoded:
    """Texts put together from their words: text i has the words ``codes[offsets[i]:offsets[i + 1]]`` of ``source``."""
    size = np.diff(source.cuts)[codes]
    ends = np.cumsum(size)
    at = np.repeat(source.cuts[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))

    def all_of(ok: np.ndarray) -> np.ndarray:
        return np.bincount(doc[~ok[codes]], minlength=len(offsets) - 1) == 0

    return _Encoded(source.ids[at], np.concatenate([[0], ends])[offsets], all_of(source.trip), all_of(source.parity))


def _by_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(which texts are words with single spaces between, distinct words, word codes and offsets of those texts).

    The space mark and a second, a leading or a trailing space make a text
    one that is encoded as a whole.
    """
    lists = pc.split_pattern(texts, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = flat.dictionary_encode()
    words = coded.dictionary
    odd = pc.or_(pc.equal(words, ""), pc.match_substring(words, MARK)).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype(np.int64)
    plain = np.bincount(doc[odd[codes]], minlength=len(texts)) == 0
    codes = codes[plain[doc]]
    used = np.bincount(codes, minlength=len(words)) > 0
    codes = (np.cumsum(used) - 1)[codes]
    return plain, words.filter(pa.array(used)), codes, np.concatenate([[0], np.cumsum(np.diff(offsets)[plain])])


def encode(docs: DataFrame, model: bytes, threads: int = THREADS, verify_every: int = VERIFY_EVERY, by_words: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, round_trip, parity) of every row of ``docs`` (doc_id, text).

    ``ids`` are the piece ids of the whole text (null: empty), without
    control pieces; text that looks like one is ordinary text. ids_sha256 is
    over the ids as little-endian 32-bit integers. round_trip: decoding gives
    the normalised text back. parity: the sentencepiece library gives the
    same ids; it's asked for every document whose crc32(doc_id as text) is
    divisible by ``verify_every`` (1: all, 0: none), null for the rest. One
    row per input row; a null doc_id is kept; other columns aren't read.

    If the model marks spaces, adds one in front, changes nothing else in a
    text and has no piece that goes on over a space, a text's ids are those
    of its words one after the other. Then (``by_words``) each distinct word
    of a slice is encoded, decoded and compared once, and texts are put
    together from their words. Texts with other than single spaces between
    words are encoded as a whole.
    """
    kind = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, tok = _tokenizer(shared.value, threads)
        library = _reference(shared.value) if verify_every else None
        apart = (by_words and splits_words(parsed) and parsed.dummy_prefix and not parsed.squeeze and not parsed.charsmap
                 and any(p == MARK for p, _, t in parsed.pieces if t in (1, 4)))

        starts = np.array([p.startswith(MARK) for p, _, _ in parsed.pieces])

        def rows(part: pa.RecordBatch, got: _Encoded) -> pa.RecordBatch:
            asked = part.column("crc").to_numpy() % verify_every == 0 if verify_every else np.zeros(part.num_rows, bool)
            little = got.ids.astype("<i4")
            sha = [sha256(little[a:b].tobytes()).hexdigest() for a, b in zip(got.cuts, got.cuts[1:])]
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(got.cuts, pa.int32()), pa.array(got.ids)),
                 pa.array(np.diff(got.cuts)), pa.array(sha, pa.string()), pa.array(got.trip), pa.array(got.parity, mask=~asked)],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "round_trip", "parity"])

        for part in text_slices(batches, max_bytes=SLICE):
            texts = pc.fill_null(part.column("text"), "")
            whole = np.ones(part.num_rows, bool)
            if apart:
                plain, words, codes, offsets = _by_words(texts)
                whole = ~plain
                if plain.any():
                    yield rows(part.filter(pa.array(plain)), _gather(_encode_words(words.to_pylist(), starts, parsed, tok, library, threads), codes, offsets))
            if whole.any():
                yield rows(part.filter(pa.array(whole)), _encode_texts(texts.filter(pa.array(whole)).to_pylist(), parsed, tok, library, threads))

    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), crc.alias("crc")).mapInArrow(run, kind))


def decode(encoded: DataFrame, model: bytes, threads: int = THREADS) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null or empty ids give an empty text, unknown ids nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tok = _tokenizer(shared.value, threads)
        for batch in batches:
            ids = [[x for x in r or [] if x is not None] for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tok.decode_batch(ids, skip_special_tokens=False), pa.string())],
                                             ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
