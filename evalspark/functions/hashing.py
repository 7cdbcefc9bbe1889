"""Portable hash-derived numbers.

``md5`` is computed identically by Spark and DuckDB, so ordering or drawing by
the first hex digits of an md5 gives the same result in both engines and is
independent of partitioning and row order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_u32(key: Column) -> Column:
    """First 8 hex digits of ``md5(key)`` as a non-negative BIGINT (0 .. 2^32-1)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def md5_bucket(key: Column, n) -> Column:
    """``md5_u32(key) mod n``; ``n`` may be an int or a Column."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(md5_u32(key), n_col.cast("bigint"))


def seeded_key(seed, *parts: Column) -> Column:
    """``seed:part1:part2...`` as a string, the input of a seeded draw."""
    return F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])


_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_ONE_BLOCK = 55          # bytes of text in a padded block of 64
_AT_ONCE = 8192          # blocks whose state stays in a core's cache


def _md5_starts(blocks: np.ndarray) -> np.ndarray:
    """First four bytes, as big-endian numbers, of the MD5 of every padded one-block text (rows of 64 bytes)."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[at]
        a, d, c, b = d, c, b, b + ((f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i])))
    return (a + np.uint32(_START[0])).byteswap()


def _numbered(head: bytes, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Padded blocks of ``head`` followed by every end (rows of bytes, 0x80 after each)."""
    blocks = np.zeros((len(ends), 64), np.uint8)
    blocks[:, :len(head)] = np.frombuffer(head, np.uint8)
    blocks[:, len(head):len(head) + ends.shape[1]] = ends
    blocks.view("<u8")[:, 7] = 8 * (len(head) + lengths)
    return blocks


def md5_buckets(keys: Column, counts: Column, n: int, salt: str = "") -> Column:
    """:func:`md5_bucket` of ``key:i`` + ``salt`` for each i from 0 to ``counts`` - 1, as an array.

    Higher-order functions are interpreted, a chain of string functions per
    element; here the texts of an Arrow batch get their digests by vector
    operations. Texts longer than one MD5 block go through ``hashlib``.
    """
    def run(key: pa.Array, count: pa.Array) -> pa.Array:
        sizes = np.maximum(count.fill_null(0).to_numpy(zero_copy_only=False), 0)
        texts = [b"%d%s" % (i, salt.encode()) for i in range(int(sizes.max(initial=0)))]
        lengths = np.array([len(x) for x in texts], np.uint64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        found = np.empty(at[-1], np.uint32)
        if texts:
            widest = int(lengths.max()) + 1
            table = np.frombuffer(b"".join((x + b"\x80").ljust(widest, b"\0") for x in texts), np.uint8).reshape(-1, widest)
        waiting, begun = [], 0
        for k, size, first in zip(key.to_pylist(), sizes.tolist(), at.tolist()):
            head = k.encode() + b":"
            for i in range(0, size, _AT_ONCE):
                some = slice(i, min(i + _AT_ONCE, size))
                if len(head) + widest - 1 <= _ONE_BLOCK:
                    waiting.append(_numbered(head, table[some], lengths[some]))
                else:       # its block is dropped below
                    waiting.append(np.zeros((some.stop - i, 64), np.uint8))
                held = first + some.stop
                if held - begun >= _AT_ONCE:
                    found[begun:held] = _md5_starts(np.concatenate(waiting))
                    waiting, begun = [], held
        if waiting:
            found[begun:] = _md5_starts(np.concatenate(waiting))
        for k, size, first in zip(key.to_pylist(), sizes.tolist(), at.tolist()):
            head = k.encode() + b":"
            if size and len(head) + widest - 1 > _ONE_BLOCK:
                found[first:first + size] = np.frombuffer(b"".join(hashlib.md5(head + x).digest()[:4] for x in texts[:size]), ">u4")
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((found % n).astype(np.int32)))

    return F.arrow_udf(run, "array<int>")(keys, counts)
