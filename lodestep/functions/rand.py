"""Portable randomness: md5 buckets that any SQL engine can reproduce."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def h(seed: int | str, *key: Column) -> Column:
    """A whole number below 2**32 from the seed and the key columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def sql_h(seed: int | str, *key: str) -> str:
    """The same in DuckDB SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in key]])
    return f"cast(('0x' || substr(md5({text}), 1, 8)) as bigint)"


def u(seed: int | str, *key: Column) -> Column:
    """Uniform in [0, 1)."""
    return h(seed, *key) / F.lit(float(2**32))


_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each padded 64-byte message, as its first eight hexadecimal digits read."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += np.uint32(_K[i])
        s = _TURN[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return (a + np.uint32(0x67452301)).byteswap().astype(np.int64)


def _messages(prefix: bytes, first: int, n: int) -> np.ndarray:
    """``prefix`` and each of the whole numbers first .. first + n - 1, padded as MD5 pads a message that fits one block."""
    out, at, low = np.zeros((n, 64), np.uint8), len(prefix), first
    out[:, :at] = np.frombuffer(prefix, np.uint8)
    while low < first + n:
        width = len(str(low))
        high = min(first + n, 10**width)
        rows, i = out[low - first : high - first], np.arange(low, high)
        for j in range(width):
            rows[:, at + j] = 48 + i // 10 ** (width - 1 - j) % 10
        rows[:, at + width] = 128
        rows[:, 56:58] = np.frombuffer(((at + width) * 8).to_bytes(2, "little"), np.uint8)
        low = high
    return out


def hashes(n: Column, seed: int | str, key: Column, first: int = 0) -> Column:
    """``h(seed, key, i)`` of the ``n`` indexes from ``first`` on, as an array: hashed many at a time, where a lambda would hash and read them one by one."""
    def run(counts: pa.Array, keys: pa.Array) -> pa.Array:
        counts = np.maximum(pc.fill_null(counts, 0).to_numpy(zero_copy_only=False), 0)
        waiting, size, out = [], 0, []
        for n, k in zip(counts.tolist(), keys.to_pylist(), strict=True):
            prefix = f"{seed}:{k}:".encode() if k is not None else f"{seed}:".encode()
            if len(prefix) > 40:  # does not fit one block
                if waiting:
                    out.append(_md5_heads(np.concatenate(waiting)))
                    waiting, size = [], 0
                out.append(np.array([int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:8], 16) for i in range(first, first + n)], np.int64))
                continue
            for at in range(0, n, 1 << 13):
                waiting.append(_messages(prefix, first + at, min(n - at, 1 << 13)))
                size += len(waiting[-1])
                if size >= 1 << 13:
                    out.append(_md5_heads(np.concatenate(waiting)))
                    waiting, size = [], 0
        if waiting:
            out.append(_md5_heads(np.concatenate(waiting)))
        values = np.concatenate(out) if out else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))

    return F.arrow_udf(run, "array<long>")(n.cast("int"), key.cast("string"))
