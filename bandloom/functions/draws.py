"""Draws that depend on nothing but their names: the same on every executor and in every run, and in SQL."""

from __future__ import annotations

import hashlib
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf


def digest(*names: str | Column) -> Column:
    """60 bits of the digest of the names, not negative."""
    told = F.concat_ws("|", *[F.lit(n) if isinstance(n, str) else n.cast("string") for n in names])
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(*names: str | Column) -> Column:
    """Between 0 and 1, from the digest of the names: text is a literal, columns are read."""
    told = F.concat_ws("|", *[F.lit(n) if isinstance(n, str) else n.cast("string") for n in names])
    return (F.conv(F.substring(F.md5(told.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def normal(*names: str | Column) -> Column:
    """Standard normal, of two uniform draws."""
    return F.sqrt(-2 * F.ln(uniform(*names, "r"))) * F.cos(2 * pi * uniform(*names, "a"))


#: Names that are digested at once: what a step holds of them stays near the processor.
TOGETHER = 128
_STARTS = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_TURNS = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]


def _md5(words: list[np.ndarray], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of messages of one block, whose 16 words spread to ``shape``."""
    a, b, c, d = (np.full(shape, x) for x in _STARTS)
    f, high = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[at] + _SINES[i]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=high)
        f <<= np.uint32(_TURNS[i])
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + _STARTS[0], b + _STARTS[1]


def _uniforms(names: list[bytes], ends: list[bytes]) -> np.ndarray:
    """What ``uniform`` draws for names of one length, followed by each of the ends: (ends, names)."""
    n = len(names[0])
    if n + max(map(len, ends)) > 55:  # more than a block
        told = [[int(hashlib.md5(name + end).hexdigest()[:13], 16) for name in names] for end in ends]
        return (np.array(told, float) + 0.5) / 2.0**52
    tail = np.frombuffer(b"".join((bytes(n) + end + b"\x80").ljust(56, b"\0") + (8 * (n + len(end))).to_bytes(8, "little") for end in ends), "<u4").reshape(-1, 16)
    own = np.frombuffer(b"".join(name.ljust(64, b"\0") for name in names), "<u4").reshape(-1, 16)
    out = np.empty((len(ends), len(names)))
    for i in range(0, len(names), TOGETHER):
        part = own[i : i + TOGETHER].T
        # A word that is the same in all names or after all of them spreads from one row or column.
        heads = [part[w][None, :] if 4 * w < n else np.zeros((1, 1), np.uint32) for w in range(16)]
        tails = [tail[:1, w][:, None] if (tail[:, w] == tail[0, w]).all() else tail[:, w][:, None] for w in range(16)]
        a, b = _md5([x | y for x, y in zip(heads, tails, strict=True)], (len(ends), part.shape[1]))
        out[:, i : i + TOGETHER] = (a.byteswap() * 2.0**20 + (b.byteswap() >> np.uint32(12)) + 0.5) / 2.0**52
    return out


def _middle(draws: int):
    ends = [f"|{k}|{what}".encode() for what in "ra" for k in range(draws)]

    def run(names: pd.Series) -> pd.DataFrame:
        out = np.full((len(names), 3), np.nan)
        told = [x.encode() for x in names]
        sizes = np.array([len(x) for x in told])
        for size in np.unique(sizes):
            (rows,) = np.nonzero(sizes == size)
            for at in np.split(rows, range(TOGETHER, len(rows), TOGETHER)):
                u = _uniforms([told[i] for i in at], ends)
                z = np.ascontiguousarray((np.sqrt(-2 * np.log(u[:draws])) * np.cos(2 * pi * u[draws:])).T)
                out[at, 0] = z[:, 0]
                z.sort(axis=1)
                out[at, 1], out[at, 2] = z[:, (draws - 1) // 2], z[:, draws // 2]
        return pd.DataFrame(out, columns=["first", "low", "high"])

    return run


def middle(draws: int, *names: str | Column) -> Column:
    """``first, low, high``: of the draws ``normal(*names, k)`` for k from 0 on, the first and the two in the middle.

    The draws of a batch are made as whole arrays.
    """
    told = F.concat_ws("|", *[F.lit(n) if isinstance(n, str) else n.cast("string") for n in names])
    return pandas_udf(_middle(draws), "first double, low double, high double", PandasUDFType.SCALAR)(told)
