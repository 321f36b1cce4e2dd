"""Stable identifiers and the hash embedder. FNV-1a needs wrapping 64-bit arithmetic, which SQL does not
have, so these two run as Arrow-batched functions over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_START, _STEP, _ALL = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1a(data: bytes) -> int:
    h = _START
    for b in data:
        h = ((h ^ b) * _STEP) & _ALL
    return h


def symbol_id(path: str, name: str, start: int) -> str:
    """Identifier of a symbol: 16 hexadecimal digits over path, name and start."""
    return f"{fnv1a(f'{path}:{name}:{start}'.encode()):016x}"


@F.pandas_udf(T.StringType())
def _symbol_ids(path: pd.Series, name: pd.Series, start: pd.Series) -> pd.Series:
    return pd.Series([symbol_id(p, n, int(s)) for p, n, s in zip(path, name, start, strict=True)])


def symbol_ids(path: Column, name: Column, start: Column, exported: Column) -> Column:
    """Identifiers that survive edits above an exported symbol: its start counts as 0."""
    return _symbol_ids(path, name, F.when(exported, 0).otherwise(start))


def _hashes(words: list[str]) -> np.ndarray:
    """``fnv1a`` of many words at once, a byte position at a time."""
    raws = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raws])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    matrix = np.frombuffer(b"".join(raws[k].ljust(longest, b"\0") for k in order), np.uint8).reshape(len(raws), longest) if longest else np.zeros((len(raws), 0), np.uint8)
    h = np.full(len(raws), _START, np.uint64)
    for at in range(longest):
        n = int(np.searchsorted(-sizes[order], -at, side="left"))  # words longer than ``at`` come first
        h[:n] = (h[:n] ^ matrix[:n, at]) * np.uint64(_STEP)
    out = np.empty_like(h)
    out[order] = h
    return out


def _embedded(rows: list[list[str]], dim: int) -> np.ndarray:
    """Signed counts of hashed words per row, at length 1."""
    sizes = [len(r) for r in rows]
    codes, words = pd.factorize(np.array([w for r in rows for w in r], object))
    h = _hashes(list(words))
    place, sign = (h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0)
    row = np.repeat(np.arange(len(rows)), sizes)
    v = np.bincount(row * dim + place[codes], sign[codes], len(rows) * dim).reshape(len(rows), dim)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1.0)


def embed(text: str, dim: int = 64) -> list[float]:
    """Signed counts of hashed words, at length 1."""
    words = "".join(c if c.isalnum() or c in "_$" else " " for c in text).split()
    return _embedded([words], max(8, dim))[0].tolist()


def hash_embedding(dim: int = 64):
    """Column function: text to its hash embedding. Words are cut in SQL; a batch hashes each once."""
    dim = max(8, dim)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(list(_embedded([list(w) if w is not None else [] for w in words], dim)))

    return lambda text: run(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}_$]+)"), F.lit(1)))


def cache_key(model: str, text: Column) -> Column:
    """Content key of an embedding."""
    return F.sha2(F.concat(F.lit(model + "|"), F.sha2(text, 256)), 256)


def digest_id(text: Column) -> Column:
    return F.sha2(text, 256)
