"""Shingles, MinHash signatures and LSH bands.

A shingle is 5 consecutive code points of the lower-cased, stripped text.
Its hash is a polynomial of the code points modulo the Mersenne prime
2^31-1, and permutation ``i`` maps a hash ``h`` to ``(a_i*h + b_i) mod p``.
The signature slot is the minimum over the text's shingles.  The same
arithmetic is easy to write in SQL, which is what the oracle query does.

The per-text work (hash every window, take 126 minima) runs in an Arrow
batched pandas UDF with numpy, inside the task that holds the text: no
explode of shingles, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..params import DEFAULT, Params

PRIME = 2147483647
BASE = 1000003
_PRIME = np.uint32(PRIME)
CHUNK = 4096
#: Permutations computed at a time.
BLOCK = 8


def perm_coefficients(n: int) -> tuple[list[int], list[int]]:
    """``a_i, b_i`` for permutation ``i``: a fixed linear rule, a_i never 0."""
    a = [((i + 1) * 1103515245 + 12345) % PRIME or 1 for i in range(n)]
    b = [((i + 1) * 134775813 + 1) % PRIME for i in range(n)]
    return a, b


def shingle_text(content: Column) -> Column:
    """The text the shingles are cut from: lower-cased, then stripped."""
    return py_strip(F.lower(F.coalesce(content, F.lit(""))))


def _shingles_of(text: str, k: int) -> list[str]:
    if len(text) < k:
        return [text]
    return sorted({text[i:i + k] for i in range(len(text) - k + 1)})


def shingle_set(content: Column, params: Params = DEFAULT) -> Column:
    """Distinct k-character shingles, sorted (the whole text when shorter
    than k).  Arrow-batched: a per-position ``substring`` lambda would walk
    the UTF-8 string from its start for every window."""
    k = params.shingle_size

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _set(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _shingles_of(t, k) for t in texts])

    return _set(shingle_text(content))


def shingle_count(content: Column, params: Params = DEFAULT) -> Column:
    """Number of distinct k-character shingles."""
    k = params.shingle_size

    @F.pandas_udf(T.LongType())
    def _count(texts: pd.Series) -> pd.Series:
        return pd.Series([1 if len(t) < k else len({t[i:i + k] for i in range(len(t) - k + 1)})
                          for t in texts.fillna("")], dtype="int64")

    return _count(shingle_text(content))


def _signature_of(text: str, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of ``(a_i*h + b_i) mod p`` over the text's shingle hashes ``h``.

    The coefficients grow by one step from permutation to permutation, so ``BLOCK`` permutations at a time follow from those
    before by adding a multiple of the hash that is the same for all of them: sums of 32 bits instead of products and remainders.
    A sum is below twice the prime; of it and itself less the prime (which wraps around, if negative) the smaller is the remainder."""
    cps = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    n = len(cps)
    m = max(n - k + 1, 1)
    h = np.zeros(m, dtype=np.int64)
    for j in range(min(k, n)):
        h = (h * BASE + cps[j:j + m]) % PRIME
    h = np.sort(h.astype(np.uint32))
    h = h[np.append(True, h[1:] != h[:-1])].astype(np.int64)
    best = np.full((-(-len(a) // BLOCK), BLOCK), PRIME, dtype=np.uint32)
    for s in range(0, len(h), CHUNK):
        part = h[s:s + CHUNK]
        now = np.full((BLOCK, len(part)), PRIME, dtype=np.uint32)
        first = a[:BLOCK, None]
        now[:len(first)] = (first * part + b[:BLOCK, None]) % PRIME
        step = ((a[BLOCK] - a[0]) * part + (b[BLOCK] - b[0])) % PRIME if len(a) > BLOCK else part
        step, spare = step.astype(np.uint32), np.empty_like(now)
        for row in best:
            np.minimum(row, now.min(axis=1), out=row)
            np.add(now, step, out=now)
            np.subtract(now, _PRIME, out=spare)
            np.minimum(now, spare, out=now)
    return best.ravel()[:len(a)].astype(np.int64)


def minhash_udf(num_slots: int, k: int):
    a_list, b_list = perm_coefficients(num_slots)
    a = np.array(a_list, dtype=np.int64)
    b = np.array(b_list, dtype=np.int64)
    if any(len(np.unique(np.diff(c) % PRIME)) > 1 for c in (a, b)):
        raise ValueError("the coefficients of the permutations must grow by equal steps")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _minhash(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _signature_of(t, k, a, b).tolist() for t in texts])

    return _minhash


def minhash_signature(content: Column, params: Params = DEFAULT) -> Column:
    """``array<bigint>`` of ``lsh_bands * lsh_rows`` MinHash slots."""
    slots = params.lsh_bands * params.lsh_rows
    return minhash_udf(slots, params.shingle_size)(shingle_text(content))


def lsh_bands(sig: Column, params: Params = DEFAULT) -> Column:
    """``array<struct<band int, bvals array<bigint>>>`` for ``explode``."""
    r = params.lsh_rows
    return F.array(*[
        F.struct(F.lit(i).alias("band"), F.slice(sig, i * r + 1, r).alias("bvals"))
        for i in range(params.lsh_bands)
    ])
