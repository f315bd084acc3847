"""A keyed permutation of whole numbers, as a column expression, in NumPy and as SQL.

A number below a * b is a pair of digits, the first below a, the second below b. Each
round adds to one digit a mixed image of the other, modulo its own base, and swaps them:
every round can be undone, so the whole is a permutation whatever the keys are. The k-th
pair of a product in random order thus costs no more than k's own rounds, and distinct
numbers give distinct pairs. For numbers below n that is no product, digits cover a few
more than n, and an image outside is permuted again until it falls inside.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
_MASK = (1 << 31) - 1
# Fixed odd multipliers and shifts of the mixing function, small enough for products in 64 bits.
_M1, _M2, _S1, _S2, _S3 = 739982445, 695872825, 15, 12, 15


def round_keys(seed: str) -> list[int]:
    return [zlib.crc32(f"{seed}|{r}".encode()) & _MASK for r in range(ROUNDS)]


def mix(v: Column) -> Column:
    """A number below 2^31 from one below 2^31, every bit of which counts."""
    for shift, factor in ((_S1, _M1), (_S2, _M2), (_S3, 1)):
        v = v.bitwiseXOR(F.shiftright(v, shift))
        v = (v * factor).bitwiseAND(F.lit(_MASK)) if factor > 1 else v
    return v


def mix_numpy(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> _S1)
    v = (v * _M1) & _MASK
    v ^= v >> _S2
    v = (v * _M2) & _MASK
    return v ^ (v >> _S3)


def mix_sql(v: str) -> str:
    for shift, factor in ((_S1, _M1), (_S2, _M2), (_S3, 1)):
        v = f"xor({v}, ({v}) >> {shift})"
        v = f"(({v} * {factor}) & {_MASK})" if factor > 1 else v
    return v


def _bigint(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def pair_at(k: Column, a: Column | int, b: Column | int, seed: str, tweak: Column | int = 0) -> Column:
    """struct<l, r>: the k-th of the a * b pairs in the order of the seed (and tweak), l below a and r below b."""
    k, a, b, tweak = _bigint(k), _bigint(a), _bigint(b), _bigint(tweak)
    start = F.struct(F.floor(k / b).cast("long").alias("l"), (k % b).alias("r"), a.alias("base_l"), b.alias("base_r"))

    def one(s: Column, key: Column) -> Column:
        image = mix((s["r"] + key + tweak).bitwiseAND(F.lit(_MASK)))
        return F.struct(s["r"].alias("l"), ((s["l"] + image) % s["base_l"]).alias("r"), s["base_r"].alias("base_l"), s["base_l"].alias("base_r"))

    keys = F.array(*[F.lit(x).cast("long") for x in round_keys(seed)])
    return F.aggregate(keys, start, one, lambda s: F.struct(s["l"].alias("l"), s["r"].alias("r")))


def pair_sql(rows: str, k: str, a: str, b: str, seed: str, name: str) -> str:
    """Common table expressions, the last of them ``name``: ``rows`` with l and r of ``pair_at``."""
    out = [f"{name}_0 AS (SELECT *, {k} // {b} AS l, {k} % {b} AS r FROM {rows})"]
    for i, key in enumerate(round_keys(seed)):
        base, to = (a, b)[i % 2], f"{name}_{i + 1}" if i + 1 < ROUNDS else name
        out.append(f"{to} AS (SELECT * EXCLUDE (l, r), r AS l, (l + {mix_sql(f'((r + {key}) & {_MASK})')}) % {base} AS r FROM {name}_{i})")
    return ", ".join(out)


#: An image outside is permuted again at most so often; beyond a few thousand numbers that many in a row do not occur.
AGAIN = 64


def permuted(i: Column, n: Column | int, seed: str, tweak: Column | int = 0) -> Column:
    """The image of i in a permutation of the numbers below n."""
    n = _bigint(n)
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")
    b = F.greatest(F.lit(1), F.ceil(n / a)).cast("long")

    def step(at: Column, _: Column) -> Column:
        return F.when((_ > 0) & (at < n), at).otherwise(F.element_at(F.transform(F.array(pair_at(at, a, b, seed, tweak)), lambda p: p["l"] * b + p["r"]), 1))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(AGAIN)), _bigint(i), step)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a permutation did not come back below n")).cast("long"))


def permuted_numpy(n: int, seed: str, tweaks: np.ndarray) -> np.ndarray:
    """(tweaks x n): ``permuted`` of all numbers below n, a row for each tweak."""
    a = max(1, math.ceil(math.sqrt(n)))
    b = max(1, -(-n // a))
    keys, tweaks = round_keys(seed), tweaks.astype(np.int64)

    def image(k: np.ndarray, t: np.ndarray) -> np.ndarray:
        left, right, base_l, base_r = k // b, k % b, a, b
        for key in keys:
            left, right = right, (left + mix_numpy((right + key + t) & _MASK)) % base_l
            base_l, base_r = base_r, base_l
        return left * b + right

    out = image(np.arange(n, dtype=np.int64)[None, :], tweaks[:, None])
    row, col = np.nonzero(out >= n)
    while len(row):
        out[row, col] = image(out[row, col], tweaks[row])
        still = out[row, col] >= n
        row, col = row[still], col[still]
    return out
