"""Fuzzy string scores: Arrow-batched, and applied to distinct inputs only.

``ratio`` is 200 * LCS / (len a + len b).  ``weighted_ratio`` follows the public
definition of the weighted ratio: plain and token ratios for strings of similar
length, partial ratios, scaled down, where lengths differ.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..schema import CANONICAL_SKILLS
from .text import let, strip
from .values import exact_skill


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    return max([ratio(left, right)] + ([ratio(both, left), ratio(both, right)] if both else []))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    plain = ratio(a, b)
    if spread < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return max(plain, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@pandas_udf(DoubleType())
def token_sort_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """token_sort_ratio, null where a side is null."""
    return pd.Series([None if x is None or y is None else token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(StringType())
def sorted_tokens(name: pd.Series) -> pd.Series:
    """What token_sort_ratio compares."""
    return name.map(lambda x: None if x is None else " ".join(sorted(x.split())))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of many pairs; strings of up to 63 code points are compared all at once."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    short = (la < 64) & (lb < 64)
    out = np.full(len(a), 100.0)
    if short.all():
        width = max(8, -(-int(la.max(initial=0)) // 8) * 8)
        at = np.array(a, f"<U{width}").view(np.uint32).reshape(-1, width)
        to = np.array(b, f"<U{width}" if lb.max(initial=0) <= width else "<U64").view(np.uint32).reshape(len(b), -1)
        full = (np.uint64(1) << la.astype(np.uint64)) - np.uint64(1)
        row, bits = full.copy(), np.zeros((len(a), 8), np.uint8)
        for k in range(int(lb.max(initial=0))):
            bits[:, : width // 8] = np.packbits(at == to[:, k, None], axis=1, bitorder="little")
            hit = np.where(k < lb, row & bits.view("<u8")[:, 0], np.uint64(0))
            row = ((row + hit) | (row - hit)) & full
        both = la + lb
        np.divide(200.0 * (la - np.bitwise_count(row)), both, out=out, where=both > 0)
        return out
    for part in (np.flatnonzero(short), np.flatnonzero(~short)):
        x, y = [a[k] for k in part], [b[k] for k in part]
        out[part] = ratios(x, y) if len(part) and short[part[0]] else [ratio(i, j) for i, j in zip(x, y, strict=True)]
    return out


@pandas_udf(DoubleType())
def ratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio of strings that are not null."""
    return pd.Series(ratios(a.tolist(), b.tolist()))


@lru_cache(1 << 16)
def nearest_skill(x: str) -> str | None:
    """The canonical skill with the best weighted ratio of 80 or more, the earlier on ties."""
    score, name = max(((weighted_ratio(x, n), -k) for k, n in enumerate(CANONICAL_SKILLS)), default=(0.0, 0))
    return CANONICAL_SKILLS[-name] if score >= 80 else None


@pandas_udf(StringType())
def closest_skill(raw: pd.Series) -> pd.Series:
    """nearest_skill of each value, null for null or empty."""
    return raw.map(lambda x: nearest_skill(x) if x else None)


@pandas_udf(ArrayType(StringType()))
def closest_skills(raws: pd.Series) -> pd.Series:
    """nearest_skill of each element, null for null or empty; a worker scores a value once."""
    return raws.map(lambda r: None if r is None else [nearest_skill(x) if x else None for x in r])


def near_skills(raws: Column) -> Column:
    """Fuzzy matches by position for the values that are no alias; without such values an empty array.

    Not null: for each null behind others Arrow's list vector goes over the whole run of nulls again.
    """
    open_ = F.transform(raws, lambda x: F.when(exact_skill(x).isNull(), strip(x)))
    some = lambda xs: F.exists(xs, lambda x: F.coalesce(x, F.lit("")) != "")
    return closest_skills(let(open_, lambda xs: F.when(some(xs), xs).otherwise(F.array().cast("array<string>"))))


def fuzzy_skills(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_match``: exact alias, else fuzzy on the distinct unmatched values, else null."""
    bare = strip(F.col(column))
    rest = df.select(bare.alias("raw")).where((F.col("raw") != "") & exact_skill(F.col("raw")).isNull()).distinct()
    found = rest.withColumn("near", closest_skill("raw"))
    joined = df.withColumn("raw", bare).join(found, "raw", "left")
    return joined.withColumn(f"{column}_match", F.coalesce(exact_skill(F.col(column)), "near")).drop("raw", "near")


def similar(a: Column, b: Column, threshold: float) -> Column:
    return token_sort_score(a, b) >= threshold
