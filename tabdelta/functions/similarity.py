"""Similarity of names and of sets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_header(h: str) -> str:
    """Lower case, without currency marks, with letters and digits only."""
    h = re.sub(r"\(\s*(rs\.?|inr|₹)\s*\)|₹", "", h.lower())
    return " ".join(re.sub(r"[^\w\s]|_", " ", h).split())


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    swapped = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used, strict=True) if u), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters."""
    j = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


def token_set_ratio(a: str, b: str) -> float:
    """Jaccard similarity of the words of two names; 1 if neither has any."""
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x | y else 1.0


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller of two arrays, as sets, that the other holds; 0 if one is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(small, F.lit(1)))
