"""String similarity from 0 to 100: the best of plain, partial, token-sort and token-set ratios, scaled by length.

For data-sized columns use similar(), an Arrow-batched function over distinct strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 0.0


def partial(a: str, b: str) -> float:
    """The best plain ratio of the shorter string with a part of the longer of its length."""
    a, b = sorted((a, b), key=len)
    return max((plain(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)), default=0.0) if a else 0.0


def _sorted(x: str) -> str:
    return " ".join(sorted(x.split()))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (x - y, y - x))
    return max(plain(both, left) if both else 0.0, plain(both, right) if both else 0.0, plain(left, right))


def ratio(a: str, b: str) -> float:
    a, b = a.lower().strip(), b.lower().strip()
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = plain(a, b)
    if longer < 1.5:
        return max(best, 0.95 * plain(_sorted(a), _sorted(b)), 0.95 * token_set(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial(_sorted(a), _sorted(b)))


def similar(a: Column, b: Column) -> Column:
    """ratio() of two columns; null where either is null."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([None if p is None or q is None else ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)
