"""Weighted edit distance: what scanners confuse costs little."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Groups of characters and letter pairs that scanned text confuses.
ALIKE = ["1lI|!i", "0oOQq", "ce", "tf", "5sS", "6b", "8B", "9gq", "2zZ", "hb", "@a", "uv", "nu", "mn"]
PAIRS = {"rn": "m", "ri": "n", "ii": "u", "cl": "d", "vv": "w", "fi": "ﬁ", "fl": "ﬂ", "ni": "m", "in": "m"}

_CHEAP = {(a, b) for g in ALIKE for a in g for b in g if a != b}


def distance(a: str, b: str, cheap: float = 0.3) -> float:
    """Least cost to turn a into b: 1 an insertion, deletion or replacement, less for confusable characters and pairs."""
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        rows[0][j] = j
    for i in range(1, n + 1):
        rows[i][0] = i
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            best = rows[i - 1][j - 1] + (0.0 if x == y else cheap if (x, y) in _CHEAP else 1.0)
            best = min(best, rows[i - 1][j] + 1, rows[i][j - 1] + 1)
            if i > 1 and PAIRS.get(a[i - 2 : i]) == y:
                best = min(best, rows[i - 2][j - 1] + cheap)
            if j > 1 and PAIRS.get(b[j - 2 : j]) == x:
                best = min(best, rows[i - 1][j - 2] + cheap)
            rows[i][j] = best
    return rows[n][m]


@F.pandas_udf(DoubleType())
def weighted_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of pairs of strings; null where either is null."""
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
