"""Token ratios between short names, from their definition, as Arrow-batched functions.

``ratio`` is 100 * (1 - indel distance / total length), that is 200 * LCS / total length. The sorted
ratio compares sorted tokens; the set ratio is the best of the comparisons between the common tokens and
the common tokens with the rest of either side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    """Longest common subsequence by bit-parallel rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    everything = (1 << len(a)) - 1
    row = everything
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & everything
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


@pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b)], dtype="float64")
