"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with more than total / HOT_SHARE rows is hot, so there are fewer than HOT_SHARE hot keys whatever the input.
HOT_SHARE = 500
LEAST_HOT = 1000


def attach_group(rows: DataFrame, groups: DataFrame, key: str, total: int, size: str = "n") -> DataFrame:
    """Joins one-row-per-key `groups` (with its row count `size`) back to `rows`, of which there are at most `total`.

    Hot keys are joined by a broadcast of fewer than HOT_SHARE rows; any other key holds at most
    1/HOT_SHARE of the rows, so the shuffle of the rest is even. Null keys match nothing.
    """
    least = max(LEAST_HOT, total // HOT_SHARE)
    hot, cold = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    warm = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return warm.unionByName(rest)
