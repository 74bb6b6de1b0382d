"""Similarity of texts: normalised insertion/deletion ratio and Jaccard on words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Longest text whose characters fit the bit mask of the built-in form.
SHORT = 62


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit per character of a, a step per character of b."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """2 LCS / (|a| + |b|); 1 for two empty texts, null if one is null."""
    if a is None or b is None:
        return None
    return 1.0 if not a and not b else 1.0 if a == b else 2 * lcs_length(a, b) / (len(a) + len(b))


def indel_udf() -> object:
    """The ratio for texts of any length, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def char_masks(a: Column) -> Column:
    """Of a text of up to SHORT characters, each character with the bits of its places; computed once per text, not per pair."""
    one, chars = F.lit(1).cast("long"), F.filter(F.split(a, ""), lambda c: c != "")
    places = F.sequence(F.lit(0), F.length(a) - 1)

    def mask(ch: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda m, i: F.when(F.element_at(chars, i + 1) == ch, m.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(m))

    short = (F.length(a) > 0) & (F.length(a) <= SHORT)
    return F.when(short, F.map_from_entries(F.transform(F.array_distinct(chars), lambda ch: F.struct(ch.alias("k"), mask(ch).alias("v")))))


def indel_ratio_short(a: Column, b: Column, masks: Column | None = None) -> Column:
    """The ratio by built-in functions, for texts a of up to SHORT characters; null for longer ones.

    The state is a mask of a's characters that are not matched yet; each character of b moves it on.
    masks: char_masks(a), where it is at hand.
    """
    masks = char_masks(a) if masks is None else masks
    zero = F.lit(0).cast("long")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - 1

    def step(s: Column, ch: Column) -> Column:
        u = s.bitwiseAND(F.coalesce(F.try_element_at(masks, ch), zero))
        return (s + u).bitwiseOR(s - u).bitwiseAND(full)

    left = F.aggregate(F.filter(F.split(b, ""), lambda c: c != ""), full, step)
    ratio = F.lit(2.0) * (F.length(a) - F.bit_count(left)) / (F.length(a) + F.length(b))
    both_empty = (F.length(a) == 0) & (F.length(b) == 0)
    return F.when(both_empty, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(F.length(a) <= SHORT, ratio)


def indel_ratio_any(a: Column, b: Column, masks: Column | None = None) -> Column:
    """The ratio for texts of any length: by built-in functions where a is short, else in Arrow batches."""
    long = F.length(a) > SHORT
    return F.coalesce(indel_ratio_short(a, b, masks), indel_udf()(F.when(long, a), F.when(long, b)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 if a text has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
