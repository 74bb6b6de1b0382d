"""Corpus documents that contain passages of held-out test items.

Texts are compared as words (longest runs of letters and digits, without case) joined by one space.
A passage is `words` consecutive words of an item; a document region is a leak if it is within
`edits` character edits of the passage. Filtering follows the q-gram lemma: one edit spoils at most Q
shared q-grams and shifts later ones by at most one diagonal, so a region within the budget shares at
least L - Q + 1 - Q * edits q-grams of its passage of L characters, all in a band of edits + 1
diagonals. Bands of 2 * edits + 1 diagonals that overlap by `edits` contain every such band whole.
Regions that reach the bound are verified by a banded alignment. Nothing that meets the budget is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .codes import codes, mix

WORDS = 12
Q = 8
#: Characters of item text that one pass over the corpus holds; more items take more passes.
BLOCK_CHARS = 4_000_000
_BATCH = 500_000


def normal(text: Column) -> Column:
    """The words of a text without case, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


class Passages:
    """The passages of one block of items, with an index of their q-grams."""

    def __init__(self, items: list[tuple], words: int, edits: int):
        """items: (id, normal text); items of fewer than `words` words have no passages."""
        self.words, self.edits = words, edits
        self.items = [(i, t) for i, t in items if t and t.count(" ") + 1 >= words]
        self.starts, self.stops, shortest = [], [], []
        grams, item, place = [], [], []
        for k, (_, t) in enumerate(self.items):
            edges = [m.span() for m in re.finditer(r"\S+", t)]
            self.starts.append(np.array([edges[j][0] for j in range(len(edges) - words + 1)]))
            self.stops.append(np.array([edges[j + words - 1][1] for j in range(len(edges) - words + 1)]))
            shortest.append(int((self.stops[-1] - self.starts[-1]).min()))
            g = _grams(codes(t))
            grams.append(g)
            item.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        # The bound for an item is that of its shortest passage. One too short for the budget still has to share a
        # q-gram, or every region would pass: near copies of it without any are not found, exact ones always are.
        self.bound = np.maximum(1, np.array(shortest, dtype=np.int64) - Q + 1 - Q * edits)
        self.grams, self.item, self.place = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((grams, np.uint64), (item, np.int64), (place, np.int64)))
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.place = self.grams[order], self.item[order], self.place[order]
        self.log2 = max(16, int(np.ceil(np.log2(len(self.grams) * 32 + 1))))
        self.known = np.zeros(1 << self.log2, bool)
        self.known[(self.grams >> np.uint64(64 - self.log2)).astype(np.int64)] = True
        self.span = int(max(shortest, default=0))
        self.least = int(self.bound.min()) if len(self.bound) else 1
        self.reach = int(max((len(t) for _, t in self.items), default=0)) + 2 * edits + Q

    def regions(self, g: np.ndarray) -> np.ndarray:
        """Places of a batch's q-grams that may belong to a region meeting some item's bound."""
        hit = np.flatnonzero(self.known[(g >> np.uint64(64 - self.log2)).astype(np.int64)])
        if len(hit) < self.least:
            return hit[:0]
        # A q-gram counts only among `least` hits within one item's length.
        near = hit[self.least - 1 :] - hit[: len(hit) - self.least + 1] <= self.reach
        keep = np.zeros(len(hit) + 1, np.int32)
        at = np.flatnonzero(near)
        np.add.at(keep, at, 1)
        np.add.at(keep, at + self.least, -1)
        return hit[np.cumsum(keep)[:-1] > 0]


def _grams(cp: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams of an array of code points."""
    x, step = mix(cp), 1
    with np.errstate(over="ignore"):
        while step < Q:
            x = x[:-step] * np.uint64(0xD6E8FEB86659FD93) + x[step:] if len(x) > step else x[:0]
            step *= 2
    return mix(x)


def edit_distance_within(a: str, b: str, limit: int) -> int | None:
    """Fewest edits that turn a into some stretch of b, if at most `limit`; a band of 2 * limit + 1 around b's diagonals.

    b is the document region that starts `limit` characters before the place where a would start.
    """
    if limit == 0 or a in b:
        return 0 if a in b else None
    far, width = limit + 1, len(b) - len(a) + 2 * limit + 1
    row = [0] * (len(b) + 1)  # a may start anywhere in b
    for i, x in enumerate(a, 1):
        low, high = max(0, i - limit - 1), min(len(b), i + width)
        new = [far] * (len(b) + 1)
        if low == 0:
            new[0] = i
        for j in range(max(1, low), high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    best = min(row)
    return best if best <= limit else None


def _verified(p: Passages, k: int, text: str, diagonal: int, places: np.ndarray) -> int:
    """Of the passages of item k near `diagonal` (document place minus item place): 2 if one stands there
    word for word, 1 if one is within the budget, else 0. places: those of the item's q-grams that the
    band shares; a passage without enough of its own isn't aligned."""
    e, best = p.edits, 0
    places = np.unique(places)
    a, b = p.starts[k], p.stops[k]
    enough = np.searchsorted(places, b - Q + 1) - np.searchsorted(places, a) >= np.maximum(1, b - a - Q + 1 - Q * e)
    for a, b in zip(a[enough].tolist(), b[enough].tolist()):
        low = max(0, a + diagonal - 2 * e - 1)
        region = text[low : b + diagonal + 2 * e + 2]
        passage = p.items[k][1][a:b]
        at = region.find(passage)
        while at >= 0:  # whole words only
            x, y = low + at, low + at + len(passage)
            if (x == 0 or text[x - 1] == " ") and (y == len(text) or text[y] == " "):
                return 2
            at = region.find(passage, at + 1)
        if e and not best and edit_distance_within(passage, region, e) is not None:
            best = 1
    return best


def _leaks(p: Passages, texts: list[str]) -> list[tuple[int, int, bool]]:
    """Rows (index of text, index of item, word for word?) of a batch of normal texts."""
    gap = "\0" * Q
    cp = codes(gap.join(texts))
    if len(cp) < Q:
        return []
    at = np.concatenate([[0], np.cumsum([len(t) + Q for t in texts])[:-1]])
    places = p.regions(g := _grams(cp))
    if not len(places):
        return []
    left, right = np.searchsorted(p.grams, g[places], "left"), np.searchsorted(p.grams, g[places], "right")
    n = right - left
    rows = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = np.repeat(places, n)
    doc = np.searchsorted(at, where, "right") - 1
    item, diagonal = p.item[rows], where - at[doc] - p.place[rows]
    out: dict[tuple[int, int], int] = {}
    step = p.edits + 1
    shifted = diagonal + (1 << 24)  # items are shorter than that
    for half in range(2 if p.edits else 1):  # overlapping bands of 2 * step diagonals, half a band apart
        width = 2 * step if p.edits else 1
        band = (shifted + half * step) // width
        # Distinct document places: a q-gram repeated within a document counts once per place.
        key = np.stack([doc, item, band, where, p.place[rows]])
        key = key[:, np.lexsort(key[::-1])]
        key = key[:, np.append(True, (key[:4, 1:] != key[:4, :-1]).any(0))]
        new = np.ones(key.shape[1], bool)
        new[1:] = (key[:3, 1:] != key[:3, :-1]).any(0)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, key.shape[1]))
        enough = count >= p.bound[key[1, first]]
        for f, size in zip(first[enough], count[enough]):
            d, k, b = (int(x) for x in key[:3, f])
            if out.get((d, k), 0) < 2:
                middle = b * width - half * step - (1 << 24) + (step if p.edits else 0)
                out[d, k] = max(out.get((d, k), 0), _verified(p, k, texts[d], middle, key[4, f : f + size]))
    return [(d, k, found == 2) for (d, k), found in sorted(out.items()) if found]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, words: int = WORDS, edits: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, exact): the document has `words` consecutive words of the item, within `edits` edits.

    `exact` tells whether some such passage stands there word for word.

    Null and shorter texts leak nothing and hold nothing; rows without an id are left out; equal items
    are all reported; repeated rows give one row; empty tables give no rows. The items are read in
    blocks of BLOCK_CHARS characters, the documents once per block.
    """
    d_kind, i_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    held = items.select(F.col(item_id).alias("id"), normal(F.col(item_text)).alias("text")).where("id is not null and text is not null")
    src = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= 2 * words - 1))
    src = src.select("id", normal(F.col("text")).alias("text"))
    i_type = pa.int64() if i_kind in ("bigint", "int") else None

    def one_pass(block: list[tuple]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Passages(block, words, edits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in batches:
                ids, texts, at = batch.column("id"), batch.column("text").to_pylist(), 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (size == 0 or size + len(texts[end]) < _BATCH):
                        size += len(texts[end]) + Q
                        end += 1
                    found = _leaks(p, texts[at:end])
                    if found:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([at + d for d, _, _ in found])), pa.array([p.items[k][0] for _, k, _ in found], i_type), pa.array([x for _, _, x in found])], ["d", "i", "exact"])
                    at = end

        return src.mapInArrow(run, f"d {d_kind}, i {i_kind}, exact boolean")

    blocks, block, size = [], [], 0
    for row in held.toLocalIterator():
        block.append((row.id, row.text))
        size += len(row.text)
        if size > BLOCK_CHARS:
            blocks.append(one_pass(block))
            block, size = [], 0
    if block or not blocks:
        blocks.append(one_pass(block))
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "exact").groupBy(doc_id, item_id).agg(F.max("exact").alias("exact"))
