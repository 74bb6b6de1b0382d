"""Which keys may occur more than once: filters of keys seen once and again, merged from partitions, by range of hashes.

The range of a 64-bit hash is its first bits; each range has a filter of its own, so filters grow in
number with the keys and never in size, and none is gathered on the driver or sent to all workers. Each
key sets HASHES bits of its range's filter. Every partition reports, for each range, the bits it saw once
and those it saw again, as compressed gaps (two to three bytes a key). One task per range merges its
reports: a bit is set in the result if it was seen at least twice in all. Then the rows, which carry
nothing but the key and what the caller needs to find them again, meet the filter of their range. A key
that really repeats always passes; one seen once passes by coincidence, in fewer than one case in a
hundred, whatever the number of keys. Callers group exactly what passes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

HASHES = 2
BITS_PER_KEY = 24
#: Bits of a range's filter: at most 2 MB, for about 700,000 keys.
RANGE_LOG2 = 24
#: The least number of ranges, so that small inputs use all cores.
LEAST_RANGES_LOG2 = 5
#: Rows of one range that one task holds; the rows of a hot key are spread over several, each with the range's filter.
PART_ROWS = 1_000_000
#: Keys that a partition holds before it reports.
FLUSH = 4_000_000


@dataclass(frozen=True)
class Layout:
    """How many ranges there are, and bits in each, as powers of two."""

    ranges: int
    bits: int

    @staticmethod
    def of(keys: int) -> Layout:
        need = math.ceil(math.log2(max(1, keys) * BITS_PER_KEY))
        ranges = max(LEAST_RANGES_LOG2, need - RANGE_LOG2)
        return Layout(ranges, min(RANGE_LOG2, max(10, need - ranges)))

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return h.view(np.uint64) >> np.uint64(64 - self.ranges)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        """The bits of each hash in its range's filter."""
        with np.errstate(over="ignore"):
            first = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            second = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return [x >> np.uint64(64 - self.bits) for x in (first, second)[:HASHES]]

    def report(self, h: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
        """Of each range met: its number, rows, and the bits seen once and again."""
        home = self.range_of(h)
        rows = np.bincount(home.astype(np.int64), minlength=1 << self.ranges)
        places, n = np.unique(np.concatenate([(home << np.uint64(self.bits)) | p for p in self.places(h)]), return_counts=True)
        edges = np.searchsorted(places, np.arange((1 << self.ranges) + 1, dtype=np.uint64) << np.uint64(self.bits))
        out = []
        for b in np.flatnonzero(rows):
            p, again = places[edges[b] : edges[b + 1]] & np.uint64((1 << self.bits) - 1), n[edges[b] : edges[b + 1]] > 1
            out.append((int(b), int(rows[b]), _pack(p[~again]), _pack(p[again])))
        return out

    def merge(self, reports: Iterator[tuple[bytes, bytes]]) -> bytes:
        """The bits of a range that all its reports together saw at least twice."""
        seen, again = np.zeros(1 << self.bits, bool), np.zeros(1 << self.bits, bool)
        for once, twice in reports:
            one, two = _unpack(once), _unpack(twice)
            again[one[seen[one]]] = True
            again[two] = True
            seen[one] = True
            seen[two] = True
        return zlib.compress(np.packbits(again).tobytes(), 1)

    def maybe(self, h: np.ndarray, bits: bytes) -> np.ndarray:
        """Whether hashes of one range may be repeated, by its merged bits."""
        held, found = np.frombuffer(zlib.decompress(bits), np.uint8), np.ones(len(h), bool)
        for p in self.places(h):
            found &= (held[(p >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return found


def _pack(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places.astype(np.uint32), prepend=np.uint32(0)).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.uint64).astype(np.int64)


def possible(rows: DataFrame, total: int) -> DataFrame:
    """Those of `rows` whose `h`, an evenly spread 64-bit hash without nulls, may occur more than once.

    rows: read twice, so a written table; total: about how many there are. Every row of a repeated hash
    is among them, and few others. An empty table gives none.
    """
    layout = Layout.of(total)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            ids, n, once, again = zip(*layout.report(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], ["_range", "n", "once", "again"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
                count += batch.num_rows
            if count >= FLUSH:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        bits = layout.merge(zip(table.column("once").to_pylist(), table.column("again").to_pylist()))
        return pa.table({"_range": table.column("_range").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "bits": pa.array([bits], pa.binary())})

    reports = rows.select("h").mapInArrow(report, "_range long, n long, once binary, again binary")
    filters = materialise(reports.groupBy("_range").applyInArrow(merge, "_range long, n long, bits binary"), "repeat-filters")
    parts = F.ceil(F.col("n") / PART_ROWS)
    home = rows.withColumn("_range", F.expr(f"shiftrightunsigned(h, {64 - layout.ranges})"))
    crowded = filters.where(F.col("n") > PART_ROWS).select("_range", parts.cast("long").alias("_parts"))  # fewer than total / PART_ROWS
    if crowded.isEmpty():
        home = home.withColumn("_part", F.lit(0).cast("long"))
    else:
        home = home.join(F.broadcast(crowded), "_range", "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    bits = filters.select("_range", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("_part"), "bits")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        h = left.column("h").to_numpy()
        found = layout.maybe(h, right.column("bits")[0].as_py()) if len(h) else np.zeros(0, bool)
        return left.select(names).filter(pa.array(found))

    names = rows.columns
    return home.groupBy("_range", "_part").cogroup(bits.groupBy("_range", "_part")).applyInArrow(probe, rows.schema)
