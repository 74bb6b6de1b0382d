"""Long spans of characters that stand verbatim in more than one document, exact and without pairs.

1. From the sentences of every text, runs of RUN characters are hashed: those that start where a sentence
   ends and the next begins and, where sentences are longer than a window leaves room for, at the place
   whose next characters hash lowest. Of each window of `min_chars` characters one run is picked, by its
   own characters only, so that equal windows of two documents pick equal runs; neighbouring windows
   mostly share theirs. A run travels as its hash and place, without text.
2. Runs that may repeat anywhere in the corpus (llm.repeats) are counted exactly; those of two documents
   and more get the text around them from their document.
3. Equal runs meet in one task, where the exact windows of `min_chars` characters around them are
   compared; a window that occurs in two documents is shared, and a document's shared amount is the
   union of its windows.

So no span is missed, and none is reported that isn't there, as far as 64-bit hashes of two independent
kinds are distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import attach_group
from ..session import materialise
from . import repeats
from .codes import Stretches, codes, mix, slices

MIN_CHARS = 250
#: Characters of a run, and those that decide on its start.
RUN, AHEAD = 100, 8
#: A run occurring more often is compared by windows spread over all tasks instead of in one.
HOT_RUN = 20_000
#: Runs whose documents are broadcast to fetch the text around them; more are joined by a shuffle.
BROADCAST_RUNS = 200_000
_LONGEST, _BATCH = 2_000_000, 400_000
_ENDS = np.array([ord(c) for c in ".!?…;:\n"], np.uint32)
_BLANKS = np.array([ord(c) for c in " \n\t\r\xa0\u202f\u3000"], np.uint32)


class _Runs:
    """The runs of one batch of text slices, with the windows that picked them.

    Each place has a rank from its next AHEAD characters: ends of sentences first, the others in the
    order of their hash. Window p picks the leftmost lowest rank among the places from which a run still
    ends within the window.
    """

    def __init__(self, batch: list[tuple[int, int, str]], min_chars: int):
        if min_chars < RUN + AHEAD:
            raise ValueError("spans that short need a smaller RUN")
        gap = "\0" * AHEAD
        cp = codes(gap.join(s for _, _, s in batch) + gap)
        size = np.array([len(s) for _, _, s in batch])
        start = np.concatenate([[0], np.cumsum(size + AHEAD)[:-1]])
        n = len(cp)
        values = mix(cp)
        with np.errstate(over="ignore"):
            ahead, step = values, 1
            while step < AHEAD:  # each place's next AHEAD characters, by doubling
                held = ahead
                ahead = held * np.uint64(0xD6E8FEB86659FD93)
                ahead[:-step] += held[step:]
                step *= 2
        rank = mix(ahead) >> np.uint64(35)  # 29 bits, and the first for ends of sentences
        ends = np.zeros(n, bool)
        ends[:-1] = np.isin(cp[:-1], _ENDS) & np.isin(cp[1:], _BLANKS)
        rank[~ends] |= np.uint64(1 << 29)
        low = (rank << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        room, width = min_chars - RUN + 1, 1  # starts that a window may pick
        while width * 2 <= room:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < room:
            low = np.minimum(low[: len(low) - (room - width)], low[room - width :])
        pick = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # pick[p]: the run's start that window p picks
        windows = np.maximum(0, size - min_chars + 1)
        owner = np.repeat(np.arange(len(batch)), windows)
        p = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + start[owner]
        pick = pick[p]
        edge = np.flatnonzero(np.append(True, pick[1:] != pick[:-1])) if len(pick) else pick
        #: Of each run: its slice, first window in the slice, and how many more windows picked it.
        self.of, self.first = owner[edge], p[edge] - start[owner[edge]]
        self.more = np.diff(np.append(edge, len(pick))) - 1
        self.hashes = Stretches(values).hash(pick[edge], pick[edge] + RUN).view(np.int64)


def _windows(ids: list, starts: list[int], texts: list[str], min_chars: int) -> tuple[np.ndarray, ...]:
    """Of rows (id, start, text around a run): each window's row, place and two hashes."""
    cp = codes("".join(texts))
    size = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = size - min_chars + 1
    row = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    a = at[row] + k
    one = Stretches(mix(cp)).hash(a, a + min_chars)
    with np.errstate(over="ignore"):
        two = Stretches(mix(cp.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(7))).hash(a, a + min_chars)
    return row, np.asarray(starts)[row] + k, one, two


def _shared_intervals(ids: list, starts: list[int], texts: list[str], min_chars: int) -> pa.RecordBatch:
    """Intervals of windows that occur with two different ids among the given rows."""
    row, place, one, two = _windows(ids, starts, texts, min_chars)
    who = np.unique(np.asarray(ids), return_inverse=True)[1][row]
    order = np.lexsort((two, one))
    o, t = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    low, high = np.minimum.reduceat(who[order], at), np.maximum.reduceat(who[order], at)
    shared, first_id = np.zeros(len(order), bool), np.zeros(len(order), bool)
    group = np.cumsum(new) - 1
    shared[order] = (low != high)[group]
    first_id[order] = who[order] == low[group]
    r, p, f = row[shared], place[shared], first_id[shared]
    edge = np.ones(len(r), bool)
    edge[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (f[1:] != f[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(r)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in r[first]] if len(first) else [], pa.array(ids).type), pa.array(p[first], pa.int64()), pa.array(p[last] + min_chars if len(first) else p[:0], pa.int64()), pa.array(f[first])],
        ["id", "a", "b", "first"],
    )


def shared_intervals(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (id, a, b, first): characters a .. b-1 (from 0) lie in spans of at least min_chars that another id has.

    `first`: no smaller id has those of the span's windows. The intervals of an id may touch and overlap; their union is exact. Null and shorter texts share
    nothing; rows without an id are left out; rows repeated under the same id count once; an empty
    table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length(text_col) >= min_chars))
    src = src.withColumn("t", F.hash("text"))  # tells texts apart that are delivered under one id

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in slices(batch.column("text").to_pylist(), _LONGEST, 2 * min_chars, _BATCH):
                r = _Runs(held, min_chars)
                row, offset = np.array([i for i, _, _ in held]), np.array([at for _, at, _ in held])
                at = pa.array(row[r.of], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r.hashes), batch.column("id").take(at), batch.column("t").take(at), pa.array(offset[r.of] + r.first, pa.int32()), pa.array(r.more, pa.int32())], ["h", "id", "t", "start", "more"])

    found = materialise(src.mapInArrow(runs, f"h long, id {kind}, t int, start int, more int"), "runs")
    passed = materialise(repeats.possible(found, found.count()), "possible-runs")
    groups = passed.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    groups = materialise(groups.where(F.col("lo") != F.col("hi")).select("h", "n"), "shared-run-sizes")
    hot = groups.where(F.col("n") > HOT_RUN).select("h")  # fewer than rows / HOT_RUN, at most 64 MB for a trillion rows
    cold = passed.join(F.broadcast(hot), "h", "left_anti").join(groups.where(F.col("n") <= HOT_RUN).select("h"), "h", "left_semi").withColumn("hot", F.lit(False))
    shared = materialise(cold.unionByName(passed.join(F.broadcast(hot), "h", "left_semi").withColumn("hot", F.lit(True))), "shared-runs")
    asked = shared.groupBy("id", "t").agg(F.collect_set(F.struct("h", "start", "more", "hot")).alias("runs"))  # of one document
    asked = F.broadcast(asked) if shared.count() <= BROADCAST_RUNS else asked

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = [(i, r["h"], r["start"], r["hot"], text[r["start"] : r["start"] + r["more"] + min_chars]) for i, (text, runs) in enumerate(zip(part.column("text").to_pylist(), part.column("runs").to_pylist())) for r in runs]
                at, h, start, hot, text = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), part.column("id").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(hot, pa.bool_()), pa.array(text, pa.string())], ["h", "id", "start", "hot", "around"])

    rows = src.join(asked, ["id", "t"]).select("id", "text", "runs").mapInArrow(around, f"h long, id {kind}, start long, hot boolean, around string")
    if hot.isEmpty():
        cold = rows
    else:
        rows = materialise(rows, "texts-around-runs")
        cold = rows.where("NOT hot")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by h; whole groups are compared, some at a time."""
        ids, starts, texts, runs_, size = [], [], [], [], 0
        for batch in batches:
            ids += batch.column("id").to_pylist()
            starts += batch.column("start").to_pylist()
            texts += (new := batch.column("around").to_pylist())
            runs_ += batch.column("h").to_pylist()
            size += sum(map(len, new))
            if size > _BATCH:
                k = len(runs_)
                while k and runs_[k - 1] == runs_[-1]:
                    k -= 1
                if k:
                    yield _shared_intervals(ids[:k], starts[:k], texts[:k], min_chars)
                    ids, starts, texts, runs_ = ids[k:], starts[k:], texts[k:], runs_[k:]
                    size = sum(map(len, texts))
        if runs_:
            yield _shared_intervals(ids, starts, texts, min_chars)

    schema = f"id {kind}, a long, b long, first boolean"
    found = cold.select("h", "id", "start", "around").repartition("h").sortWithinPartitions("h").mapInArrow(compare, schema)
    if hot.isEmpty():
        return found

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                row, place, one, two = _windows([], part.column("start").to_pylist(), part.column("around").to_pylist(), min_chars)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(place, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "a", "one", "two"])

    windows = rows.where("hot").select("id", "start", "around").mapInArrow(spread, f"id {kind}, a long, one long, two long").select("id", "a", F.struct("one", "two").alias("window"))
    holders = materialise(windows.groupBy("window").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")), "windows")
    total = holders.agg(F.sum("n")).first()[0] or 0
    spans = attach_group(windows, holders.where("lo <> hi").select("window", "n", "lo"), "window", total)
    return found.unionByName(spans.select("id", "a", (F.col("a") + min_chars).alias("b"), (F.col("id") == F.col("lo")).alias("first")))


def shared_spans(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (id_col, a, b): the shared intervals of each document, those that touch or overlap as one."""
    spans = F.array_sort(F.collect_set(F.struct("a", "b")))  # of one document: bounded by its length
    kind = "array<struct<a:bigint,b:bigint>>"

    def joined(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]), grown).otherwise(F.concat(acc, F.array(x)))

    union = F.aggregate(spans, F.array().cast(kind), joined)
    merged = shared_intervals(docs, id_col, text_col, min_chars).groupBy("id").agg(union.alias("x"))
    return merged.select(F.col("id").alias(id_col), F.explode("x").alias("x")).select(id_col, "x.a", "x.b")


def shared_amounts(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (id_col, shared_chars) of the documents with shared spans; each shared character counts once."""
    spans = F.array_sort(F.collect_set(F.struct("a", "b")))  # of one document: bounded by its length
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
        lambda s: s["n"],
    )
    return shared_intervals(docs, id_col, text_col, min_chars).groupBy(F.col("id").alias(id_col)).agg(union.alias("shared_chars"))


_SENTENCE = re.compile(r".+?(?:[.!?…]+(?=\s)|\n|\Z)\s*", re.S)


def _kept(text: str, spans: list) -> tuple[str, int]:
    """A text without the sentences that lie wholly in the spans, and how many those are."""
    union: list[list[int]] = []
    for x in sorted((x["a"], x["b"]) for x in spans):
        if union and x[0] <= union[-1][1]:
            union[-1][1] = max(union[-1][1], x[1])
        else:
            union.append(list(x))
    out, removed, k = [], 0, 0
    for m in _SENTENCE.finditer(text):
        end = m.start() + len(m.group().rstrip())
        while k < len(union) and union[k][1] < end:
            k += 1
        if k < len(union) and union[k][0] <= m.start() and end <= union[k][1] and end > m.start():
            removed += 1
        else:
            out.append(m.group())
    return "".join(out), removed


def without_repeats(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (id_col, kept, removed): each text without the sentences that lie wholly in a repeated span of which
    it isn't the first holder, and their number. Other texts, null ones too, are as they were."""
    kind = docs.schema[id_col].dataType.simpleString()
    later = shared_intervals(docs, id_col, text_col, min_chars).where(~F.col("first"))
    spans = later.groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("spans"))  # of one document
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(spans, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, held in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                t, n = _kept(text, held) if text and held else (text, 0)
                kept.append(t)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.string()), pa.array(removed, pa.int64())], [id_col, "kept", "removed"])

    return rows.select("id", "text", "spans").mapInArrow(run, f"`{id_col}` {kind}, kept string, removed long")
