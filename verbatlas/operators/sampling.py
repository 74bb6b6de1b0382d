"""Stratified samples with quotas, and chunks of consecutive verbatims."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import SETTINGS
from ..session import materialise


def stratum(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns])


def detect_strata(df: DataFrame, names: tuple[str, ...] = SETTINGS.strata) -> tuple[str, ...]:
    """Those of the usual strata that the table has as columns."""
    return tuple(c for c in names if c in df.columns)


def head_sample(df: DataFrame, id_col: str, n: int = SETTINGS.sample_size_rapid) -> DataFrame:
    """The first n rows by id; all rows of a smaller table."""
    return df.orderBy(id_col).limit(n)


def histogram(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows and percent of each stratum."""
    n = df.groupBy(stratum(columns).alias("stratum")).agg(F.count("*").alias("rows"))
    return n.withColumn("pct", F.round(100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy()), 1))


def quotas(strata: DataFrame, target: int, least: int = SETTINGS.min_per_stratum, cap: int = SETTINGS.cap_per_stratum) -> DataFrame:
    """Adds `quota` to (stratum, rows): the minimum plus a share of the rest, up to the cap; one more each,
    largest first, while the target is not reached. Too many strata for the minimum share the target evenly."""
    everything = Window.partitionBy()
    s, total = F.count("*").over(everything), F.sum("rows").over(everything)
    rest = F.lit(target) - s * least
    base = F.least(F.lit(least) + F.floor(rest * (F.col("rows") / total)), F.lit(cap))
    first = strata.withColumn("base", F.when(rest < 0, F.floor(F.lit(target) / s)).otherwise(base).cast("long")).withColumn("few", rest < 0)
    gap = F.lit(target) - F.sum("base").over(everything)
    open_ = (F.col("base") < cap) & ~F.col("few")
    place = F.sum(open_.cast("long")).over(Window.partitionBy().orderBy(F.desc("rows"), "stratum").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("gap", gap).withColumn("quota", F.col("base") + F.when(open_ & (place <= F.col("gap")), 1).otherwise(0)).select("stratum", "rows", "quota")


def _draw(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_sample(df: DataFrame, id_col: str, columns: tuple[str, ...], target: int, least: int = SETTINGS.min_per_stratum, cap: int = SETTINGS.cap_per_stratum, seed: int = SETTINGS.sampling_seed) -> DataFrame:
    """Rows (id_col, stratum): up to each stratum's quota, drawn by a hash of seed and id, so any engine draws the same.

    A table of up to `target` rows is taken whole. Each part of a stratum is cut to the quota first, so
    no task ranks a whole large stratum.
    """
    rows = df.select(F.col(id_col), stratum(columns).alias("stratum"), _draw(id_col, seed).alias("d"))
    counts = rows.groupBy("stratum").agg(F.count("*").alias("rows"))
    q = quotas(counts, target, least, cap).withColumn("quota", F.when(F.sum("rows").over(Window.partitionBy()) <= target, F.col("rows")).otherwise(F.col("quota")))
    met = rows.join(F.broadcast(q.select("stratum", "quota")), "stratum")
    part = Window.partitionBy("stratum", F.substring("d", 1, 1)).orderBy("d", id_col)
    whole = Window.partitionBy("stratum").orderBy("d", id_col)
    best = met.withColumn("k", F.row_number().over(part)).where(F.col("k") <= F.col("quota"))
    return best.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= F.col("quota")).select(id_col, "stratum")


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = SETTINGS.sampling_seed) -> DataFrame:
    """The n rows whose hashes come first; all rows of a smaller table."""
    return df.select(id_col).withColumn("d", _draw(id_col, seed)).orderBy("d", id_col).limit(n).select(id_col)


def group_places(df: DataFrame, id_col: str, group: str) -> DataFrame:
    """Rows (group, id_col, pos): each row's place, from 0, in its group by id; equal ids in any order.

    Rows are spread by ranges of (group, id), so a group that holds a third of all rows fills many tasks.
    Each task counts on from 0; only the first group of a task can have begun before, so there are fewer
    offsets than tasks, and they are broadcast.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in (group, id_col)]

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, so_far = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(0).dictionary_encode()
            code = values.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(first, len(code)))
            place = np.arange(len(code)) - np.repeat(first, size)
            begins, ends = batch.column(0)[0].as_py(), batch.column(0)[len(code) - 1].as_py()
            if held is not None and held[0] == begins:
                place[: size[0]] += so_far
            so_far = int(place[-1]) + 1
            held = (ends,)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64()), batch.column(2)], [group, id_col, "_place", "_part"])

    ranged = df.select(group, id_col).repartitionByRange(group, id_col).sortWithinPartitions(group, id_col).withColumn("_part", F.spark_partition_id().cast("long"))
    placed = materialise(ranged.mapInArrow(count_on, f"`{group}` {kinds[0]}, `{id_col}` {kinds[1]}, _place long, _part long"), "places")
    sizes = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("_before", before).where("_before > 0").select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_before")
    out = placed.join(F.broadcast(later), placed[group].eqNullSafe(later["_g"]) & (placed["_part"] == later["_p"]), "left")
    return out.select(group, id_col, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"))


def chunks(df: DataFrame, id_col: str, group: str, size: int = SETTINGS.chunk_size) -> DataFrame:
    """Rows (group, id_col, pos, chunk_index): consecutive slices of each group in the order of ids."""
    return group_places(df, id_col, group).withColumn("chunk_index", F.floor(F.col("pos") / size))


def prompt_cut(chunked: DataFrame, texts: DataFrame, id_col: str, group: str, most: int = SETTINGS.prompt_chars) -> DataFrame:
    """Per chunk: texts, and those that fit a prompt of `most` characters, cut at the first that does not."""
    lines = chunked.join(texts.select(id_col, F.length(F.coalesce("full_text", F.lit(""))).alias("n")), id_col)
    w = Window.partitionBy(group, "chunk_index").orderBy("pos")
    before = F.coalesce(F.sum(F.col("n") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = lines.withColumn("over", before + F.col("n") > most).withColumn("cut", F.max(F.col("over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return first.groupBy(group, "chunk_index").agg(F.count("*").alias("texts"), F.sum((F.col("cut") == 0).cast("long")).alias("fitting"))


def estimate(chunked: DataFrame, texts: DataFrame, id_col: str, group: str, price_in: float = 0.01, price_out: float = 0.03, brief: str = "", prompt: str = "") -> DataFrame:
    """Per group: chunks, tokens in and out, cost, seconds (cut to whole ones), alert.

    Tokens in: those of the first chunk's prompt, its texts with the brief and the prompt's own text, times
    the chunks; a token is four characters.
    """
    size = chunked.where("chunk_index = 0").join(texts.select(id_col, F.length(F.coalesce("full_text", F.lit(""))).alias("n")), id_col)
    first = size.groupBy(group).agg(F.sum("n").alias("chars"))
    g = chunked.groupBy(F.col(group).alias("_g")).agg((F.max("chunk_index") + 1).alias("chunks")).join(first, F.col("_g").eqNullSafe(F.col(group)))
    tokens_in, tokens_out = F.ceil((F.col("chars") + len(brief) + len(prompt)) / 4) * F.col("chunks"), F.col("chunks") * SETTINGS.output_tokens_per_chunk
    alert = F.when(F.col("chunks") >= SETTINGS.blocking_chunks, "blocking").when(F.col("chunks") >= SETTINGS.warning_chunks, "warning").otherwise("none")
    return g.select(
        group, F.col("chunks").cast("long").alias("chunks"), tokens_in.cast("long").alias("tokens_in"), tokens_out.cast("long").alias("tokens_out"),
        (F.floor((tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) * 10 + 0.5000001) / 10000).alias("cost"),
        F.floor(F.col("chunks") * SETTINGS.seconds_per_chunk / SETTINGS.llm_parallel_calls).cast("long").alias("seconds"), alert.alias("alert"),
    )


def describe(rows: int, taken: int, strata: int | None) -> str:
    """One line on how a sample was drawn."""
    if taken >= rows:
        return f"all {rows:,} rows"
    return f"{taken:,} of {rows:,} rows at random" if strata is None else f"{taken:,} of {rows:,} rows from {strata:,} strata"
