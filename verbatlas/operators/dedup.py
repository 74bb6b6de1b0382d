"""Near-duplicate texts by insertion/deletion ratio, and keep-first deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import SETTINGS
from ..functions.similarity import indel_ratio, indel_udf
from ..session import materialise
from .graph import components
from .skew import attach_group

SHINGLE_WORDS = 5
MIN_JACCARD = 0.8
#: Texts of one group and length class that are compared with as many others in one task.
BLOCK = 2_000


def _group(group_col: str | None) -> Column:
    """A key that is never null: rows of a null group are a group of their own."""
    return F.lit("").alias("grp") if group_col is None else F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp")


def _distinct_texts(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None) -> DataFrame:
    """One row per distinct text of a group: smallest id and number of copies. Null texts count as empty; rows without an id are left out."""
    t = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), _group(group_col))
    return t.groupBy("grp", "text").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the characters, and of the pairs of neighbours, of each text, by bucket."""
    one, two = np.zeros((len(texts), 64), np.int32), np.zeros((len(texts), 256), np.int32)
    for i, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        one[i] = np.bincount(c % 61, minlength=64)
        two[i] = np.bincount((c[:-1] * np.uint32(31) + c[1:]) % 251, minlength=256)
    return one, two


def exact_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, score) of one group's distinct texts whose insertion/deletion ratio reaches the threshold, by bounds that lose none.

    Length: the shorter has at least t / (2 - t) of the longer's characters, so logarithmic length
    classes of that ratio only meet themselves and the next. Characters: a ratio of t leaves at most
    (1 - t) times both lengths of insertions and deletions; each changes one character of the texts'
    bags and at most three of their pairs of neighbours. Bags are counted by bucket, which only brings
    them nearer. Classes meet by blocks of BLOCK texts, so no task holds more than two blocks; the
    work grows with the square of a group's texts of one length.
    """
    ratio, kind = threshold / (2 - threshold), texts.schema["id"].dataType.simpleString()
    size = F.length("text")
    base = texts.where(size > 0).select("id", "grp", "text", F.floor(F.log(size) / -F.log(F.lit(ratio)) + 1e-9).alias("class"))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    sizes = materialise(base.groupBy("grp", "class").agg(blocks.alias("blocks")), "length-classes")
    block = F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int")
    left = base.join(sizes, ["grp", "class"]).withColumn("i", block).drop("blocks")
    # Each class as the longer side: of its own key, and of the key of the class before.
    right = base.join(sizes, ["grp", "class"]).withColumn("j", block).drop("blocks").withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    own = base.join(sizes, ["grp", "class"]).groupBy("grp", "class").agg(F.max("blocks").alias("nl"))
    most = sizes.select("grp", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"), "blocks").groupBy("grp", "class").agg(F.max("blocks").alias("nr"))
    left = left.join(most, ["grp", "class"]).select("grp", "class", "i", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), "id", "text", F.lit(True).alias("left"))
    right = right.join(own, ["grp", "class"]).select("grp", "class", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), "j", "id", "text", F.lit(False).alias("left"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.text.str.len()
        pdf = pdf.assign(n=n).sort_values("n")
        x, y = pdf[pdf.left], pdf[~pdf.left]
        out: list[tuple] = []
        if len(x) and len(y):
            tx, ty, ix, iy, nx, ny = x.text.tolist(), y.text.tolist(), x.id.tolist(), y.id.tolist(), x.n.to_numpy(), y.n.to_numpy()
            (x1, x2), (y1, y2) = _bags(tx), _bags(ty)
            low, high = np.searchsorted(ny, nx), np.searchsorted(ny, nx / ratio + 1e-9, "right")
            for k in range(len(tx)):
                at = np.arange(low[k], high[k])
                room = (1 - threshold) * (nx[k] + ny[at]) + 1e-9
                at, room = at[near := np.abs(y1[at] - x1[k]).sum(1) <= room], room[near]
                at = at[np.abs(y2[at] - x2[k]).sum(1) <= 3 * room]
                for m in at.tolist():
                    if ny[m] > nx[k] or ix[k] < iy[m]:
                        score = indel_ratio(tx[k], ty[m])
                        if score >= threshold and ix[k] != iy[m]:
                            out.append((min(ix[k], iy[m]), max(ix[k], iy[m]), score))
        return pd.DataFrame(out, columns=["a", "b", "score"])

    return left.unionByName(right).groupBy("grp", "class", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, score double")


def shingle_candidates(texts: DataFrame, words: int = SHINGLE_WORDS, similarity: float = MIN_JACCARD) -> DataFrame:
    """All pairs (a, b) of one group's texts whose word shingles have a Jaccard similarity of at least `similarity`; exact.

    Prefix filter: with shingles in one order, rarest first, two such texts share one of their first
    n - ceil(s n) + 1. So texts meet at their rarest shingles only; common ones, of templates and
    quotations, join texts that have nothing rarer.
    """
    toks = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n = F.size("w")
    grams = F.when(n == 0, F.array(F.lit(""))).when(n < words, F.array(F.array_join("w", " "))).otherwise(F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.array_join(F.slice("w", i, words), " ")))
    sh = materialise(texts.select("id", "grp", toks.alias("w")).select("id", F.array_distinct(F.transform(grams, lambda g: F.xxhash64("grp", g))).alias("s")), "shingles")
    flat = sh.select("id", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = materialise(flat.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    # A shingle of one text only can match no other, but keeps its place, before all others, in the prefix.
    ranked = attach_group(flat, shared, "h", sh.agg(F.sum(F.size("s"))).first()[0] or 0, size="df")
    order, text = Window.partitionBy("id").orderBy("df", "h"), Window.partitionBy("id")
    prefix = ranked.withColumns({"place": F.row_number().over(order), "unique": F.col("n") - F.count("*").over(text)})
    prefix = prefix.where(F.col("place") + F.col("unique") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1)
    p = prefix.select("id", "n", "h")
    met = p.select(F.col("id").alias("a"), F.col("n").alias("na"), "h").join(p.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h"), "h")
    met = met.where((F.col("a") < F.col("b")) & (F.col("na") >= similarity * F.col("nb") - 1e-9) & (F.col("nb") >= similarity * F.col("na") - 1e-9)).select("a", "b").distinct()
    sets = sh.select(F.col("id"), "s")
    both = met.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    jaccard = F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))
    found = both.where(jaccard >= similarity - 1e-12).select("a", "b")
    t = texts.select("id", "text")
    return found.join(t.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(t.withColumnsRenamed({"id": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")


def similar_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = SETTINGS.dedup_threshold, mode: str = "shingles", group_col: str | None = None) -> DataFrame:
    """Rows (a, b, score) of similar distinct texts; the score is their insertion/deletion ratio.

    a and b are the smallest ids of their texts. With group_col only texts of one group are compared.
    mode `exact`: all pairs with a ratio of at least `threshold`. `shingles`, for any size of input: all
    pairs with a five-word-shingle similarity of 0.8, whatever their ratio; texts without any word,
    which have no shingles, by ratio.
    """
    texts = materialise(_distinct_texts(df, id_col, text_col, group_col), "texts")
    if mode == "exact":
        return exact_pairs(texts, threshold)
    scored = shingle_candidates(texts).withColumn("score", indel_udf()(F.col("ta"), F.col("tb"))).where(F.col("ta").rlike(r"[\p{L}\p{N}]") | (F.col("score") >= threshold))
    return scored.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def duplicate_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = SETTINGS.dedup_threshold, mode: str = "shingles", group_col: str | None = None) -> DataFrame:
    """One row per row of df: (id_col, class_id, links). class_id: the smallest id of all texts linked with its own;
    links: other texts similar to its own. Copies of a text share its class; null is an empty text.
    With group_col no class reaches beyond a group."""
    pairs = materialise(similar_pairs(df, id_col, text_col, threshold, mode, group_col), "similar-pairs")
    comp = components(pairs.select("a", "b"))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    reps = _distinct_texts(df, id_col, text_col, group_col).select("grp", "text", F.col("id").alias("rep"))
    reps = reps.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.coalesce(text_col, F.lit("")).alias("text"), _group(group_col))
    found = rows.join(reps.withColumn("h", F.xxhash64("text")), ["grp", "h", "text"])
    return found.select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_first(classes: DataFrame, id_col: str) -> DataFrame:
    """The rows to keep: the first of each class."""
    return classes.where(F.col(id_col) == F.col("class_id")).select(id_col)


def keep_last(classes: DataFrame, id_col: str) -> DataFrame:
    """The rows to keep: the last of each class."""
    return classes.groupBy("class_id").agg(F.max(id_col).alias(id_col)).select(id_col)


def group_ids(classes: DataFrame, id_col: str, salt: str = "") -> DataFrame:
    """Rows (id_col, dedup_group_id) of classes of more than one row; ids depend on the class and salt only."""
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    ident = F.sha2(F.concat_ws("\x1f", F.lit(salt), F.col("class_id").cast("string")), 256)
    return classes.join(sizes, "class_id").select(id_col, ident.alias("dedup_group_id"))


def dedup_stats(classes: DataFrame, id_col: str, threshold: float = SETTINGS.dedup_threshold) -> DataFrame:
    """One row: rows before and after, removed, classes of more than one row, threshold."""
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("before"),
        F.count("*").alias("after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removed"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).cast("long").alias("clusters"),
        F.lit(threshold).alias("threshold"),
    )
