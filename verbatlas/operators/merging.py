"""Merging of near-identical topic labels into canonical topics, and fallback rules for topics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import NEGATION_PATTERNS, SETTINGS
from ..functions.similarity import char_masks, indel_ratio_any, jaccard


def normal_label(topic: Column, sub: Column) -> Column:
    t = F.coalesce(topic, F.lit(""))
    return F.trim(F.lower(F.when(F.length(sub) > 0, F.concat(t, F.lit(" | "), sub)).otherwise(t)))


def pivot_words(labels: DataFrame, group: str, vocabulary: int = 5, per_label: int = 3) -> DataFrame:
    """Rows (group, topic_id, pivots): each label's up to three heaviest words among the group's five most frequent.

    Weight: count x (ln((1 + n) / (1 + df)) + 1). Ties: vocabulary by word, top three by word from the end.
    Groups of fewer than two labels have no pivots.
    """
    words = labels.select(group, "topic_id", F.explode(F.regexp_extract_all("label", F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("w")).groupBy(group, "topic_id", "w").agg(F.count("*").alias("tf"))
    sizes = labels.groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    stats = words.groupBy(group, "w").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).join(sizes, group)
    vocab = stats.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("cf"), "w"))).where(F.col("k") <= vocabulary)
    weighted = words.join(vocab, [group, "w"]).withColumn("weight", F.round(F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1), 9))
    top = weighted.withColumn("k", F.row_number().over(Window.partitionBy(group, "topic_id").orderBy(F.desc("weight"), F.desc("w")))).where(F.col("k") <= per_label)
    return top.groupBy(group, "topic_id").agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("pivots"))


def positions(run_topics: DataFrame) -> DataFrame:
    """Topics with their position in the run, from 0: by topic_ord, which may repeat, then id."""
    w = Window.partitionBy("run_id").orderBy("topic_ord", "topic_id")  # a run's topics: a few hundred at most
    return run_topics.withColumn("pos", F.row_number().over(w) - 1)


def topic_labels(run_topics: DataFrame) -> DataFrame:
    return positions(run_topics).select("run_id", "topic_id", "pos", normal_label(F.col("canonical_label"), F.col("canonical_subtopic")).alias("label"))


def merge_pairs(labels: DataFrame, pivots: DataFrame, ratio: float = SETTINGS.fuzzy_merge_threshold, words: float = SETTINGS.jaccard_merge_threshold) -> DataFrame:
    """Pairs (run_id, a, b, score) of one run's topics to merge: labels nearly equal, or sharing words and pivots.

    a and b are positions. A run has a few hundred topics at most, so its pairs are few. Labels
    are compared by built-in functions up to 62 characters, longer ones in Arrow batches.
    """
    p = labels.join(pivots, ["run_id", "topic_id"], "left").select("run_id", "pos", "label", "pivots", char_masks(F.col("label")).alias("masks"))
    both = p.withColumnsRenamed({"pos": "a", "label": "la", "pivots": "pa"}).join(p.withColumnsRenamed({"pos": "b", "label": "lb", "pivots": "pb"}).drop("masks"), "run_id").where("a < b")
    score, shared = F.round(F.coalesce(indel_ratio_any(F.col("la"), F.col("lb"), F.col("masks")), F.lit(0.0)), 9), jaccard(F.col("la"), F.col("lb"))
    near = (score >= ratio) | ((shared >= words) & (F.length("pa") > 0) & (F.col("pa") == F.col("pb")))
    return both.withColumn("score", score).where(near).select("run_id", "a", "b", "score")


def merge_groups(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (run_id, pos, group_pos, method): each topic's group, named by its first position."""
    kind = ", ".join(f"{c} {labels.schema[c].dataType.simpleString()}" for c in ("run_id", "pos"))

    def one_run(topics: pa.Table, edges: pa.Table) -> pa.Table:
        """Union-find over a run's topics, a few hundred at most."""
        parent = {p: p for p in topics.column("pos").to_pylist()}

        def root(p: int) -> int:
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            return p

        met = set()
        for a, b in zip(edges.column("a").to_pylist(), edges.column("b").to_pylist()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
            met |= {a, b}
        pos = topics.column("pos").to_pylist()
        return pa.table({"run_id": topics.column("run_id"), "pos": topics.column("pos"), "group_pos": pa.array([root(p) for p in pos], pa.int32()), "method": pa.array(["pass1_algo" if p in met else "single" for p in pos])})

    edges = pairs.select(F.col("run_id").alias("_run"), "a", "b")
    return labels.select("run_id", "pos").groupBy("run_id").cogroup(edges.groupBy("_run")).applyInArrow(one_run, f"{kind}, group_pos int, method string")


def merged_topics(run_topics: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: first member's label and subtopic, the others as aliases `label > sub`, all keywords, sources.

    An empty label falls back to the first pain point, benefit or keyword, cut to 50 characters, and then to
    Theme_<position>. Where topics have pain_points, benefits, usage_context and example_verbatims, pains and
    benefits are united, up to ten examples kept, and the first member's context.
    """
    lists = [c for c in ("pain_points", "benefits", "example_verbatims") if c in run_topics.columns]
    contexts = [c for c in ("usage_context",) if c in run_topics.columns]
    none = F.array().cast("array<string>")
    t = positions(run_topics).join(groups, ["run_id", "pos"])
    member = F.struct("pos", F.trim(F.coalesce("canonical_label", F.lit(""))).alias("label"), F.coalesce("canonical_subtopic", F.lit("")).alias("sub"), F.coalesce("keywords", none).alias("keywords"), *[F.coalesce(c, none).alias(c) for c in lists], *contexts)
    g = t.groupBy("run_id", "group_pos").agg(F.array_sort(F.collect_list(member)).alias("m"), F.first("method").alias("method"))  # one group: a run's topics at most
    first, rest = F.col("m")[0], F.slice("m", 2, 100_000)
    label = F.when(F.length(first["label"]) > 0, first["label"])
    for c in [*[c for c in lists if c != "example_verbatims"], "keywords"]:
        label = label.when(F.size(first[c]) > 0, F.substring(F.get(first[c], F.lit(0)), 1, 50))
    label = label.otherwise(F.concat(F.lit("Theme_"), first["pos"].cast("string")))
    named = F.filter(rest, lambda x: F.length(x["label"]) > 0)
    aliases = F.transform(named, lambda x: F.when(F.length(x["sub"]) > 0, F.concat(x["label"], F.lit(" > "), x["sub"])).otherwise(x["label"]))
    keywords = F.array_sort(F.array_distinct(F.flatten(F.transform("m", lambda x: x["keywords"]))))
    union = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda x: x[c])))
    united = [(F.slice(union(c), 1, 10) if c == "example_verbatims" else union(c)).alias(c) for c in lists]
    return g.select(
        "run_id", "group_pos", label.alias("label"), first["sub"].alias("subtopic"), F.array_join(aliases, " | ").alias("aliases"), F.array_join(keywords, " | ").alias("keywords"),
        F.array_join(F.transform("m", lambda x: x["pos"].cast("string")), ",").alias("sources"), "method", *united, *[first[c].alias(c) for c in contexts],
    )


def merge_info(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per run: topics before and after merging, pairs, groups of several topics, topics left single, and calls of a model: none."""
    sizes = groups.groupBy("run_id", "group_pos").agg(F.count("*").alias("n"))
    many = F.count_if(F.col("n") > 1)
    g = sizes.groupBy("run_id").agg(F.sum("n").alias("topics_in"), F.count("*").alias("topics_out"), many.alias("groups"), (F.count("*") - many).alias("singles"))
    p = pairs.groupBy("run_id").agg(F.count("*").alias("pairs"))
    return g.join(p, "run_id", "left").select("run_id", "topics_in", "topics_out", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), "groups", "singles", F.lit(0).cast("long").alias("model_calls"))


def second_pass(groups: DataFrame, topics: DataFrame, decide=None) -> DataFrame:
    """Groups after a second opinion: `decide` (topics of a group as a pandas frame) → a number per topic that splits the group.

    Without one, groups and single topics stay as the first pass left them.
    """
    if decide is None:
        return groups
    met = groups.join(positions(topics).select("run_id", "pos", "canonical_label", "canonical_subtopic"), ["run_id", "pos"])
    schema = groups.select("run_id", "pos", "group_pos", "method").schema

    def split(pdf):  # a group: a run's topics at most
        pdf = pdf.sort_values("pos")
        if len(pdf) > 1:
            pdf["group_pos"] = pdf.groupby(list(decide(pdf)))["pos"].transform("min").astype("int32")
            pdf["method"] = ["pass2_llm" if n > 1 else "single" for n in pdf.groupby("group_pos")["pos"].transform("size")]
        return pdf[["run_id", "pos", "group_pos", "method"]]

    return met.groupBy("run_id", "group_pos").applyInPandas(split, schema)


def fallback_rules(run_topics: DataFrame) -> DataFrame:
    """Keywords of a topic without rules: its label, subtopic, and their words of more than three letters; default negations."""
    label, sub = F.lower(F.coalesce("canonical_label", F.lit(""))), F.lower(F.coalesce("canonical_subtopic", F.lit("")))
    words = F.filter(F.concat(F.split(label, r"\s+"), F.split(sub, r"\s+")), lambda w: F.length(w) > 3)
    terms = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(label, sub), words), lambda w: F.length(w) > 0)))
    return run_topics.select("topic_id", F.array_join(terms, " | ").alias("keywords"), F.lit(" | ".join(NEGATION_PATTERNS)).alias("negations"))


def label_totals(run_topics: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volumes by label over all runs: times it occurs, its verbatims, and the subtopic that comes first."""
    return run_topics.join(volumes.select("topic_id", "volume_verbatims"), "topic_id").groupBy("canonical_label").agg(
        F.count("*").alias("topics"), F.sum("volume_verbatims").alias("verbatims"), F.min("canonical_subtopic").alias("subtopic")
    )


def near_labels(run_topics: DataFrame, above: float = 0.85) -> DataFrame:
    """Pairs (a, b, score) of distinct labels of all runs that are more similar than `above`; a label occurs once however often it is used."""
    l = run_topics.where(F.length("canonical_label") > 0).select(F.col("canonical_label").alias("label")).distinct()
    l = l.withColumns({"n": F.length("label"), "masks": char_masks(F.col("label"))})
    # The lengths of a pair above the bound are within a factor of each other: classes of that factor meet themselves and the next.
    ratio = above / (2 - above)
    l = l.withColumn("class", F.floor(F.log("n") / -F.log(F.lit(ratio)) + 1e-9))
    a = l.select(F.col("label").alias("x"), "masks", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("own"))
    met = a.join(l.select(F.col("label").alias("y"), "class"), "class").where((F.col("class") > F.col("own")) | (F.col("x") < F.col("y")))
    score = F.round(indel_ratio_any(F.col("x"), F.col("y"), F.col("masks")), 9)
    return met.withColumn("score", score).where(F.col("score") > above).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score").distinct()
