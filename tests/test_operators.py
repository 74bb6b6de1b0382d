import pytest
from pyspark.sql import functions as F

from verbatlas.functions.similarity import indel_ratio
from verbatlas.operators import dedup, importing, merging, relational, sampling
from verbatlas.operators.graph import components
from verbatlas.operators.skew import attach_group
from verbatlas.plans import analysis


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got[1] == got[2] == got[3] == 1 and got[11] == 10 and 5 not in got and got[160] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "the quick brown fox jumps over the lazy dog again and again todax"), (3, "the quick brown fox jumps over the lazy dog again and again today"), (4, ""), (5, None), (6, "something else"), (7, "the quick brown fox jumps over the lazy dog again and again toddx")]


def test_exact_pairs_against_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    got = {(r.a, r.b): r.score for r in dedup.similar_pairs(df, "id", "text", 0.9, "exact").collect()}
    first = {}
    for i, t in TEXTS:
        first.setdefault(t or "", i)
    reps = [(i, t) for t, i in first.items()]
    exp = {(a, b): indel_ratio(x, y) for a, x in reps for b, y in reps if a < b and x and y and indel_ratio(x, y) >= 0.9}
    assert got == pytest.approx(exp)


def test_shingle_pairs_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {0: base, 1: base[:-1] + ["x"], 2: base[:30] + ["y"] + base[31:], 3: list(reversed(base)), 4: base + base[:4]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    shingles = {i: {tuple(t[k : k + 5]) for k in range(len(t) - 4)} for i, t in texts.items()}
    exp = {(a, b) for a in texts for b in texts if a < b and len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8}
    assert {(r.a, r.b) for r in dedup.shingle_candidates(dedup._distinct_texts(df, "id", "text")).collect()} == exp


def test_classes_keep_every_row(spark):
    df = spark.createDataFrame(TEXTS, "id long, text string").withColumn("class_id", F.lit("clash"))
    got = dict((r.id, r.class_id) for r in dedup.duplicate_classes(df, "id", "text", 0.9, "exact").collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 1}
    empty = dedup.duplicate_classes(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert empty.count() == 0 and dedup.dedup_stats(empty, "id").first().before == 0


@pytest.mark.parametrize("mode", ["exact", "shingles"])
def test_classes_stay_within_a_group(spark, mode):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "a", long), (2, "b", long), (3, "b", long + " more"), (4, None, long), (5, None, long), (6, "a", None), (7, "b", "")]
    df = spark.createDataFrame(rows, "id long, p string, text string")
    got = {r.id: r.class_id for r in dedup.duplicate_classes(df, "id", "text", 0.9, mode, "p").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}


def test_shingle_pairs_need_no_ratio(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(1, " ".join(base)), (2, " ".join(base + [f"footerword{i}" for i in range(13)])), (3, "😊"), (4, "!!!"), (5, None)]
    pairs = dedup.similar_pairs(spark.createDataFrame(texts, "id long, text string"), "id", "text", 0.9).collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 2)] and pairs[0].score < 0.9


def test_exact_pairs_in_blocks_against_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(dedup, "BLOCK", 7)
    rng, texts = random.Random(5), []
    for i in range(40):
        t = "".join(rng.choices("abcdé 😊", k=rng.choice([1, 5, 30, 60])))
        texts += [(t, rng.choice("pq"))] + [("".join(c for c in t if rng.random() > p) + "x" * rng.randrange(3), rng.choice("pq")) for p in (0.02, 0.05, 0.1)]
    df = spark.createDataFrame([(i, p, t) for i, (t, p) in enumerate(texts)], "id long, p string, text string")
    first = {}
    for i, (t, p) in enumerate(texts):
        first.setdefault((p, t), i)
    exp = {(i, j): indel_ratio(t, u) for (p, t), i in first.items() for (q, u), j in first.items() if i < j and p == q and t and u and indel_ratio(t, u) >= 0.9}
    got = [(r.a, r.b, r.score) for r in dedup.similar_pairs(df, "id", "text", 0.9, "exact", "p").collect()]
    assert len(got) == len(exp) > 20 and {(a, b): x for a, b, x in got} == pytest.approx(exp)


def test_pipeline_keeps_a_text_in_each_project(spark):
    text = "Le flacon fuit toujours et le parfum manque vraiment de tenue."
    df = spark.createDataFrame([(1, "a", text), (2, "b", text), (3, "b", text)], "ord long, project_id string, full_text string")
    assert rows(analysis.Pipeline().run(df)["texts"].select("ord")) == [(1,), (2,)]


def test_quotas(spark):
    strata = spark.createDataFrame([("a", 500), ("b", 50), ("c", 5)], "stratum string, rows long")
    q = {r.stratum: r.quota for r in sampling.quotas(strata, 100, 10, 60).collect()}
    assert q == {"a": 60, "b": 17, "c": 11} and sum(q.values()) <= 100
    q = {r.stratum: r.quota for r in sampling.quotas(strata, 20, 10, 60).collect()}
    assert q == {"a": 6, "b": 6, "c": 6}


def test_sample_takes_small_tables_whole(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "ord long, s string")
    assert sampling.stratified_sample(df, "ord", ("s",), 100, 2, 30).count() == 20
    assert sampling.stratified_sample(df, "ord", ("s",), 10, 2, 30).count() == 10


def test_import(spark):
    assert importing.detect_source(["Full Text", "Query Id", "Page Type", "Sentiment"]) == "brandwatch"
    assert importing.detect_source(["full text"]) == "generic_csv" and importing.detect_source(["FULL TEXT"], "lenient") == "brandwatch"
    df = spark.createDataFrame([("a", "2024-01-02", None, "x"), (None, "n/a", "b", "y"), ("c", "03/04/2024 05:06", "d", None)], ["review_text", "review_date", "Marque", "REVIEW_ID"])
    v = importing.to_verbatims(df, "p", detection="lenient").orderBy("ord").collect()
    assert [(r.ord, r.full_text, r.source_id, r.extra_data) for r in v] == [(0, "a", "x", {}), (1, "c", None, {"Marque": "d"})]
    assert [str(r.source_instant) for r in v] == ["2024-01-02 00:00:00", "2024-04-03 05:06:00"]
    with pytest.raises(ValueError):
        importing.to_verbatims(spark.createDataFrame([("a",)], ["z"]), "p")
    with pytest.raises(ValueError):
        importing.guard(spark.range(11), 10)


def test_merging(spark):
    t = spark.createDataFrame(
        [("r", "t1", 0, "Prix", "élevé", ["prix"]), ("r", "t2", 0, "Prix", "élevés", ["PRIX", "cher"]), ("r", "t3", 1, "", None, ["odeur forte"]), ("r", "t4", 2, None, None, None), ("s", "t5", 0, "Prix", "élevé", [])],
        "run_id string, topic_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>",
    )
    labels = merging.topic_labels(t)
    groups = merging.merge_groups(labels, merging.merge_pairs(labels, merging.pivot_words(labels, "run_id")))
    m = {(r.run_id, r.group_pos): r for r in merging.merged_topics(t, groups).collect()}
    assert m["r", 0].aliases == "Prix > élevés" and m["r", 0].keywords == "PRIX | cher | prix" and m["r", 0].method == "pass1_algo"
    assert m["r", 2].label == "odeur forte" and m["s", 0].method == "single"


def test_long_labels_merge(spark):
    long = "délai de livraison du colis chez le transporteur partenaire pendant les fêtes"
    t = spark.createDataFrame([("r", "t1", 0, long, "a", []), ("r", "t2", 1, long + "s", "a", []), ("r", "t3", 2, "prix", None, [])], "run_id string, topic_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>")
    labels = merging.topic_labels(t)
    none = labels.select("run_id", "topic_id", F.lit("").alias("pivots"))
    assert [(r.a, r.b, r.score) for r in merging.merge_pairs(labels, none).collect()] == [(0, 1, pytest.approx(indel_ratio(long + " | a", long + "s | a")))]
    assert [r.score for r in merging.near_labels(t).collect()] == [pytest.approx(indel_ratio(long, long + "s"))]


def test_cascade(spark):
    p = spark.createDataFrame([("a",), ("b",)], ["id"])
    r = spark.createDataFrame([("r1", "a"), ("r2", "b")], ["id", "project_id"])
    t = spark.createDataFrame([("t1", "r1"), ("t2", "r2")], ["id", "run_id"])
    left = relational.cascade_delete({"p": (p, "id", None, None), "r": (r, "id", "p", "project_id"), "t": (t, "id", "r", "run_id")}, "p", spark.createDataFrame([("a",)], ["key"]))
    assert [rows(left[k]) for k in "prt"] == [[("b",)], [("r2", "b")], [("t2", "r2")]]


def test_attach_group_with_a_hot_key(spark):
    data = spark.range(5000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = data.groupBy("k").agg(F.min("id").alias("lo"), F.count("*").alias("n"))
    got = attach_group(data, groups, "k", 5000)
    assert got.count() == 5000 and got.where("k = 'hot'").agg(F.max("lo")).first()[0] == 0
