"""Topic queries read and join no more than they need: metrics come out of the sweep, texts are counted by signature, rules leave as they are."""

import contract
import pytest
from test_topic_sweep import swept
from test_topics_at_size import folder  # noqa: F401

from verbatlas.operators import topics
from verbatlas.queries import reference

METRICS = "topic_metrics label_groupby_merge topic_summary_top10 slide_table topics_without_match".split()


@pytest.fixture(scope="module")
def repeated(spark, folder, tmp_path_factory):  # noqa: F811
    """The folder with topic t0 in a second project, a topic without id, one of a run without project, and ord 3 twice."""
    d = str(tmp_path_factory.mktemp("repeated"))
    t = spark.read.parquet(f"{folder}/run_topics.parquet")
    more = [("t0", "s", 1, "B", None, ["rien", "prix"], None, [], True), (None, "s", 2, None, None, ["prix"], [], None, True), ("w", "x", 3, "W", None, ["prix"], [], ["prix", None], True), ("v", "u", 4, "V", None, ["Odeur", None, ""], ["", None], None, True)]
    t.unionByName(spark.createDataFrame(more, t.schema)).write.parquet(f"{d}/run_topics.parquet")
    r = spark.read.parquet(f"{folder}/analysis_runs.parquet")
    r.unionByName(spark.createDataFrame([("x", None)], r.schema)).write.parquet(f"{d}/analysis_runs.parquet")
    v = spark.read.parquet(f"{folder}/project_verbatims.parquet")
    v.unionByName(spark.createDataFrame([(3, "q", "prix rouge")], v.schema)).write.parquet(f"{d}/project_verbatims.parquet")
    spark.read.parquet(f"{folder}/dim_entities.parquet").write.parquet(f"{d}/dim_entities.parquet")
    return d


def wanted(folder, name):  # noqa: F811
    import duckdb

    con = duckdb.connect()
    for t in ("project_verbatims", "run_topics", "analysis_runs", "dim_entities"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return contract.rows(con.sql(reference.SQL[name]).df())


@pytest.mark.parametrize("name", METRICS)
def test_metrics_come_out_of_the_sweep(spark, folder, name, monkeypatch):  # noqa: F811
    _, given, out = swept(spark, folder, name, monkeypatch)
    assert {"volume_verbatims", "volume_mentions", "n"} <= {*given.columns}
    plan = topics.topic_metrics(*reference._topics(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("project_verbatims.parquet") == 1
    assert out == wanted(folder, name)


@pytest.mark.parametrize("name", ["topic_metrics", "topic_summary_top10", "topics_without_match"])
def test_topics_listed_twice_or_without_project(spark, repeated, name):
    """A topic of two projects has the sum of both; one without id, project or texts has none."""
    assert contract.rows(reference.QUERIES[name](spark, repeated).toPandas()) == wanted(repeated, name)


def test_topics_without_project_or_texts_have_no_matches(spark, repeated):
    v, rules = reference._topics(spark, repeated)
    m = {r.topic_id: r for r in topics.topic_metrics(v, rules.where("topic_id <> 't0'")).collect()}
    assert m["w"].volume_verbatims == 0 and m["w"].pct_of_dataset == 0 and m["w"].run_id == "x"
    assert m["v"].volume_verbatims == 6 and m["v"].volume_mentions == 1


def test_texts_are_summed_up_by_signature(spark, folder, repeated, monkeypatch):  # noqa: F811
    args, _, out = swept(spark, folder, "topic_summary", monkeypatch)
    assert "n" in args[0].columns and args[0].count() <= 21 and out == wanted(folder, "topic_summary")
    args, _, out = swept(spark, repeated, "topic_summary", monkeypatch)
    assert "n" not in args[0].columns and out == wanted(repeated, "topic_summary")  # ord 3 counts once


def test_rules_leave_with_their_labels_as_they_are(spark, folder, repeated, monkeypatch):  # noqa: F811
    """Labels are grouped by topic only where a topic is listed twice."""
    args, _, out = swept(spark, folder, "enriched_verbatims", monkeypatch)
    plan = args[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "to_json" not in plan and out == wanted(folder, "enriched_verbatims")
    args, _, _ = swept(spark, repeated, "enriched_verbatims", monkeypatch)
    assert "Aggregate" in args[1]._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_made_once_for_texts_with_the_same_words():
    entries = [("a", "x", ["rouge", "vert"]), ("a", "w", ["vert"]), ("b", "x", ["rouge"]), ("b", None, ["bleu"]), ("c", "z", ["vert"]), ("b", "v", [])]
    labels = topics._labeler(entries, ("a", "b"))
    for texts in (["rouge", "vert rouge", "", None, "bleu", "rouge vert"], ["rouge"] * 3, []):
        want = [tuple(" | ".join(sorted(label for t, label, words in entries if t == kind and label and any(w in (x or "") for w in words))) for kind in ("a", "b")) for x in texts]
        assert [*zip(*[c.to_pylist() for c in labels(texts)])] == want
    assert labels(["rouge"] * 5)[0].to_pylist() == ["x"] * 5
    assert topics._labeler([], ("a",))(["rouge", None])[0].to_pylist() == ["", ""]
