import json
import random

import pytest
from pyspark.sql import functions as F

from verbatlas.config import NEGATION_PATTERNS
from verbatlas.operators import dedup, importing, merging, sampling
from verbatlas.plans import analysis
from verbatlas.sources import catalog, files, sinks


def test_rows_are_numbered_in_the_order_of_the_input(spark):
    df = spark.range(1000).repartitionByRange(7, "id").select((F.col("id") * 2).alias("x"))
    got = {r.x: r.ord for r in importing.number_rows(df).collect()}
    assert got == {2 * i: i for i in range(1000)} and importing.number_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", ["1", "6"])
def test_places_in_groups_against_brute_force(spark, partitions):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(3000)] + [("lone", 9999)]
    rng.shuffle(rows)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {(r.g, r.ord): r.pos for r in sampling.group_places(spark.createDataFrame(rows, "g string, ord long"), "ord", "g").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", held)
    by = {}
    for g, i in sorted(rows, key=lambda x: x[1]):
        by.setdefault(g, []).append(i)
    assert got == {(g, i): k for g, ids in by.items() for k, i in enumerate(ids)}
    assert sampling.chunks(spark.createDataFrame([], "g string, ord long"), "ord", "g").count() == 0


def test_import_of_a_project(spark):
    raw = spark.createDataFrame([("a", "x", "1"), (None, "y", "2")], ["Texte", "Marque", "Full Text2"])
    project, rows = importing.import_project(raw, "p", "Name", mapping={"Texte": "full_text", "Marque": "brand"})
    assert project.first().name == "Name" and json.loads(project.first().metadata)["original_rows"] == "2"
    assert [(r.full_text, r.extra_data) for r in rows.collect()] == [("a", {"brand": "x", "Full Text2": "1"})]
    for wrong in ({"Texte": "nothing"}, {"Texte": "full_text", "Marque": "full_text"}):
        with pytest.raises(ValueError):
            importing.import_project(raw, "p", "Name", mapping=wrong)
    with pytest.raises(ValueError):
        importing.import_project(raw, "p", "Name", mapping={"Texte": "full_text"}, most=1)


def test_exports_encodings_and_previews(spark, tmp_path):
    for name, code in (("u", "utf-8"), ("l", "latin-1")):
        (tmp_path / f"{name}.csv").write_bytes('text;n\n"été ""chaud""\nici";1\nb;2\n'.encode(code))
    assert files.encoding_of(spark, f"{tmp_path}/u.csv") == "UTF-8" and files.encoding_of(spark, f"{tmp_path}/l.csv") == "ISO-8859-1"
    for name in "ul":
        assert files.read_export(spark, f"{tmp_path}/{name}.csv", ";").first().text == 'été "chaud"\nici'
    assert files.preview(spark, f"{tmp_path}/u.csv", 1, delimiter=";").count() == 1


def test_dictionary_versions_are_replaced(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"version": "v1", "entities": [{"entity_type": "brand", "label": "A", "label_normalized": "a", "keywords": ["a"], "parent": None}, {"entity_type": "attribute", "label": "B", "label_normalized": "b", "keywords": [], "parent": None}]}))
    entries = files.read_dictionary(spark, f"{tmp_path}/d.json")
    assert entries.count() == 2
    files.write_dictionary(entries, f"{tmp_path}/dim")
    files.write_dictionary(catalog.seed_dictionary(spark, [("brand", "C", ["c"])], "v2"), f"{tmp_path}/dim")
    files.write_dictionary(catalog.seed_dictionary(spark, [("brand", "D", ["d"])], "v2"), f"{tmp_path}/dim")
    assert sorted((r.ontology_version, r.label) for r in spark.read.parquet(f"{tmp_path}/dim").collect()) == [("v1", "A"), ("v1", "B"), ("v2", "D")]


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("p", 1, "é,\"x\""), ("q", 2, None)], "project_id string, ord long, full_text string")
    sinks.append_verbatims(v, f"{tmp_path}/v")
    sinks.append_verbatims(v, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").where("project_id = 'p'").count() == 2
    sinks.write_csv(v, f"{tmp_path}/csv", single=True)
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").where("ord = 1").first().full_text == 'é,"x"'
    sinks.write_json(v, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    sinks.write_text(spark, analysis.run_metadata(b=1, a="é"), f"{tmp_path}/meta")
    assert json.loads(spark.read.text(f"{tmp_path}/meta").first().value) == {"a": "é", "b": 1}
    t = spark.createDataFrame([("r", "t1", 1, "B", None, ["x"], None, None, None), ("r", "t0", 0, None, "s", None, ["k"], ["a("], ["n"])], "run_id string, topic_id string, topic_ord int, canonical_label string, canonical_subtopic string, aliases array<string>, keywords array<string>, regex_patterns array<string>, negative_keywords array<string>")
    topics_ = json.loads(sinks.ontology_json(t).first().json)["topics"]
    assert [x["label"] for x in topics_] == ["", "B"] and topics_[0]["keywords"] == ["k"] and topics_[1]["negation_patterns"] == list(NEGATION_PATTERNS)


def test_report_and_sheets(spark, tmp_path):
    m = spark.createDataFrame([("t1", "Prix", "élevé", 3, 4, 30.0, ["cher"] * 7, None, [f"k{i}" for i in range(12)]), ("t2", None, None, 0, 0, 0.0, None, None, None)], "topic_id string, canonical_label string, canonical_subtopic string, volume_verbatims long, volume_mentions long, pct_of_dataset double, pain_points array<string>, benefits array<string>, keywords array<string>")
    text = sinks.markdown_report("Report", 10, m)
    assert "| 1 | Prix | 3 | 30.0% | 4 |" in text and "Topics: 2, with matches: 1, without: 1" in text and text.count("- cher") == 5 and "k9" in text and "k10" not in text and "Subtopic: élevé" in text
    enriched = spark.createDataFrame([(2, "a"), (1, "b")], "ord long, topics string")
    keywords = spark.createDataFrame([("t1", "k", "keyword", 2)], "topic_id string, term string, kind string, verbatims long")
    sheets = sinks.report_sheets(enriched, m, keywords)
    assert list(sheets) == ["Verbatims", "Topics", "Keywords"] and sheets["Verbatims"].first().ord == 1
    sinks.write_workbook({k: df.drop("pain_points", "benefits", "keywords") for k, df in sheets.items()}, f"{tmp_path}/book")


def test_merged_topics_unite_their_points(spark):
    t = spark.createDataFrame(
        [("r", "a", 0, "", None, ["k"], ["p1", "p2"], [], "ctx", [f"e{i}" for i in range(8)]), ("r", "b", 1, "Prix", "s", [], ["p2", "p3"], ["b1"], "other", [f"f{i}" for i in range(8)]), ("r", "c", 2, None, None, None, None, ["b" * 60], None, None)],
        "run_id string, topic_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>, pain_points array<string>, benefits array<string>, usage_context string, example_verbatims array<string>",
    )
    groups = spark.createDataFrame([("r", 0, 0, "pass1_algo"), ("r", 1, 0, "pass1_algo"), ("r", 2, 2, "single")], "run_id string, pos int, group_pos int, method string")
    m = {r.group_pos: r for r in merging.merged_topics(t, groups).collect()}
    assert m[0].label == "p1" and m[0].pain_points == ["p1", "p2", "p3"] and m[0].benefits == ["b1"] and len(m[0].example_verbatims) == 10 and m[0].usage_context == "ctx"
    assert m[2].label == "b" * 50 and m[2].pain_points == []
    info = merging.merge_info(groups, spark.createDataFrame([("r", 0, 1, 0.95)], "run_id string, a int, b int, score double")).first()
    assert info.asDict() == {"run_id": "r", "topics_in": 3, "topics_out": 2, "pairs": 1, "groups": 1, "singles": 1, "model_calls": 0}
    apart = merging.second_pass(groups, t, lambda pdf: list(range(len(pdf))))
    assert sorted((r.pos, r.group_pos, r.method) for r in apart.collect()) == [(0, 0, "single"), (1, 1, "single"), (2, 2, "single")] and merging.second_pass(groups, t) is groups


def test_last_of_a_class_and_group_ids(spark):
    c = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 3, 0)], "id long, class_id long, links long")
    assert sorted(r.id for r in dedup.keep_last(c, "id").collect()) == [3, 5]
    ids = dedup.group_ids(c, "id", "p").collect()
    assert sorted(r.id for r in ids) == [1, 5] and len({r.dedup_group_id for r in ids}) == 1


def test_rules_by_a_model(spark):
    t = spark.createDataFrame([("a", "Prix"), ("b", "Odeur forte"), ("c", None)], "topic_id string, canonical_label string").withColumn("canonical_subtopic", F.lit(None).cast("string"))

    def model(texts):
        if "Odeur" in texts[0]:
            return "no JSON"
        return '```json\n{"keywords": ["prix", 3], "negation_patterns": []}\n```'

    got = {r.topic_id: r for r in analysis.generated_rules(t, model).collect()}
    assert got["a"].keywords == ["prix", "3"] and got["a"].negation_patterns == list(NEGATION_PATTERNS) and got["a"].source == "model"
    assert got["b"].source == "fallback" and got["b"].keywords == ["forte", "odeur", "odeur forte"]


def test_calls_are_tried_again():
    tried, waited = [], []

    def weak(texts):
        tried.append(1)
        if len(tried) < 3:
            raise ConnectionError
        return "{}"

    assert analysis.with_retries(weak, 3, waited.append)(["x"]) == "{}" and waited == [0, 1]
    with pytest.raises(TypeError):
        analysis.with_retries(lambda t: t + 1, 3, waited.append)(["x"])
    assert analysis.answers(lambda t: "ok") and not analysis.answers(lambda t: 1 / 0)
    assert analysis.topic_lines([("A", "b"), ("C", None)]) == "1. A > b\n2. C" and "N/A" in analysis.rules_prompt("A")[1]


def test_estimate_counts_the_prompt(spark):
    v = spark.createDataFrame([(i, "p", "x" * 8) for i in range(450)], "ord long, project_id string, full_text string")
    c = sampling.chunks(v, "ord", "project_id")
    plain, full = sampling.estimate(c, v, "ord", "project_id").first(), sampling.estimate(c, v, "ord", "project_id", brief="b" * 100, prompt="p" * 300).first()
    assert (plain.chunks, plain.tokens_in, plain.seconds) == (3, 1200, 9) and full.tokens_in == 1500
