"""Topic queries on a skewed project: the rules meet kinds of texts, not texts, and results equal SQL on every path."""

import contract
import pytest

from verbatlas.operators import topics
from verbatlas.queries import reference

QUERIES = "coverage_kpi keyword_sheet topic_keyword_counts topic_summary enriched_verbatims label_groupby_merge topic_metrics topic_summary_top10 explorer_matches slide_table topic_sheet topics_without_match".split()
ROW_WISE = {"topic_summary", "explorer_matches", "enriched_verbatims"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Project p has most texts and topics; q has few, r texts only."""
    d = str(tmp_path_factory.mktemp("skewed"))
    bits = ["prix rouge", "pas de prix", "odeur et Prix", "rien", "", None, "sans odeur mais prix", "été zzz odeur", "rougeurs"]
    v = [(i, "p" if i % 5 else "qr"[i % 2], bits[i % len(bits)]) for i in range(270)] + [(270, None, "prix")]
    spark.createDataFrame(v, "ord long, project_id string, full_text string").write.parquet(f"{d}/project_verbatims.parquet")
    words = ["prix", "odeur", "été", "Prix", "", "rien"]
    t = [(f"t{k}", "s" if k % 4 == 3 else "r1" if k % 2 else "r2", k, f"L{k % 3}" if k else None, "x" if k % 2 else None, words[k % 6 :][:3], ["zzz"] if k % 3 == 0 else None, ["rou(ge|x)", "t.$"] if k % 4 == 0 else [], k != 5) for k in range(24)]
    spark.createDataFrame(t, "topic_id string, run_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>, negative_keywords array<string>, regex_patterns array<string>, is_active boolean").write.parquet(f"{d}/run_topics.parquet")
    spark.createDataFrame([("r1", "p"), ("r2", "p"), ("s", "q"), ("u", "r")], "id string, project_id string").write.parquet(f"{d}/analysis_runs.parquet")
    spark.createDataFrame([("brand", "x", ["rouge"]), ("zone", "y", ["odeur", ""]), ("zone", "z", ["prix"])], "entity_type string, label string, keywords array<string>").write.parquet(f"{d}/dim_entities.parquet")
    return d


@pytest.mark.parametrize("name", QUERIES)
def test_equal_to_sql_and_rules_meet_kinds_of_texts(spark, folder, name, monkeypatch):
    import duckdb

    con = duckdb.connect()
    for t in ("project_verbatims", "run_topics", "analysis_runs", "dim_entities"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = contract.rows(con.sql(reference.SQL[name]).df())
    met, swept = [], topics._swept
    monkeypatch.setattr(topics, "_swept", lambda rows, *a, **k: (met.append(rows), swept(rows, *a, **k))[1])
    monkeypatch.setattr(topics, "LEAST_HOT", 20)
    assert contract.rows(reference.QUERIES[name](spark, folder).toPandas()) == want
    assert met and (name in ROW_WISE or met[-1].count() <= 21)  # seven kinds of texts in three projects, of 271 texts
    monkeypatch.setattr(topics, "BROADCAST_RULES", 2)
    assert contract.rows(reference.QUERIES[name](spark, folder).toPandas()) == want
