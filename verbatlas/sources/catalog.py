"""Tables of the engine in a catalog, and tables of other databases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "projects": "id string, name string, description string, source_type string, created_at timestamp, updated_at timestamp, metadata string",
    "project_verbatims": "verbatim_id string, project_id string, ord bigint, full_text string, full_text_clean string, source_id string, source_date string, sentiment string, language string, page_type string, category string, author string, url string, dedup_flag boolean, dedup_group_id string, extra_data map<string,string>, created_at timestamp",
    "analysis_runs": "id string, project_id string, mode string, brief string, clean_params string, dedup_threshold double, status string, total_verbatims int, verbatims_after_dedup int, total_chunks int, chunks_success int, chunks_failed int, gida_version string, started_at timestamp, completed_at timestamp, created_at timestamp, estimated_cost double, estimated_time_seconds int",
    "analysis_chunks": "id string, run_id string, chunk_index int, verbatim_ids array<string>, status string, llm_response string, tokens_used int, cost double, error string",
    "chunk_topics": "id string, chunk_id string, topic_label string, subtopic_label string, pain_points array<string>, benefits array<string>, usage_context string, example_verbatims array<string>",
    "run_topics": "topic_id string, run_id string, topic_ord int, canonical_label string, canonical_subtopic string, aliases array<string>, merge_method string, keywords array<string>, negative_keywords array<string>, regex_patterns array<string>, is_active boolean",
    "project_ontology": "id string, run_id string, topic_id string, keywords array<string>, regex_patterns array<string>, negative_keywords array<string>, negation_patterns array<string>",
    "run_entities": "run_id string, verbatim_id string, entity_type string, entity_label string, mention_count int",
    "dim_entities": "ontology_version string, entity_type string, label string, label_normalized string, keywords array<string>, parent string",
    "dim_attributes": "ontology_version string, label string, label_normalized string, keywords array<string>",
    "processing_logs": "run_id string, log_type string, step string, message string, details string, created_at timestamp",
}
PARTITIONED = {"project_verbatims": "project_id", "dim_entities": "ontology_version"}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    for name, schema in SCHEMAS.items():
        by = f" PARTITIONED BY ({PARTITIONED[name]})" if name in PARTITIONED else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet{by}")
    return list(SCHEMAS)


def seed_dictionary(spark: SparkSession, entries: list[tuple], version: str) -> DataFrame:
    """Rows of dim_entities from (type, label, keywords) of a list that a person writes."""
    rows = [(version, kind, label, label.lower(), list(words), None) for kind, label, words in entries]
    return spark.createDataFrame(rows, SCHEMAS["dim_entities"])


def drop_tables(spark: SparkSession, database: str, confirmed: bool = False) -> None:
    """Drops all tables of the engine, only if told that this is meant."""
    if not confirmed:
        raise ValueError("dropping tables needs confirmed=True")
    for name in SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def statements(script: str) -> list[str]:
    """The statements of an SQL script; semicolons in quotes, dollar quotes and comments end none."""
    parts = re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|\$(\w*)\$.*?\$\1\$|--[^\n]*|/\*.*?\*/|;|[^;'\"$/-]+|.", script, re.S)
    out, held = [], ""
    for m in parts:
        if m.group() == ";":
            out.append(held.strip())
            held = ""
        elif not m.group().startswith(("--", "/*")):
            held += m.group()
    return [s for s in [*out, held.strip()] if s]


def run_script(spark: SparkSession, path: str) -> int:
    """Runs the statements of a script in turn; their number."""
    with open(path, encoding="utf-8") as f:
        todo = statements(f.read())
    for s in todo:
        spark.sql(s)
    return len(todo)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of another database; with a numeric key and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
