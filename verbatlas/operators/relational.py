"""Project and run listings, views and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import MERGE_METHODS, RUN_MODES, RUN_STATUSES, SOURCE_TYPES


def projects_with_counts(projects: DataFrame, verbatims: DataFrame) -> DataFrame:
    """All projects with their verbatims' number, 0 included; counted before the join."""
    n = verbatims.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("verbatims"))
    return projects.select("id", "name", "created_at").join(n, "id", "left").withColumn("verbatims", F.coalesce("verbatims", F.lit(0)).cast("long"))


def recent_projects(projects: DataFrame, verbatims: DataFrame, n: int = 5) -> DataFrame:
    return projects_with_counts(projects, verbatims).orderBy(F.desc("created_at"), "id").limit(n)


def runs_list(runs: DataFrame, projects: DataFrame, topics: DataFrame, statuses: tuple[str, ...] = ("success",)) -> DataFrame:
    """Runs of some statuses with project name and number of topics, active or not."""
    n = topics.groupBy(F.col("run_id").alias("id")).agg(F.count("topic_id").alias("topics"))
    r = runs.where(F.col("status").isin(*statuses)).join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    return r.join(n, "id", "left").select("id", "project_id", "project_name", "mode", "created_at", F.coalesce("topics", F.lit(0)).cast("long").alias("topics"))


def run_summary(runs: DataFrame, projects: DataFrame, topics: DataFrame) -> DataFrame:
    """Each run with project name, seconds it took (null if it has no end) and number of distinct active topics."""
    n = topics.where("is_active").groupBy(F.col("run_id").alias("id")).agg(F.count_distinct("topic_id").alias("topic_count"))
    r = runs.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id").join(n, "id", "left")
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return r.select(
        "id", "project_id", "project_name", "mode", "status", "total_verbatims", "verbatims_after_dedup", "total_chunks", "chunks_success", "chunks_failed", "gida_version",
        seconds.alias("duration_seconds"), F.coalesce("topic_count", F.lit(0)).cast("long").alias("topic_count"),
    )


def topics_with_runs(topics: DataFrame, runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Active topics with their run's mode and project's name."""
    r = runs.select(F.col("id").alias("run_id"), "project_id", F.col("mode").alias("run_mode"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return topics.where("is_active").join(r, "run_id").join(p, "project_id").select("topic_id", "run_id", "canonical_label", "canonical_subtopic", "merge_method", "run_mode", "project_name")


def run_options(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """A line for people per run: project, mode, start of the brief, date and number of texts."""
    r = runs.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name")), "project_id")
    line = F.concat_ws(" - ", "project_name", "mode", F.substring(F.coalesce("brief", F.lit("")), 1, 50), F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.concat(F.format_number(F.coalesce("total_verbatims", F.lit(0)), 0), F.lit(" texts")))
    return r.select("id", line.alias("line"))


def project_lines(projects: DataFrame, verbatims: DataFrame) -> DataFrame:
    """A line for people per project: name, date and number of texts."""
    p = projects_with_counts(projects, verbatims)
    return p.select("id", F.concat_ws(" - ", "name", F.date_format("created_at", "yyyy-MM-dd HH:mm"), F.format_number("verbatims", 0)).alias("line"))


def run_verbatims(verbatims: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """All verbatims of a run's project."""
    one = runs.where(F.col("id") == run_id).select("project_id").distinct()
    return verbatims.join(F.broadcast(one), "project_id", "left_semi")


def value_counts(verbatims: DataFrame, column: str) -> DataFrame:
    """Verbatims by project and value, nulls left out."""
    return verbatims.where(F.col(column).isNotNull()).groupBy("project_id", column).agg(F.count("*").alias("verbatims"))


def recurrent_labels(topics: DataFrame, more_than: int = 3) -> DataFrame:
    return topics.groupBy("canonical_label").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("ontology_version", "entity_type").agg(F.count("*").alias("entries"))


def violations(projects: DataFrame, runs: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows that break a constraint on values: (table, column, value, rows). Null values break none."""

    def bad(df: DataFrame, name: str, column: str, allowed: tuple[str, ...]) -> DataFrame:
        wrong = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        return wrong.groupBy(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.col(column).alias("value")).agg(F.count("*").alias("rows"))

    return (
        bad(projects, "projects", "source_type", SOURCE_TYPES)
        .unionByName(bad(runs, "analysis_runs", "mode", RUN_MODES))
        .unionByName(bad(runs, "analysis_runs", "status", RUN_STATUSES))
        .unionByName(bad(topics, "run_topics", "merge_method", MERGE_METHODS))
    )


def cascade_delete(tables: dict[str, tuple[DataFrame, str, str | None, str | None]], root: str, keys: DataFrame) -> dict[str, DataFrame]:
    """What is left of tables after rows of `root` with `keys` (column `key`) and all that refer to them are deleted.

    tables: name → (rows, own key, name of the table referred to, column that refers); parents first.
    """
    gone, left = {root: keys}, {}
    for name, (df, own, parent, ref) in tables.items():
        if name == root:
            hit = df.join(keys, df[own] == keys["key"], "left_semi")
        elif parent in gone:
            k = gone[parent].withColumnRenamed("key", "_gone")
            hit = df.join(k, df[ref] == k["_gone"], "left_semi")
        else:
            left[name] = df
            continue
        gone[name] = hit.select(F.col(own).alias("key"))
        left[name] = df.join(gone[name].withColumnRenamed("key", "_gone"), df[own] == F.col("_gone"), "left_anti")
    return left


def register_views(spark: SparkSession, runs: DataFrame, projects: DataFrame, topics: DataFrame) -> None:
    run_summary(runs, projects, topics).createOrReplaceTempView("v_run_summary")
    topics_with_runs(topics, runs, projects).createOrReplaceTempView("v_topics_with_metrics")


def probe(spark: SparkSession) -> dict[str, object]:
    """Whether the session answers, its version, and how many tables it knows."""
    return {"answers": spark.sql("SELECT 1").first()[0] == 1, "version": spark.version, "tables": len(spark.catalog.listTables())}


def table_stats(spark: SparkSession) -> DataFrame:
    """The session's tables and views."""
    return spark.createDataFrame([(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()], "name string, temporary boolean")
