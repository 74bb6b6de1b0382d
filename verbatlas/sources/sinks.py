"""Exports: CSV, JSON, Markdown, and a workbook where a writer is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.matching import default_negations


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files with headers, or of one file, through which a single task then writes all rows."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_verbatims(verbatims: DataFrame, path: str) -> None:
    """Adds verbatims to a table of files, a folder per project."""
    verbatims.write.mode("append").partitionBy("project_id").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text as the one file of a folder: metadata and reports."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def ontology_json(topics: DataFrame) -> DataFrame:
    """One JSON object per run, {"topics": [...]}, with every topic's label, sublabel, aliases and rules in order; a run has a few hundred topics."""
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))
    one = F.struct(
        text("canonical_label").alias("label"), text("canonical_subtopic").alias("sublabel"), *[F.coalesce(c, none).alias(c) for c in ("aliases", "keywords", "regex_patterns", "negative_keywords")], default_negations().alias("negation_patterns")
    )
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic_id", one.alias("topic")))), lambda x: x["topic"])
    return topics.groupBy("run_id").agg(F.to_json(F.struct(all_.alias("topics"))).alias("json"))


def report_sheets(enriched: DataFrame, topics: DataFrame, keywords: DataFrame) -> dict[str, DataFrame]:
    """The three sheets of the workbook: texts with their topics and entities, topics, and keywords, in order."""
    return {"Verbatims": enriched.orderBy("ord"), "Topics": topics.orderBy(F.desc("volume_verbatims"), "topic_id"), "Keywords": keywords.orderBy("topic_id", "kind", F.desc("verbatims"), "term")}


def rules_json(topics: DataFrame) -> DataFrame:
    """One JSON object per topic with its label, aliases and rules."""
    fields = F.struct(
        F.col("canonical_label").alias("label"), F.col("canonical_subtopic").alias("sublabel"), "aliases", "keywords", "regex_patterns", "negative_keywords"
    )
    return topics.select("topic_id", F.to_json(fields).alias("json"))


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Sheets of reports in one file; folders of CSV where no workbook writer is installed. Reports are small: they go through the driver."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError:
        for name, df in sheets.items():
            write_csv(df, f"{path}/{name}", single=True)
        return
    with pd.ExcelWriter(path) as book:
        for name, df in sheets.items():
            df.toPandas().to_excel(book, sheet_name=name[:31], index=False)


def slide_rows(metrics: DataFrame, topics: DataFrame, n: int = 20) -> DataFrame:
    """The n topics with most verbatims over all runs, as lines of a Markdown table."""
    top = metrics.join(topics.select("topic_id", "canonical_subtopic"), "topic_id").orderBy(F.desc("volume_verbatims"), "topic_id").limit(n)
    sub = F.when(F.length("canonical_subtopic") > 0, F.col("canonical_subtopic")).otherwise("-")
    line = F.concat(F.lit("| "), F.coalesce("canonical_label", F.lit("")), F.lit(" | "), sub, F.lit(" | "), F.col("volume_verbatims").cast("string"), F.lit(" | "), F.col("volume_mentions").cast("string"), F.lit(" |"))
    return top.select("topic_id", line.alias("line"))


def markdown_report(title: str, total: int, metrics: DataFrame, n: int = 10) -> str:
    """A report of the n largest topics; n rows come to the driver.

    Where metrics have canonical_subtopic, pain_points, benefits or keywords, details of these topics
    follow: up to five pains and benefits, and ten keywords.
    """
    found = metrics.agg(F.count("*"), F.count_if(F.col("volume_verbatims") > 0)).first()
    details = []
    lines = [f"# {title}", "", f"Texts analysed: {total:,}", "", f"Topics: {found[0]:,}, with matches: {found[1]:,}, without: {found[0] - found[1]:,}", "", "| Rank | Topic | Verbatims | Share | Terms |", "| --- | --- | --- | --- | --- |"]
    for k, r in enumerate(metrics.orderBy(F.desc("volume_verbatims"), "topic_id").limit(n).collect(), 1):
        lines.append(f"| {k} | {r.canonical_label or ''} | {r.volume_verbatims} | {r.pct_of_dataset:.1f}% | {r.volume_mentions} |")
        held = r.asDict()
        details += ["", f"## {r.canonical_label or ''}", ""]
        details += [f"Subtopic: {held['canonical_subtopic']}", ""] if held.get("canonical_subtopic") else []
        details += [f"{r.volume_verbatims} texts ({r.pct_of_dataset:.1f}%)"]
        for column, name, most in (("pain_points", "Pains", 5), ("benefits", "Benefits", 5)):
            if held.get(column):
                details += ["", f"{name}:", *[f"- {x}" for x in held[column][:most]]]
        if held.get("keywords"):
            details += ["", "Keywords: " + ", ".join(held["keywords"][:10])]
    return "\n".join(lines + details) + "\n"
