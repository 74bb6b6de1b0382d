"""Queries of the general data-quality operators: timestamps and rejected records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..io import table
from ..operators.rejects import read_with_rejects
from ..operators.timestamps import normalise_timestamps


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    zones = table(spark, d, "projects").select(
        F.col("id").alias("project_id"), F.get_json_object("metadata", "$.time_zone").alias("zone"), F.get_json_object("metadata", "$.date_order").alias("day_order")
    )
    rows = table(spark, d, "project_verbatims").select("ord", "project_id", "source_date").join(zones.dropDuplicates(["project_id"]), "project_id", "left")
    return normalise_timestamps(rows, "source_date", "zone", "day_order", "ord")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return read_with_rejects(table(spark, d, "raw_imports"), table(spark, d, "raw_files")).where("reason is not null").select("file_id", "line_no", "reason")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    loaded = read_with_rejects(table(spark, d, "raw_imports"), table(spark, d, "raw_files")).where("reason is null")
    return loaded.select("file_id", "line_no", "full_text", F.date_format("source_date", "yyyy-MM-dd HH:mm:ss").alias("source_date"), "sentiment")


def queries() -> dict:
    return {"p3_found": p3_found, "p6_found": p6_found, "p6_loaded": p6_loaded}


#: The quoting rule as one regular expression per delimiter, fields by their delimiters, dates by the places of their parts.
_RECORDS = r"""
WITH f AS (
  SELECT *, regexp_escape(delimiter) AS d, date_format AS fmt,
         regexp_replace(regexp_replace(regexp_escape(date_format), 'yyyy', '[0-9]{4}'), 'MM|dd|HH|mm|ss', '[0-9]{2}', 'g') AS shape FROM raw_files
), h AS (
  SELECT *, list_transform(regexp_extract_all(header || delimiter, '("(?:[^"]|"")*"|[^"' || d || ']*)' || d, 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS names FROM f
), r AS (
  SELECT i.file_id, i.line_no, h.names, h.fmt, h.shape, h.text_column, h.date_column, h.sentiment_column,
         regexp_full_match(coalesce(raw_record, ''), '("([^"]|"")*"|[^"' || d || ']*)(' || d || '("([^"]|"")*"|[^"' || d || ']*))*') AS whole,
         list_transform(regexp_extract_all(coalesce(raw_record, '') || delimiter, '("(?:[^"]|"")*"|[^"' || d || ']*)' || d, 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS fields
  FROM raw_imports i JOIN h USING (file_id)
), v AS (
  SELECT *, coalesce(fields[list_position(names, text_column)], '') AS full_text, coalesce(fields[list_position(names, date_column)], '') AS day, coalesce(fields[list_position(names, sentiment_column)], '') AS mood FROM r
), w AS (
  SELECT *, CASE WHEN regexp_full_match(day, shape) THEN try_cast(substr(day, strpos(fmt, 'yyyy'), 4) || '-' || substr(day, strpos(fmt, 'MM'), 2) || '-' || substr(day, strpos(fmt, 'dd'), 2) || ' '
    || CASE WHEN contains(fmt, 'HH') THEN substr(day, strpos(fmt, 'HH'), 2) || ':' || substr(day, strpos(fmt, 'mm'), 2) ELSE '00:00' END || ':' || CASE WHEN contains(fmt, 'ss') THEN substr(day, strpos(fmt, 'ss'), 2) ELSE '00' END AS TIMESTAMP) END AS moment FROM v
), x AS (
  SELECT *, CASE WHEN NOT whole THEN 'broken_quote' WHEN len(fields) <> len(names) THEN 'column_count' WHEN regexp_full_match(full_text, '[\s\p{Z}]*') THEN 'empty_text'
    WHEN day <> '' AND moment IS NULL THEN 'bad_date' WHEN mood NOT IN ('', 'positive', 'negative', 'neutral', 'mixed') THEN 'bad_sentiment' END AS reason FROM w
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": _RECORDS + "SELECT file_id, line_no, reason FROM x WHERE reason IS NOT NULL",
        "p6_loaded": _RECORDS + "SELECT file_id, line_no, full_text, CASE WHEN day <> '' THEN strftime(moment, '%Y-%m-%d %H:%M:%S') END AS source_date, nullif(mood, '') AS sentiment FROM x WHERE reason IS NULL",
    }
