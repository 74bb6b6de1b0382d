"""Reading of CSV exports and entity dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DICTIONARY = "version string, entities array<struct<entity_type:string,label:string,label_normalized:string,keywords:array<string>,parent:string>>"


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or ISO-8859-1 if any file is not valid UTF-8. Lines are checked where they are read."""
    lines = spark.read.option("encoding", "UTF-8").text(path)
    return "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def read_export(spark: SparkSession, path: str, delimiter: str = ",", encoding: str | None = None) -> DataFrame:
    """A CSV export with a header, all columns as strings; quoted fields may hold line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", delimiter)
    return reader.option("encoding", encoding or encoding_of(spark, path)).csv(path)


def preview(spark: SparkSession, path: str, rows: int = 1000, **options: str) -> DataFrame:
    """The first rows of an export, for a look at it."""
    return read_export(spark, path, **options).limit(rows)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file as rows of dim_entities."""
    d = spark.read.option("multiLine", True).schema(DICTIONARY).json(path)
    return d.select(F.col("version").alias("ontology_version"), F.explode("entities").alias("e")).select("ontology_version", "e.*")


def write_dictionary(entries: DataFrame, path: str) -> None:
    """Replaces the versions that `entries` have and leaves others; entities and attributes apart."""
    kind = F.when(F.col("entity_type") == "attribute", "attributes").otherwise("entities")
    entries.withColumn("dimension", kind).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ontology_version", "dimension").parquet(path)
