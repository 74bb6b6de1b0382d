"""From a vendor's columns to verbatims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MANUAL_TARGETS, SETTINGS, STANDARD_COLUMNS, VENDOR_MAPPINGS, VENDOR_MARKERS

#: Date notations tried in turn, finest first.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd.MM.yyyy HH:mm", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")


def detect_source(columns: list[str], mode: str = "strict") -> str:
    """The vendor whose columns these are: all markers exactly (strict), or any of some, in any case (lenient)."""
    if mode == "strict":
        return next((v for v, marks in VENDOR_MARKERS.items() if set(marks) <= set(columns)), "generic_csv")
    low = [c.lower() for c in columns]
    if any(m in " ".join(low) for m in ("full text", "page type", "query id")):
        return "brandwatch"
    return "semantiweb" if any(c in ("review_text", "review_date", "review_id") for c in low) else "generic_csv"


def auto_mapping(columns: list[str], source: str) -> dict[str, str]:
    """Column → target for the columns that the vendor's mapping knows in any case; the first wins."""
    known = {k.lower(): v for k, v in VENDOR_MAPPINGS.get(source, {}).items()}
    out: dict[str, str] = {}
    for c in columns:
        if (target := known.get(c.lower())) and target not in out.values():
            out[c] = target
    return out


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renamed columns; those that are missing are ignored, others kept."""
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in ("full_text",) if c not in df.columns]


def guard(df: DataFrame, most: int = SETTINGS.max_verbatims) -> DataFrame:
    """The table, or an error if it has more rows than allowed; no more than that are counted."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def parse_date(text: Column) -> Column:
    """The first notation that fits, as UTC; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def residual_map(df: DataFrame, known: tuple[str, ...] = STANDARD_COLUMNS) -> Column:
    """All other columns' values that are not null, as a map."""
    rest = [c for c in df.columns if c not in known]
    if not rest:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda k, v: v.isNotNull())


def header_source(columns: Column, mode: str = "strict") -> Column:
    """detect_source for the columns of many files, as an array of strings."""
    if mode == "strict":
        out = F.lit("generic_csv")
        for vendor, marks in reversed(VENDOR_MARKERS.items()):
            out = F.when(F.forall(F.array(*map(F.lit, marks)), lambda m: F.array_contains(columns, m)), vendor).otherwise(out)
        return out
    low = F.transform(columns, F.lower)
    text = F.array_join(low, " ")
    first = F.contains(text, F.lit("full text")) | F.contains(text, F.lit("page type")) | F.contains(text, F.lit("query id"))
    second = F.arrays_overlap(low, F.array(*map(F.lit, ("review_text", "review_date", "review_id"))))
    return F.when(first, "brandwatch").when(second, "semantiweb").otherwise("generic_csv")


def check_targets(mapping: dict[str, str]) -> dict[str, str]:
    """A mapping made by hand; an error if it names a target that there isn't, or one twice. Targets beyond the standard columns go to extra_data."""
    unknown = sorted(set(mapping.values()) - set(STANDARD_COLUMNS) - set(MANUAL_TARGETS))
    if unknown or len(set(mapping.values())) < len(mapping):
        raise ValueError(f"unknown or repeated targets: {unknown or sorted(mapping.values())}")
    return mapping


def number_rows(df: DataFrame, name: str = "ord") -> DataFrame:
    """Rows numbered from 0 in the order of the input: a row's place in its partition plus the rows of those before.

    One row per partition is gathered, whatever the table's size. The input has to come in the same
    partitions each time it is read, as files do.
    """
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in marked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return marked.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before", "_at")


def import_project(
    df: DataFrame, project_id: str, name: str, description: str | None = None, mapping: dict[str, str] | None = None, detection: str = "strict", most: int = SETTINGS.max_verbatims
) -> tuple[DataFrame, DataFrame]:
    """The project's row and its verbatims, of a raw table that has no more rows than allowed."""
    guard(df, most)
    rows = to_verbatims(df, project_id, check_targets(mapping) if mapping is not None else None, detection)
    about = F.to_json(F.create_map(F.lit("original_rows"), F.lit(str(df.count())), F.lit("columns"), F.lit(" | ".join(df.columns))))
    one = df.sparkSession.range(1)
    project = one.select(F.lit(project_id).alias("id"), F.lit(name).alias("name"), F.lit(description).cast("string").alias("description"), F.lit(detect_source(df.columns, detection)).alias("source_type"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), about.alias("metadata"))
    return project, rows


def to_verbatims(df: DataFrame, project_id: str, mapping: dict[str, str] | None = None, detection: str = "strict") -> DataFrame:
    """A raw table's rows as verbatims of a project, with ids that only depend on their content and place.

    Rows without a text are left out. `ord` follows the order of the input.
    """
    source = detect_source(df.columns, detection)
    mapped = apply_mapping(df, mapping if mapping is not None else auto_mapping(df.columns, source))
    if missing := missing_columns(mapped):
        raise ValueError(f"missing columns: {missing}")
    cols = [F.col(c).cast("string").alias(c) if c in mapped.columns else F.lit(None).cast("string").alias(c) for c in STANDARD_COLUMNS]
    out = mapped.where(F.col("full_text").isNotNull()).select(*cols, residual_map(mapped).alias("extra_data"))
    numbered = number_rows(out)
    ident = F.sha2(F.concat_ws("\x1f", F.lit(project_id), F.col("ord").cast("string"), "full_text"), 256)
    return numbered.select(ident.alias("verbatim_id"), F.lit(project_id).alias("project_id"), "ord", *STANDARD_COLUMNS, parse_date(F.col("source_date")).alias("source_instant"), "extra_data")
