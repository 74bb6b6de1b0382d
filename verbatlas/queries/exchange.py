"""Queries of imports, exports, rules and listings, each with an independent SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import NEGATION_PATTERNS, STANDARD_COLUMNS, VENDOR_MAPPINGS
from ..functions.text import repair_nested
from ..io import spread, table
from ..operators import dedup, importing, merging, relational, sampling, topics
from ..plans import analysis
from ..sources import sinks
from . import reference as ref

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- Import --------------------------------------------------------------------------------------------

_VENDOR = VENDOR_MAPPINGS["brandwatch"]
#: Columns of project_verbatims that no mapping knows.
_REST = ("verbatim_id", "project_id", "full_text_clean", "category", "dedup_flag")


def _export(spark: SparkSession, d: str) -> DataFrame:
    """project_verbatims under a vendor's column names."""
    v = spread(table(spark, d, "project_verbatims"))
    return v.select("ord", *[F.col(target).alias(name) for name, target in _VENDOR.items()], *_REST)


@query(f"SELECT ord, {', '.join(_VENDOR.values())} FROM project_verbatims")
def rename_mapping(spark, d):
    """A vendor's columns found by their header and renamed to ours."""
    raw = _export(spark, d)
    found = importing.apply_mapping(raw, importing.auto_mapping(raw.columns, importing.detect_source(raw.columns)))
    return found.select("ord", *_VENDOR.values())


_PAIRS = "[" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}=' || {c}::VARCHAR END" for c in _REST if c not in STANDARD_COLUMNS) + "]"


@query(f"SELECT ord, array_to_string(list_sort(list_filter({_PAIRS}, lambda x: x IS NOT NULL)), ';') AS extra FROM project_verbatims")
def residual_map(spark, d):
    """What a table has beyond the standard columns, as a map; here as sorted pairs."""
    raw = _export(spark, d)
    mapped = importing.apply_mapping(raw, importing.auto_mapping(raw.columns, importing.detect_source(raw.columns)))
    extra = importing.residual_map(mapped, (*STANDARD_COLUMNS, "ord"))
    return mapped.select("ord", F.array_join(F.array_sort(F.transform(F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("extra"))


@query("SELECT verbatim_id, full_text, source_id, source_date, sentiment, category FROM project_verbatims WHERE full_text IS NOT NULL")
def imported_verbatims(spark, d):
    """A whole import: detected, mapped, numbered; texts that are null are left out."""
    rows = importing.to_verbatims(_export(spark, d).drop("ord"), "p")
    return rows.select(F.col("extra_data")["verbatim_id"].alias("verbatim_id"), "full_text", "source_id", "source_date", "sentiment", "category")


@query("SELECT count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS most, count(*) AS different, count(DISTINCT verbatim_id) AS ids FROM project_verbatims WHERE full_text IS NOT NULL")
def import_numbering(spark, d):
    """Numbers of an import run from 0 without gaps."""
    rows = importing.to_verbatims(_export(spark, d).drop("ord"), "p")
    return rows.agg(F.count("*").alias("n"), F.min("ord").alias("least"), F.max("ord").alias("most"), F.count_distinct("ord").alias("different"), F.count_distinct(F.col("extra_data")["verbatim_id"]).alias("ids"))


_NAMES = "list_transform(string_split(header, delimiter), lambda x: trim(x, '\"'))"


@query(f"""SELECT file_id,
  CASE WHEN list_has_all({_NAMES}, ['Full Text', 'Query Id', 'Page Type', 'Sentiment']) THEN 'brandwatch' WHEN list_has_all({_NAMES}, ['review_text', 'review_id', 'sentiment_label']) THEN 'semantiweb' ELSE 'generic_csv' END AS strict,
  CASE WHEN regexp_matches(lower(array_to_string({_NAMES}, ' ')), 'full text|page type|query id') THEN 'brandwatch'
       WHEN list_has_any(list_transform({_NAMES}, lambda x: lower(x)), ['review_text', 'review_date', 'review_id']) THEN 'semantiweb' ELSE 'generic_csv' END AS lenient FROM raw_files""")
def import_detection(spark, d):
    """The vendor of each file by its header, strictly and leniently."""
    f = table(spark, d, "raw_files")
    columns = F.transform(F.call_function("split", "header", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E"))), lambda c: F.trim(c, F.lit('"')))
    return f.select("file_id", importing.header_source(columns).alias("strict"), importing.header_source(columns, "lenient").alias("lenient"))


_TRY = """CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{3})?(Z|[+-][0-9]{2}:[0-9]{2})') THEN epoch_us(try_cast(s AS TIMESTAMPTZ))
  WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?') THEN epoch_us(try_cast(CASE length(s) WHEN 16 THEN s || ':00' ELSE s END AS TIMESTAMP))
  WHEN regexp_full_match(s, '[0-9]{2}/[0-9]{2}/[0-9]{4}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?') OR regexp_full_match(s, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}( [0-9]{2}:[0-9]{2})?')
    THEN epoch_us(try_cast(substr(s, 7, 4) || '-' || substr(s, 4, 2) || '-' || substr(s, 1, 2) || CASE length(s) WHEN 16 THEN substr(s, 11) || ':00' ELSE substr(s, 11) END AS TIMESTAMP)) END"""


@query(f"SELECT ord, {_TRY} AS utc_us FROM (SELECT ord, source_date AS s FROM project_verbatims) WHERE {_TRY} IS NOT NULL")
def date_coerce(spark, d):
    """Vendor dates by the importer's list of notations; those that none fits are left out."""
    v = spread(table(spark, d, "project_verbatims"))
    return v.select("ord", F.unix_micros(importing.parse_date(F.col("source_date"))).alias("utc_us")).where("utc_us IS NOT NULL")


_REPAIR = "coalesce(try(decode(unhex(array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '' THEN '' WHEN ord(c) < 256 THEN lpad(hex(ord(c)), 2, '0') ELSE 'xx' END), '')))), {0})"


def _repaired(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[ÃÂ]') THEN {_REPAIR.format(x)} ELSE {x} END"


@query(f"SELECT ord, {_repaired('full_text')} AS repaired FROM project_verbatims WHERE regexp_matches(full_text, '[ÃÂ]')")
def fix_mojibake(spark, d):
    return ref.fix_mojibake(spark, d)


@query(f"""SELECT ord, {_repaired('full_text')} AS full_text, {_repaired('author')} AS author,
  array_to_string(list_sort(list_transform(map_entries(extra_data), lambda e: e.key || '=' || coalesce({_repaired('e.value')}, ''))), ';') AS extra FROM project_verbatims""")
def fix_nested(spark, d):
    """Repaired wherever strings stand: in columns and in maps."""
    v = repair_nested(spread(table(spark, d, "project_verbatims")).select("ord", "full_text", "author", "extra_data"))
    pairs = F.transform(F.map_entries("extra_data"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return v.select("ord", "full_text", "author", F.array_join(F.array_sort(pairs), ";").alias("extra"))


@query(f"SELECT topic_id, array_to_string(list_transform(coalesce(keywords, []), lambda k: {_repaired('k')}), ';') AS keywords FROM run_topics")
def fix_lists(spark, d):
    return repair_nested(table(spark, d, "run_topics").select("topic_id", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))).select("topic_id", F.array_join("keywords", ";").alias("keywords"))


# --- Rules ---------------------------------------------------------------------------------------------

_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in NEGATION_PATTERNS) + "]"


@query(f"""SELECT topic_id, run_id, topic_ord, canonical_label, canonical_subtopic, array_to_string(coalesce(keywords, []), ';') AS keywords, array_to_string(coalesce(regex_patterns, []), ';') AS regex_patterns,
  array_to_string(coalesce(negative_keywords, []), ';') AS negative_keywords, array_to_string({_LIST}, ';') AS negation_patterns FROM run_topics""")
def topics_with_ontology(spark, d):
    t = table(spark, d, "run_topics")
    lists = ("keywords", "regex_patterns", "negative_keywords", "negation_patterns")
    return topics.topics_with_ontology(t, topics.ontology(t)).withColumns({c: F.array_join(c, ";") for c in lists})


@query(f"""SELECT run_id, to_json({{'topics': list({{'label': coalesce(canonical_label, ''), 'sublabel': coalesce(canonical_subtopic, ''), 'aliases': coalesce(aliases, []), 'keywords': coalesce(keywords, []),
  'regex_patterns': coalesce(regex_patterns, []), 'negative_keywords': coalesce(negative_keywords, []), 'negation_patterns': {_LIST}}} ORDER BY topic_ord, topic_id)}})::VARCHAR AS json FROM run_topics GROUP BY run_id""")
def ontology_json(spark, d):
    return sinks.ontology_json(table(spark, d, "run_topics"))


@query(ref.SQL["fallback_ontology"].replace("SELECT t.topic_id,", "SELECT t.topic_id, 'fallback' AS source,"))
def generated_ontology(spark, d):
    """Rules by an analyzer that never answers: every topic gets the fallback's."""

    def silent(texts: list[str]) -> str:
        raise ValueError("no model here")

    g = analysis.generated_rules(table(spark, d, "run_topics"), silent)
    return g.select("topic_id", "source", F.array_join("keywords", " | ").alias("keywords"), F.array_join("negation_patterns", " | ").alias("negations"))


@query(ref._GROUPS + """, s AS (SELECT run_id, group_pos, count(*) AS n FROM grp GROUP BY ALL)
SELECT run_id, sum(n)::BIGINT AS topics_in, count(*) AS topics_out, coalesce(any_value(k), 0)::BIGINT AS pairs, count(*) FILTER (n > 1) AS groups, count(*) FILTER (n = 1) AS singles, 0::BIGINT AS model_calls
FROM s LEFT JOIN (SELECT run_id, count(*) AS k FROM pairs GROUP BY 1) USING (run_id) GROUP BY run_id""")
def merge_info(spark, d):
    labels, pivots = ref._labels(spark, d)
    pairs = merging.merge_pairs(labels, pivots)
    return merging.merge_info(merging.merge_groups(labels, pairs), pairs)


@query()
def merged_themes(spark, d):
    """Themes of all chunks as topics of their project, merged, with their pains, benefits and examples united."""
    themes = analysis.flatten_themes(ref.chunk_results(spark, d))
    place = F.row_number().over(ref.Window.partitionBy("project_id").orderBy("chunk_index", "pos"))  # a project's themes: five a chunk
    t = themes.select(
        F.col("project_id").alias("run_id"), F.concat_ws("#", "project_id", "chunk_index", "pos").alias("topic_id"), place.alias("topic_ord"), F.col("topic_label").alias("canonical_label"),
        F.col("subtopic_label").alias("canonical_subtopic"), F.lit(None).cast("array<string>").alias("keywords"), "pain_points", "benefits", "usage_context", "example_verbatims",
    ).where("run_id IS NOT NULL")
    t = ref.materialise(t, "themes")
    labels = merging.topic_labels(t)
    merged = merging.merged_topics(t, merging.merge_groups(labels, merging.merge_pairs(labels, merging.pivot_words(labels, "run_id"))))
    return merged.select(F.col("run_id").alias("project_id"), "group_pos", "label", "sources", "method", F.size("example_verbatims").alias("examples"))


# --- Samples and listings ------------------------------------------------------------------------------


@query("SELECT ord, full_text FROM project_verbatims ORDER BY ord LIMIT 750")
def head_sample(spark, d):
    """The texts that an estimate looks at: the limit is the feature."""
    return sampling.head_sample(spread(table(spark, d, "project_verbatims")).select("ord", "full_text"), "ord")


@query("""WITH c AS (SELECT concat_ws('|', coalesce(sentiment, 'unknown'), coalesce(language, 'unknown'), coalesce(page_type, 'unknown'), coalesce(category, 'unknown')) AS stratum, count(*) AS rows FROM project_verbatims GROUP BY 1)
SELECT stratum, rows, round(100.0::DOUBLE * rows / sum(rows) OVER (), 1) AS pct FROM c""")
def detected_strata(spark, d):
    """Strata of all usual columns that the table has."""
    v = spread(table(spark, d, "project_verbatims"))
    return sampling.histogram(v, sampling.detect_strata(v))


@query("""SELECT r.id, p.name || ' - ' || r.mode || ' - ' || substr(coalesce(r.brief, ''), 1, 50) || ' - ' || strftime(r.created_at, '%Y-%m-%d %H:%M') || ' - ' || format('{:,}', coalesce(r.total_verbatims, 0)) || ' texts' AS line
FROM analysis_runs r JOIN projects p ON p.id = r.project_id""")
def run_options(spark, d):
    return relational.run_options(table(spark, d, "analysis_runs"), table(spark, d, "projects"))


@query(f"SELECT p.id, p.name || ' - ' || strftime(p.created_at, '%Y-%m-%d %H:%M') || ' - ' || format('{{:,}}', coalesce(n, 0)) AS line FROM projects p {ref._NV}")
def project_lines(spark, d):
    return relational.project_lines(table(spark, d, "projects"), spread(table(spark, d, "project_verbatims")))


# --- Duplicates ----------------------------------------------------------------------------------------

_CLASSES = r"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 2
), w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t
), f AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM w WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n FROM f GROUP BY 1
), p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM f a JOIN f b ON a.s = b.s AND a.id < b.id GROUP BY ALL
), e AS (SELECT a AS x, b AS y FROM p JOIN n m ON m.id = a JOIN n o ON o.id = b WHERE k::DOUBLE / (m.n + o.n - k) >= 0.8
), two AS (SELECT x, y FROM e UNION SELECT y, x FROM e
), reach AS (SELECT x AS node, y AS seen FROM two UNION SELECT r.node, b.y FROM reach r JOIN two b ON b.x = r.seen
), comp AS (SELECT node, min(least(node, seen)) AS c FROM reach GROUP BY 1
), l AS (SELECT x, count(*) AS links FROM two GROUP BY 1
), classes AS (SELECT d.doc_id, coalesce(c, t.id) AS class_id, coalesce(links, 0) AS links FROM documents d JOIN t ON t.text = coalesce(d.text, '') LEFT JOIN comp ON comp.node = t.id LEFT JOIN l ON l.x = t.id)
"""
SQL |= {
    "dedup_classes": _CLASSES + "SELECT * FROM classes",
    "dedup_kept": _CLASSES + "SELECT doc_id FROM classes WHERE doc_id = class_id",
    "dedup_stats": _CLASSES + "SELECT sum(n)::BIGINT AS before, count(*) AS after, sum(n - 1)::BIGINT AS removed, count(*) FILTER (n > 1) AS clusters, 0.9::DOUBLE AS threshold FROM (SELECT class_id, count(*) AS n FROM classes GROUP BY 1)",
}


@query(_CLASSES + "SELECT max(doc_id) AS doc_id FROM classes GROUP BY class_id")
def dedup_kept_last(spark, d):
    return dedup.keep_last(ref.dedup_classes(spark, d), "doc_id")


@query(_CLASSES + "SELECT doc_id, sha256(chr(31) || class_id) AS dedup_group_id FROM classes WHERE class_id IN (SELECT class_id FROM classes GROUP BY 1 HAVING count(*) > 1)")
def dedup_group_ids(spark, d):
    return dedup.group_ids(ref.materialise(ref.dedup_classes(spark, d), "classes"), "doc_id")


# --- Theme extraction ----------------------------------------------------------------------------------

SQL["chunk_themes"] = r"""
WITH k AS (SELECT project_id, ord, full_text, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS pos, length(coalesce(full_text, '')) AS n FROM project_verbatims
), b AS (SELECT *, pos // 200 AS chunk_index, coalesce(sum(n + 1) OVER (PARTITION BY project_id, pos // 200 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n > 50000 AS over FROM k
), held AS (SELECT project_id, chunk_index, ord, lower(coalesce(full_text, '')) AS low FROM (SELECT *, bool_or(over) OVER (PARTITION BY project_id, chunk_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cut FROM b) WHERE NOT cut
), w AS (SELECT DISTINCT project_id, chunk_index, ord, unnest(regexp_extract_all(low, '[\p{L}\p{No}\p{Nl}]{5,}')) AS w FROM held
), c AS (SELECT project_id, chunk_index, w, count(*) AS n FROM w GROUP BY ALL
), top AS (SELECT *, row_number() OVER (PARTITION BY project_id, chunk_index ORDER BY n DESC, w)::INT - 1 AS pos FROM c QUALIFY pos < 5)
SELECT t.project_id, t.chunk_index, t.pos, t.w AS topic_label, least(2, (SELECT count(*) FROM held h WHERE h.project_id IS NOT DISTINCT FROM t.project_id AND h.chunk_index = t.chunk_index AND contains(h.low, t.w)))::INT AS examples FROM top t
"""


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
