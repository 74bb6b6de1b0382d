"""Queries of the corpus operators, each over its whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..io import spread, table
from . import format_duplicates, garbled, language, leaks, personal, raking, shared_spans, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def _languages(spark: SparkSession, d: str) -> DataFrame:
    verbatims = spread(table(spark, d, "project_verbatims"))
    model = language.fit(
        (verbatims, "ord", "full_text", "language", language.TRAIN_VERBATIMS), (spread(table(spark, d, "documents")), "doc_id", "text", "lang", language.TRAIN_DOCUMENTS)
    )
    return language.identify_languages(verbatims, model, "ord", "full_text", "language")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return _languages(spark, d).where((F.col("seg") > 0) | wrong).select("ord", "seg", "lang")


def p1_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("ord", "seg", "lang", F.round("confidence", 4).alias("confidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    groups = format_duplicates.copies(spread(table(spark, d, "project_verbatims")), "ord", "full_text")
    return groups.where(F.col("id") != F.col("first")).select(F.col("first").alias("ord"), F.col("id").alias("copy_ord"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.collapse(spread(table(spark, d, "project_verbatims")), "ord", "full_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find_garbled(spread(table(spark, d, "project_verbatims")), "ord", ("full_text", "full_text_clean")).select("ord", "field")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore_garbled(spread(table(spark, d, "project_verbatims")), "ord", ("full_text", "full_text_clean"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal.find_personal(spread(table(spark, d, "project_verbatims")), "ord", "full_text")
    return found.select("ord", "kind", (F.col("start") + 1).alias("start_pos"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(spread(table(spark, d, "project_verbatims")), "ord", "full_text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the drawn sample leaves short as there are not enough rows for them."""
    return p7_report(spark, d).where("gap > 0 AND available < needed").select("plan_id", "target_no")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return raking.raked_sample(table(spark, d, "project_verbatims"), table(spark, d, "sample_targets"), "ord")[1]


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return raking.raked_sample(table(spark, d, "project_verbatims"), table(spark, d, "sample_targets"), "ord")[0]


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(spread(table(spark, d, "documents")), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts after a round trip; null texts come back empty, as they have no ids."""
    return tokenize.decode_corpus(p8_ids(spark, d), "doc_id", "ids")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("exact").select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """All passages within one edit, word for word or not."""
    return _leaks(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_amounts(spread(table(spark, d, "documents")), "doc_id", "text")


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The shared stretches of each document: characters a to b - 1, counted from 0."""
    return shared_spans.shared_spans(spread(table(spark, d, "documents")), "doc_id", "text")


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the sentences that an earlier document has in a long shared span."""
    return shared_spans.without_repeats(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_TARGETS = """
WITH t AS (
  SELECT plan_id, target_no, project_id, sentiment, page_type, category,
         greatest(coalesce(min_rows, 0), CAST(floor(round(coalesce(share, 0) * coalesce(sample_size, 0), 6) + 0.5) AS BIGINT)) AS needed
  FROM sample_targets
), c AS (
  SELECT t.plan_id, t.target_no, t.needed, count(v.ord) AS available
  FROM t LEFT JOIN project_verbatims v
    ON (t.project_id IS NULL OR v.project_id = t.project_id)
   AND (t.sentiment IS NULL OR v.sentiment = t.sentiment OR (t.sentiment = 'unknown' AND v.sentiment IS NULL))
   AND (t.page_type IS NULL OR v.page_type = t.page_type OR (t.page_type = 'unknown' AND v.page_type IS NULL))
   AND (t.category IS NULL OR v.category = t.category OR (t.category = 'unknown' AND v.category IS NULL))
  GROUP BY ALL
)
"""



def _canonical_sql(text: str) -> str:
    """The canonical form without look-around: runs and blanks go first, so what is left are single marks."""
    low = f"replace(lower({text}), 'ß', 'ss')"
    single = rf"regexp_replace({low}, '[^\p{{L}}\p{{N}}]{{2,}}|[\s\p{{Z}}\p{{C}}]', '', 'g')"
    return rf"regexp_replace(regexp_replace({single}, '(^|[^\p{{Nd}}])[^\p{{L}}\p{{N}}]', '\1', 'g'), '[^\p{{L}}\p{{N}}]([^\p{{Nd}}]|$)', '\1', 'g')"


_COPIES = rf"""
WITH t AS (
  SELECT ord, {_canonical_sql('full_text')} AS plain,
         list_filter(regexp_split_to_array(full_text, '[|;\r\n\x{{85}}\x{{2028}}\x{{2029}}]'), lambda p: regexp_matches(p, '[^\s\p{{Z}}\p{{C}}]')) AS pieces
  FROM project_verbatims
), k AS (
  SELECT ord, plain, CASE WHEN len(pieces) >= 3 AND len(list_filter(pieces, lambda p: NOT regexp_matches(p, '(?s)^[\s\p{{Z}}\p{{C}}]*[^:\s\p{{Z}}]([^:]{{0,28}}[^:\s\p{{Z}}])?[\s\p{{Z}}\p{{C}}]*:.*[^\s\p{{Z}}\p{{C}}].*$'))) = 0
         THEN array_to_string(list_sort(list_transform(pieces, lambda p: {_canonical_sql('p')})), chr(1)) END AS fields
  FROM t WHERE length(regexp_replace(plain, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 20
), via AS (SELECT plain, min(fields) AS via FROM k WHERE fields IS NOT NULL GROUP BY plain
), g AS (SELECT ord, min(ord) OVER (PARTITION BY coalesce(k.fields, via.via, k.plain)) AS first FROM k LEFT JOIN via USING (plain))
SELECT first AS ord, ord AS copy_ord FROM g WHERE ord <> first
"""

_COLLAPSED = f"""
WITH c AS ({_COPIES.replace('SELECT first AS ord, ord AS copy_ord FROM g WHERE ord <> first', 'SELECT ord, first FROM g')}), n AS (SELECT first, count(*) AS n FROM c GROUP BY first)
SELECT DISTINCT v.ord, coalesce(n.n, 1) AS n_copies FROM project_verbatims v LEFT JOIN c ON c.ord = v.ord LEFT JOIN n ON n.first = v.ord WHERE v.ord IS NOT NULL AND (c.first IS NULL OR c.first = v.ord)
"""

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_LEAKED = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL
), dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d WHERE len(w) >= 12
), ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

_WINDOWS = """
WITH w AS (SELECT doc_id, p, md5(substr(text, p, 250)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS p FROM documents WHERE length(text) >= 250)
), r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1
), s AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS following, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w SEMI JOIN r USING (h))
"""
_SHARED = _WINDOWS + "SELECT doc_id, sum(least(250, coalesce(following - p, 250)))::BIGINT AS shared_chars FROM s GROUP BY doc_id"
_SPANS = _WINDOWS + """, g AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 250 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM s)
SELECT doc_id, min(p) - 1 AS a, max(p) + 249 AS b FROM g GROUP BY doc_id, k
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _COPIES,
        "p2_collapsed": _COLLAPSED,
        "p9_found": _LEAKED,
        "p10_found": _SHARED,
        "p10_spans": _SPANS,
        "p7_found": _TARGETS + "SELECT plan_id, target_no FROM c WHERE available < needed",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
