"""Queries of the analysis operators over the project tables, each with an independent SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..config import ENTITY_TYPES, MERGE_METHODS, NEGATION_PATTERNS, RUN_MODES, RUN_STATUSES, SOURCE_TYPES
from ..functions.matching import compiled_keywords, default_negations, highlight, matched_terms
from ..functions.similarity import char_masks, indel_ratio_any, jaccard
from ..functions.text import BLANKS, EMOJI, LETTERS, LIGATURES, PLAIN, PUNCTUATION, URLS, CleaningOptions, clean, cleaning_examples, cleaning_stats, repair_double_encoding, squeeze_punctuation, squeeze_spaces, transliterate
from ..io import spread, table
from ..operators import dedup, merging, relational, sampling, topics
from ..plans import analysis
from ..session import materialise
from ..sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _v(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "project_verbatims"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- Topics and entities -------------------------------------------------------------------------------


def _topics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _v(spark, d), topics.topic_rules(table(spark, d, "run_topics"), table(spark, d, "analysis_runs"))


_NEGATIONS = "[" + ", ".join(map(_text, NEGATION_PATTERNS)) + "]"
_RULES = f"""
WITH rules AS (
  SELECT t.topic_id, t.run_id, r.project_id, t.topic_ord, t.canonical_label, t.canonical_subtopic,
         coalesce(t.keywords, []) AS keywords, coalesce(t.negative_keywords, []) AS negatives, coalesce(t.regex_patterns, []) AS regexes
  FROM run_topics t JOIN analysis_runs r ON r.id = t.run_id WHERE t.is_active
), v AS (SELECT ord, project_id, lower(full_text) AS low FROM project_verbatims WHERE length(full_text) > 0
), open_pairs AS (
  SELECT v.ord, v.low, rules.* FROM v JOIN rules USING (project_id)
  WHERE len(list_filter(negatives, lambda n: n IS NOT NULL AND length(n) > 0 AND contains(v.low, lower(n)))) = 0
), kw AS (SELECT DISTINCT ord, low, topic_id, unnest(keywords) AS term FROM open_pairs
), hits AS (
  SELECT ord, topic_id, term FROM kw WHERE length(term) > 0 AND contains(low, lower(term))
    AND NOT regexp_matches(low, '(?s)(?:' || array_to_string(list_transform({_NEGATIONS}, lambda p: regexp_escape(p) || '.{{0,' || (30 - length(p)) || '}}'), '|') || ')' || regexp_escape(lower(term)))
  UNION
  SELECT ord, topic_id, '[regex:' || substr(p, 1, 20) || ']' FROM (SELECT ord, low, topic_id, unnest(regexes) AS p FROM open_pairs) WHERE regexp_matches(low, p)
), metrics AS (
  SELECT r.topic_id, r.run_id, r.topic_ord, r.canonical_label, coalesce(h.vv, 0) AS volume_verbatims, coalesce(h.vm, 0) AS volume_mentions,
         CASE WHEN coalesce(s.n, 0) > 0 THEN round(100.0::DOUBLE * coalesce(h.vv, 0) / s.n, 2) ELSE 0.0::DOUBLE END AS pct_of_dataset
  FROM rules r LEFT JOIN (SELECT topic_id, count(DISTINCT ord) AS vv, count(DISTINCT term) AS vm FROM hits GROUP BY topic_id) h USING (topic_id)
  LEFT JOIN (SELECT project_id, count(*) AS n FROM v GROUP BY project_id) s USING (project_id)
)
"""


@query(_RULES + "SELECT * FROM metrics")
def topic_metrics(spark, d):
    return topics.topic_metrics(*_topics(spark, d))


@query(_RULES + "SELECT topic_id, term, count(*) AS verbatims FROM hits GROUP BY ALL")
def topic_keyword_counts(spark, d):
    return topics.keyword_counts(topics.topic_counts(*_topics(spark, d)))


@query(_RULES + "SELECT topic_id, run_id, volume_verbatims, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY volume_verbatims DESC, topic_ord, topic_id)::INT AS rank FROM metrics) WHERE rank <= 10")
def topic_summary_top10(spark, d):
    return topics.top_topics(topic_metrics(spark, d)).select("topic_id", "run_id", "volume_verbatims", "rank")


@query(_RULES + "SELECT (SELECT count(*) FROM v) AS total, count(DISTINCT ord) AS with_match, (SELECT count(*) FROM v) - count(DISTINCT ord) AS without_match FROM hits")
def topic_summary(spark, d):
    return topics.topic_summary(*_topics(spark, d))


@query(_RULES + "SELECT topic_id, canonical_label FROM metrics WHERE volume_verbatims = 0")
def topics_without_match(spark, d):
    return topic_metrics(spark, d).where("volume_verbatims = 0").select("topic_id", "canonical_label")


@query(_RULES + "SELECT DISTINCT ord, topic_id FROM open_pairs WHERE len(list_filter(keywords, lambda k: length(k) > 0 AND contains(low, lower(k)))) > 0")
def explorer_matches(spark, d):
    """Keyword matches without negation and regular expressions, as the explorer shows them."""
    return topics.matched_pairs(*_topics(spark, d), negation=False, regexes=False)


@query("""SELECT ord, full_text FROM project_verbatims WHERE length(full_text) > 0 AND contains(lower(full_text), 'parfum') ORDER BY ord LIMIT 50""")
def explorer_top50(spark, d):
    """The first 50 texts of a theme: the limit is the feature."""
    return _v(spark, d).where((F.length("full_text") > 0) & F.contains(F.lower("full_text"), F.lit("parfum"))).select("ord", "full_text").orderBy("ord").limit(50)


@query(
    """SELECT ord, regexp_replace(regexp_replace(full_text, '(?i)parfum', '**\\0**', 'g'), '(?i)prix', '**\\0**', 'g') AS highlighted
       FROM project_verbatims WHERE contains(lower(full_text), 'parfum') OR contains(lower(full_text), 'prix')"""
)
def highlight_keywords(spark, d):
    low = F.lower("full_text")
    v = _v(spark, d).where(F.contains(low, F.lit("parfum")) | F.contains(low, F.lit("prix")))
    return v.select("ord", highlight(F.col("full_text"), F.array(F.lit("parfum"), F.lit("prix"))).alias("highlighted"))


@query(
    _RULES
    + """SELECT topic_id, 'keyword' AS kind, k.term, coalesce(n, 0) AS verbatims FROM (SELECT DISTINCT topic_id, unnest(keywords) AS term FROM rules) k
         LEFT JOIN (SELECT topic_id, term, count(*) AS n FROM hits GROUP BY ALL) h USING (topic_id, term) WHERE length(k.term) > 0
         UNION ALL SELECT topic_id, 'negative', term, 0 FROM (SELECT DISTINCT topic_id, unnest(negatives) AS term FROM rules)"""
)
def keyword_sheet(spark, d):
    v, rules = _topics(spark, d)
    return topics.keyword_sheet(rules, topics.topic_counts(v, rules))


@query(_RULES + "SELECT topic_id, run_id, canonical_label, coalesce(canonical_subtopic, '') AS subtopic, m.volume_verbatims, m.volume_mentions, m.pct_of_dataset FROM rules JOIN metrics m USING (topic_id, run_id, canonical_label)")
def topic_sheet(spark, d):
    v, rules = _topics(spark, d)
    return topics.topic_metrics(v, rules).join(rules.select("topic_id", "run_id", "canonical_label", F.coalesce("canonical_subtopic", F.lit("")).alias("subtopic")), ["topic_id", "run_id", "canonical_label"]).drop("topic_ord")


@query(
    _RULES
    + """SELECT topic_id, '| ' || coalesce(m.canonical_label, '') || ' | ' || CASE WHEN length(canonical_subtopic) > 0 THEN canonical_subtopic ELSE '-' END || ' | ' || m.volume_verbatims || ' | ' || m.volume_mentions || ' |' AS line
         FROM metrics m JOIN (SELECT topic_id, canonical_subtopic FROM rules) USING (topic_id) ORDER BY m.volume_verbatims DESC, topic_id LIMIT 20"""
)
def slide_table(spark, d):
    return sinks.slide_rows(topic_metrics(spark, d), table(spark, d, "run_topics"))


@query(_RULES + "SELECT canonical_label, count(*) AS topics, sum(volume_verbatims)::BIGINT AS verbatims, min(t.canonical_subtopic) AS subtopic FROM metrics JOIN (SELECT topic_id, canonical_subtopic FROM run_topics) t USING (topic_id) GROUP BY canonical_label")
def label_groupby_merge(spark, d):
    return merging.label_totals(table(spark, d, "run_topics"), topic_metrics(spark, d))


@query(_RULES + "SELECT run_id, round(100.0::DOUBLE * sum(volume_verbatims) / max(n), 2) AS coverage_pct, count(*) FILTER (volume_verbatims > 0) AS topics_met FROM metrics JOIN (SELECT run_id, any_value(n) AS n FROM rules JOIN (SELECT project_id, count(*) AS n FROM v GROUP BY 1) USING (project_id) GROUP BY 1) USING (run_id) GROUP BY run_id")
def coverage_kpi(spark, d):
    """Sum of topic volumes over texts; above 100 where topics overlap."""
    v, rules = _topics(spark, d)
    n = v.where(F.length("full_text") > 0).groupBy("project_id").agg(F.count("*").alias("n"))
    runs = rules.select("run_id", "project_id").distinct().join(n, "project_id")
    m = topics.topic_metrics(v, rules).groupBy("run_id").agg(F.sum("volume_verbatims").alias("s"), F.count_if(F.col("volume_verbatims") > 0).alias("topics_met"))
    return m.join(runs, "run_id").select("run_id", F.round(100.0 * F.col("s") / F.col("n"), 2).alias("coverage_pct"), "topics_met")


@query(
    _RULES.replace("FROM project_verbatims WHERE length(full_text) > 0", "FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS k FROM project_verbatims WHERE length(full_text) > 0) WHERE k <= 100")
    + """, h AS (SELECT topic_id, ord FROM hits WHERE NOT starts_with(term, '[regex:') GROUP BY ALL), c AS (SELECT topic_id, count(*) AS m, array_to_string(list_slice(list_sort(list(ord)), 1, 5), ',') AS e FROM h GROUP BY topic_id)
    SELECT topic_id, coalesce(m, 0) AS matches, round(coalesce(m, 0)::DOUBLE / n, 3) AS rate, coalesce(e, '') AS examples FROM rules JOIN (SELECT project_id, count(*) AS n FROM v GROUP BY 1) USING (project_id) LEFT JOIN c USING (topic_id)"""
)
def ontology_validation(spark, d):
    """Rules tried on the first hundred texts of each project: the limit is the feature."""
    return topics.validation(*_topics(spark, d))


_ENTITIES = """
WITH e AS (SELECT coalesce(entity_type, 'unknown') AS entity_type, label, unnest(coalesce(keywords, [])) AS k FROM dim_entities
), base AS (SELECT DISTINCT coalesce(entity_type, 'unknown') AS entity_type, label FROM dim_entities
), found AS (
  SELECT DISTINCT v.ord, e.entity_type, e.label FROM project_verbatims v JOIN (SELECT DISTINCT entity_type, label, lower(k) AS k FROM e WHERE length(k) > 0) e ON contains(lower(v.full_text), e.k)
)
"""


@query(_ENTITIES + "SELECT entity_type, label, count(ord) AS verbatims FROM base LEFT JOIN found USING (entity_type, label) GROUP BY ALL")
def entity_volume(spark, d):
    return topics.entity_counts(_v(spark, d), table(spark, d, "dim_entities"))


@query(
    _RULES.rstrip()
    + ", "
    + _ENTITIES.strip()[len("WITH ") :]
    + ", tl AS (SELECT ord, string_agg(canonical_label, ' | ' ORDER BY topic_ord, topic_id) AS topics FROM (SELECT DISTINCT ord, topic_id FROM hits) JOIN rules USING (topic_id) GROUP BY ord)"
    + ", el AS (SELECT ord, "
    + ", ".join(f"string_agg(label, ' | ' ORDER BY label) FILTER (entity_type = '{t}') AS entity_{t}" for t in ENTITY_TYPES)
    + " FROM found GROUP BY ord) SELECT p.ord, coalesce(topics, '') AS topics, "
    + ", ".join(f"coalesce(entity_{t}, '') AS entity_{t}" for t in ENTITY_TYPES)
    + " FROM project_verbatims p LEFT JOIN tl USING (ord) LEFT JOIN el USING (ord)"
)
def enriched_verbatims(spark, d):
    v, rules = _topics(spark, d)
    return topics.enriched(v, rules, table(spark, d, "dim_entities"), ENTITY_TYPES)


@query(
    """SELECT ord, contains(lower(full_text), 'prix') AND NOT contains(lower(full_text), 'dommage') AS without_negative,
              contains(lower(full_text), 'mal') AS inside_word, regexp_matches(lower(full_text), 'rouge(ur)?s?') AS by_regex
       FROM project_verbatims WHERE length(full_text) > 0"""
)
def match_flags(spark, d):
    low = F.lower("full_text")
    one = lambda *k: compiled_keywords(F.array(*map(F.lit, k)), F.array().cast("array<string>"))
    none, v = F.array().cast("array<string>"), _v(spark, d).where(F.length("full_text") > 0)
    return v.select(
        "ord", (F.size(matched_terms(low, one("prix"), F.array(F.lit("dommage")))) > 0).alias("without_negative"),
        (F.size(matched_terms(low, one("mal"), none)) > 0).alias("inside_word"), F.rlike(low, F.lit("(?U)rouge(ur)?s?")).alias("by_regex"),
    )


_T1 = lambda c: _chain(f"translate({c}, {_text(LETTERS)}, {_text(PLAIN)})")


def _chain(sql: str) -> str:
    for a, b in LIGATURES:
        sql = f"replace({sql}, {_text(a)}, {_text(b)})"
    return sql


@query(f"""SELECT ord, contains(lower({_T1('full_text')}), 'demangeaisons') AS folded FROM project_verbatims WHERE length(full_text) > 0""")
def match_accent_fold(spark, d):
    """Matching with accents folded on both sides."""
    rules = compiled_keywords(F.array(F.lower(transliterate(F.lit("démangeaisons")))), F.array().cast("array<string>"))
    return _v(spark, d).where(F.length("full_text") > 0).select("ord", (F.size(matched_terms(F.lower(transliterate(F.col("full_text"))), rules, F.array().cast("array<string>"))) > 0).alias("folded"))


# --- Cleaning ------------------------------------------------------------------------------------------

_STRIP = lambda c: f"regexp_replace({c}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"
_CLEAN = _STRIP(f"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({_T1('coalesce(full_text, chr(0))')}, '{URLS}', '', 'g'), '{EMOJI}', '', 'g')), '{PUNCTUATION}', '\\1', 'g'), '{BLANKS}+', ' ', 'g')").replace(", chr(0))", ", '')")


@query(f"SELECT ord, {_CLEAN} AS cleaned FROM project_verbatims")
def clean_full(spark, d):
    return _v(spark, d).select("ord", clean(F.col("full_text"), CleaningOptions(remove_punctuation=True)).alias("cleaned"))


@query(f"""SELECT ord, regexp_replace(full_text, '{URLS}', '', 'g') AS no_urls, regexp_replace(full_text, '{EMOJI}', '', 'g') AS no_emoji, regexp_replace(full_text, '{PUNCTUATION}', '\\1', 'g') AS squeezed,
           {_STRIP(f"regexp_replace(full_text, '{BLANKS}+', ' ', 'g')")} AS spaced FROM project_verbatims""")
def clean_steps(spark, d):
    t = F.col("full_text")
    return _v(spark, d).select("ord", F.regexp_replace(t, URLS, "").alias("no_urls"), F.regexp_replace(t, EMOJI, "").alias("no_emoji"), squeeze_punctuation(t).alias("squeezed"), squeeze_spaces(t).alias("spaced"))


@query(f"""WITH c AS (SELECT full_text AS a, {_CLEAN} AS b FROM project_verbatims)
  SELECT count(*) AS total, round(avg(length(a)), 1) AS mean_before, round(avg(length(b)), 1) AS mean_after, round(100 * (1 - avg(length(b)) / nullif(avg(length(a)), 0)), 1) AS reduction_pct,
         count(*) FILTER (length({_STRIP('b')}) = 0) AS empty_after FROM c""")
def clean_stats(spark, d):
    return cleaning_stats(_v(spark, d).select("full_text", clean(F.col("full_text"), CleaningOptions(remove_punctuation=True)).alias("b")), "full_text", "b")


@query(f"SELECT ord, before, after, length(before) AS chars_before, length(after) AS chars_after FROM (SELECT ord, coalesce(full_text, '') AS before, {_CLEAN} AS after FROM project_verbatims ORDER BY ord LIMIT 5)")
def clean_examples(spark, d):
    """The first five texts: the limit is the feature."""
    return cleaning_examples(_v(spark, d), "ord", "full_text", options=CleaningOptions(remove_punctuation=True))


@query()
def fix_mojibake(spark, d):
    t = F.col("full_text")
    return _v(spark, d).where(t.rlike("[ÃÂ]")).select("ord", repair_double_encoding(t).alias("repaired"))


# --- Duplicates ----------------------------------------------------------------------------------------


@query()
def dedup_classes(spark, d):
    return dedup.duplicate_classes(spread(table(spark, d, "documents")), "doc_id", "text")


@query()
def dedup_kept(spark, d):
    return dedup.keep_first(dedup_classes(spark, d), "doc_id")


@query()
def dedup_stats(spark, d):
    return dedup.dedup_stats(materialise(dedup_classes(spark, d), "classes"), "doc_id")


@query()
def dedup_preview(spark, d):
    """The ten most similar pairs: the limit is the feature."""
    pairs = dedup.similar_pairs(spread(table(spark, d, "documents")), "doc_id", "text")
    return pairs.orderBy(F.desc("score"), "a", "b").limit(10).withColumn("score", F.round("score", 3))


@query()
def verbatim_ratio_pairs(spark, d):
    """Pairs of one project's verbatims with an insertion/deletion ratio of 0.9, all of them."""
    return dedup.similar_pairs(_v(spark, d), "ord", "full_text", mode="exact", group_col="project_id")


@query()
def verbatim_ratio_classes(spark, d):
    return dedup.duplicate_classes(_v(spark, d), "ord", "full_text", mode="exact", group_col="project_id")


# --- Sampling and chunks -------------------------------------------------------------------------------

_COLUMNS = ("sentiment", "page_type", "category")
_STRATUM = "concat_ws('|', " + ", ".join(f"coalesce({c}, 'unknown')" for c in _COLUMNS) + ")"
_COUNTS = f"WITH c AS (SELECT {_STRATUM} AS stratum, count(*) AS n FROM project_verbatims GROUP BY 1)"
_TARGET, _LEAST, _CAP = 1500, 2, 300
_QUOTAS = f"""{_COUNTS}, s AS (SELECT *, count(*) OVER () AS k, sum(n) OVER () AS total FROM c
), b AS (SELECT *, {_TARGET} - k * {_LEAST} AS rest, CASE WHEN {_TARGET} - k * {_LEAST} < 0 THEN {_TARGET} // k ELSE least({_LEAST} + floor(({_TARGET} - k * {_LEAST}) * (n::DOUBLE / total))::BIGINT, {_CAP}) END::BIGINT AS base FROM s
), g AS (SELECT *, {_TARGET} - sum(base) OVER () AS gap, base < {_CAP} AND rest >= 0 AS open FROM b
), q AS (SELECT stratum, n, base + CASE WHEN open AND sum(open::INT) OVER (ORDER BY n DESC, stratum ROWS UNBOUNDED PRECEDING) <= gap THEN 1 ELSE 0 END AS quota FROM g)
"""


@query(f"{_COUNTS} SELECT stratum, n AS rows, round(100.0::DOUBLE * n / sum(n) OVER (), 1) AS pct FROM c")
def strata_histogram(spark, d):
    return sampling.histogram(_v(spark, d), _COLUMNS)


@query(_QUOTAS + "SELECT stratum, n AS rows, quota::BIGINT AS quota FROM q")
def strata_quotas(spark, d):
    counts = _v(spark, d).groupBy(sampling.stratum(_COLUMNS).alias("stratum")).agg(F.count("*").alias("rows"))
    return sampling.quotas(counts, _TARGET, _LEAST, _CAP)


@query(_QUOTAS + f"""SELECT ord, stratum FROM (SELECT ord, {_STRATUM} AS stratum, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY md5('42:' || ord), ord) AS k FROM project_verbatims) JOIN q USING (stratum)
  WHERE k <= CASE WHEN (SELECT sum(n) FROM c) <= {_TARGET} THEN n ELSE quota END""")
def stratified_sample(spark, d):
    return sampling.stratified_sample(_v(spark, d), "ord", _COLUMNS, _TARGET, _LEAST, _CAP)


@query("SELECT ord FROM project_verbatims ORDER BY md5('42:' || ord), ord LIMIT 750")
def simple_random_sample(spark, d):
    return sampling.random_sample(_v(spark, d), "ord", 750)


_CHUNKS = "WITH k AS (SELECT project_id, ord, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS pos, (row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1) // 200 AS chunk_index, length(coalesce(full_text, '')) AS n FROM project_verbatims)"


@query(_CHUNKS + " SELECT project_id, ord, pos, chunk_index FROM k")
def chunks(spark, d):
    return sampling.chunks(_v(spark, d), "ord", "project_id")


@query(_CHUNKS + """, b AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY project_id, chunk_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n > 50000 AS over FROM k)
  SELECT project_id, chunk_index, count(*) AS texts, count(*) FILTER (NOT cut) AS fitting FROM (SELECT *, bool_or(over) OVER (PARTITION BY project_id, chunk_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cut FROM b) GROUP BY ALL""")
def chunk_prompt_cut(spark, d):
    return sampling.prompt_cut(chunks(spark, d), _v(spark, d), "ord", "project_id")


@query(_CHUNKS + """, g AS (SELECT project_id, max(chunk_index) + 1 AS chunks, sum(n) FILTER (chunk_index = 0) AS chars FROM k GROUP BY 1)
  SELECT project_id, chunks::BIGINT AS chunks, (ceil(chars / 4.0) * chunks)::BIGINT AS tokens_in, (chunks * 2000)::BIGINT AS tokens_out,
         floor((ceil(chars / 4.0)::DOUBLE * chunks * 0.01::DOUBLE + (chunks * 2000)::DOUBLE * 0.03::DOUBLE) * 10 + 0.5000001::DOUBLE) / 10000 AS cost, (chunks * 30 // 10)::BIGINT AS seconds,
         CASE WHEN chunks >= 500 THEN 'blocking' WHEN chunks >= 100 THEN 'warning' ELSE 'none' END AS alert FROM g""")
def run_estimate(spark, d):
    return sampling.estimate(chunks(spark, d), _v(spark, d), "ord", "project_id")


# --- Merging of topics ---------------------------------------------------------------------------------

_LABELS = """WITH l AS (SELECT run_id, topic_id, row_number() OVER (PARTITION BY run_id ORDER BY topic_ord, topic_id)::INT - 1 AS pos, trim(lower(CASE WHEN length(canonical_subtopic) > 0 THEN coalesce(canonical_label, '') || ' | ' || canonical_subtopic ELSE coalesce(canonical_label, '') END)) AS label FROM run_topics)"""
_PIVOTS = _LABELS + r""", w AS (SELECT run_id, topic_id, w, count(*) AS tf FROM (SELECT run_id, topic_id, unnest(regexp_extract_all(label, '[\p{L}\p{N}_]+')) AS w FROM l) GROUP BY ALL
), z AS (SELECT run_id, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1
), st AS (SELECT run_id, w, sum(tf) AS cf, count(*) AS df FROM w GROUP BY ALL
), vocab AS (SELECT * FROM (SELECT st.*, z.n, row_number() OVER (PARTITION BY run_id ORDER BY cf DESC, w) AS k FROM st JOIN z USING (run_id)) WHERE k <= 5
), tops AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic_id ORDER BY round(tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1), 9) DESC, w DESC) AS r FROM w JOIN vocab USING (run_id, w)
), p AS (SELECT run_id, topic_id, string_agg(w, ' ' ORDER BY w) AS pivots FROM tops WHERE r <= 3 GROUP BY ALL)
"""
_RATIO = """CASE WHEN length(la) = 0 AND length(lb) = 0 THEN 1.0::DOUBLE WHEN length(la) = 0 OR length(lb) = 0 THEN 0.0::DOUBLE ELSE
  2.0::DOUBLE * (length(la) - bit_count(list_reduce(string_split(lb, ''), lambda s, ch: ((s + (s & list_sum(list_transform(range(1, length(la) + 1), lambda i: CASE WHEN substr(la, i, 1) = ch THEN (1::HUGEINT << (i - 1)::HUGEINT) ELSE 0::HUGEINT END))::HUGEINT))
   | (s - (s & list_sum(list_transform(range(1, length(la) + 1), lambda i: CASE WHEN substr(la, i, 1) = ch THEN (1::HUGEINT << (i - 1)::HUGEINT) ELSE 0::HUGEINT END))::HUGEINT))) & ((1::HUGEINT << length(la)::HUGEINT) - 1), (1::HUGEINT << length(la)::HUGEINT) - 1))) / (length(la) + length(lb)) END"""
_JACCARD = r"""CASE WHEN len(list_filter(regexp_split_to_array(la, '\s+'), lambda x: x <> '')) = 0 OR len(list_filter(regexp_split_to_array(lb, '\s+'), lambda x: x <> '')) = 0 THEN 0.0::DOUBLE ELSE
  len(list_intersect(list_filter(regexp_split_to_array(la, '\s+'), lambda x: x <> ''), list_filter(regexp_split_to_array(lb, '\s+'), lambda x: x <> '')))::DOUBLE
  / len(list_distinct(list_concat(list_filter(regexp_split_to_array(la, '\s+'), lambda x: x <> ''), list_filter(regexp_split_to_array(lb, '\s+'), lambda x: x <> '')))) END"""
_PAIRS = f"""{_PIVOTS}, m AS (SELECT x.run_id, x.pos AS a, y.pos AS b, x.label AS la, y.label AS lb, px.pivots AS pa, py.pivots AS pb FROM l x JOIN l y ON x.run_id = y.run_id AND x.pos < y.pos
  LEFT JOIN p px ON px.run_id = x.run_id AND px.topic_id = x.topic_id LEFT JOIN p py ON py.run_id = y.run_id AND py.topic_id = y.topic_id
), sc AS (SELECT *, round({_RATIO}, 9) AS score, {_JACCARD} AS shared FROM m
), pairs AS (SELECT run_id, a, b, score FROM sc WHERE score >= 0.92 OR (shared >= 0.75 AND length(pa) > 0 AND pa = pb))
"""
_GROUPS = _PAIRS.replace("WITH l AS", "WITH RECURSIVE l AS", 1) + """, e AS (SELECT run_id, a AS x, b AS y FROM pairs UNION SELECT run_id, b, a FROM pairs
), reach AS (SELECT run_id, x AS node, x AS seen FROM e UNION SELECT r.run_id, r.node, e.y FROM reach r JOIN e ON e.run_id = r.run_id AND e.x = r.seen
), comp AS (SELECT run_id, node, min(seen) AS c FROM reach GROUP BY ALL
), grp AS (SELECT l.run_id, l.topic_id, l.pos, coalesce(c, l.pos) AS group_pos, CASE WHEN c IS NULL THEN 'single' ELSE 'pass1_algo' END AS method FROM l LEFT JOIN comp ON comp.run_id = l.run_id AND comp.node = l.pos)
"""


def _labels(spark, d):
    labels = merging.topic_labels(table(spark, d, "run_topics"))
    return labels, merging.pivot_words(labels, "run_id")


@query("WITH n AS (SELECT DISTINCT canonical_label AS l FROM run_topics WHERE length(canonical_label) > 0), m AS (SELECT x.l AS la, y.l AS lb FROM n x JOIN n y ON x.l < y.l), s AS (SELECT la AS a, lb AS b, round(" + _RATIO + ", 9) AS score FROM m) SELECT a, b, score FROM s WHERE score > 0.85")
def near_labels(spark, d):
    return merging.near_labels(table(spark, d, "run_topics"))


@query(_PIVOTS + "SELECT run_id, topic_id, pivots FROM p")
def pivot_words(spark, d):
    return _labels(spark, d)[1]


@query(_PAIRS + f"SELECT run_id, a, b, {_JACCARD} AS shared FROM m")
def label_jaccard(spark, d):
    l = _labels(spark, d)[0].select("run_id", "pos", "label")
    both = l.withColumnsRenamed({"pos": "a", "label": "la"}).join(l.withColumnsRenamed({"pos": "b", "label": "lb"}), "run_id").where("a < b")
    return both.select("run_id", "a", "b", jaccard(F.col("la"), F.col("lb")).alias("shared"))


@query(_PAIRS + "SELECT run_id, a, b, score FROM sc")
def indel_pairs_short(spark, d):
    l = _labels(spark, d)[0].select("run_id", "pos", "label", char_masks(F.col("label")).alias("masks"))
    both = l.withColumnsRenamed({"pos": "a", "label": "la"}).join(l.drop("masks").withColumnsRenamed({"pos": "b", "label": "lb"}), "run_id").where("a < b")
    return both.select("run_id", "a", "b", F.round(F.coalesce(indel_ratio_any(F.col("la"), F.col("lb"), F.col("masks")), F.lit(0.0)), 9).alias("score"))


@query(_PAIRS + "SELECT run_id, a, b, score FROM pairs")
def merge_pairs(spark, d):
    return merging.merge_pairs(*_labels(spark, d))


@query(_GROUPS + "SELECT run_id, pos, group_pos, method FROM grp")
def merge_groups(spark, d):
    labels, pivots = _labels(spark, d)
    return merging.merge_groups(labels, merging.merge_pairs(labels, pivots))


@query(_GROUPS + """, mem AS (SELECT g.run_id, g.group_pos, g.method, g.pos, trim(coalesce(canonical_label, '')) AS label, coalesce(canonical_subtopic, '') AS sub, coalesce(keywords, []) AS kw FROM run_topics t JOIN grp g USING (run_id, topic_id)
), firsts AS (SELECT run_id, group_pos, method, CASE WHEN length(label) > 0 THEN label WHEN len(kw) > 0 THEN substr(kw[1], 1, 50) ELSE 'Theme_' || pos END AS label, sub AS subtopic FROM mem QUALIFY row_number() OVER (PARTITION BY run_id, group_pos ORDER BY pos) = 1
), als AS (SELECT run_id, group_pos, string_agg(CASE WHEN length(sub) > 0 THEN label || ' > ' || sub ELSE label END, ' | ' ORDER BY pos) FILTER (length(label) > 0 AND rn > 1) AS aliases, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS sources
   FROM (SELECT *, row_number() OVER (PARTITION BY run_id, group_pos ORDER BY pos) AS rn FROM mem) GROUP BY ALL
), kws AS (SELECT run_id, group_pos, string_agg(k, ' | ' ORDER BY k) AS keywords FROM (SELECT DISTINCT run_id, group_pos, unnest(kw) AS k FROM mem) GROUP BY ALL)
SELECT f.run_id, f.group_pos, f.label, f.subtopic, coalesce(aliases, '') AS aliases, coalesce(keywords, '') AS keywords, sources, f.method FROM firsts f JOIN als USING (run_id, group_pos) LEFT JOIN kws USING (run_id, group_pos)""")
def merged_topics(spark, d):
    return merging.merged_topics(table(spark, d, "run_topics"), merge_groups(spark, d))


@query(f"""WITH t AS (SELECT topic_id, lower(coalesce(canonical_label, '')) AS a, lower(coalesce(canonical_subtopic, '')) AS b FROM run_topics
), w AS (SELECT DISTINCT topic_id, unnest(list_concat([a, b], list_filter(list_concat(regexp_split_to_array(a, '\\s+'), regexp_split_to_array(b, '\\s+')), lambda x: length(x) > 3))) AS k FROM t)
SELECT t.topic_id, coalesce(string_agg(k, ' | ' ORDER BY k) FILTER (length(k) > 0), '') AS keywords, {_text(' | '.join(NEGATION_PATTERNS))} AS negations FROM t LEFT JOIN w USING (topic_id) GROUP BY t.topic_id""")
def fallback_ontology(spark, d):
    return merging.fallback_rules(table(spark, d, "run_topics"))


# --- Projects and runs ---------------------------------------------------------------------------------

def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


_NV = "LEFT JOIN (SELECT project_id, count(*) AS n FROM project_verbatims GROUP BY 1) v ON v.project_id = p.id"


@query(f"SELECT p.id, p.name, epoch_us(p.created_at) AS created_us, coalesce(n, 0) AS verbatims FROM projects p {_NV}")
def projects_with_counts(spark, d):
    return _micros(relational.projects_with_counts(table(spark, d, "projects"), _v(spark, d)))


@query(f"SELECT p.id, p.name, epoch_us(p.created_at) AS created_us, coalesce(n, 0) AS verbatims FROM projects p {_NV} ORDER BY p.created_at DESC, p.id LIMIT 5")
def recent_projects5(spark, d):
    return _micros(relational.recent_projects(table(spark, d, "projects"), _v(spark, d)))


@query("SELECT r.id, r.project_id, p.name AS project_name, r.mode, epoch_us(r.created_at) AS created_us, count(t.topic_id) AS topics FROM analysis_runs r JOIN projects p ON p.id = r.project_id LEFT JOIN run_topics t ON t.run_id = r.id WHERE r.status = 'success' GROUP BY ALL")
def runs_list(spark, d):
    return _micros(relational.runs_list(table(spark, d, "analysis_runs"), table(spark, d, "projects"), table(spark, d, "run_topics")))


@query("""SELECT r.id, r.project_id, p.name AS project_name, r.mode, r.status, r.total_verbatims, r.verbatims_after_dedup, r.total_chunks, r.chunks_success, r.chunks_failed, r.gida_version,
  epoch_us(r.completed_at) / 1e6 - epoch_us(r.started_at) / 1e6 AS duration_seconds, count(DISTINCT t.topic_id) AS topic_count
  FROM analysis_runs r JOIN projects p ON p.id = r.project_id LEFT JOIN run_topics t ON t.run_id = r.id AND t.is_active GROUP BY ALL""")
def run_summary(spark, d):
    return relational.run_summary(table(spark, d, "analysis_runs"), table(spark, d, "projects"), table(spark, d, "run_topics"))


@query("SELECT t.topic_id, t.run_id, canonical_label, canonical_subtopic, merge_method, r.mode AS run_mode, p.name AS project_name FROM run_topics t JOIN analysis_runs r ON r.id = t.run_id JOIN projects p ON p.id = r.project_id WHERE t.is_active")
def topics_with_metrics(spark, d):
    return relational.topics_with_runs(table(spark, d, "run_topics"), table(spark, d, "analysis_runs"), table(spark, d, "projects"))


@query("SELECT ord, v.project_id FROM project_verbatims v WHERE v.project_id = (SELECT project_id FROM analysis_runs WHERE id = (SELECT min(id) FROM analysis_runs))")
def verbatims_of_run(spark, d):
    runs = table(spark, d, "analysis_runs")
    return relational.run_verbatims(_v(spark, d), runs, runs.agg(F.min("id")).first()[0]).select("ord", "project_id")


@query("SELECT project_id, language, count(*) AS verbatims FROM project_verbatims WHERE language IS NOT NULL GROUP BY ALL")
def project_summary_lang(spark, d):
    return relational.value_counts(_v(spark, d), "language")


@query("SELECT project_id, sentiment, count(*) AS verbatims FROM project_verbatims WHERE sentiment IS NOT NULL GROUP BY ALL")
def project_summary_sentiment(spark, d):
    return relational.value_counts(_v(spark, d), "sentiment")


@query("SELECT canonical_label, count(*) AS n FROM run_topics GROUP BY 1 HAVING count(*) > 3")
def recurrent_labels_having(spark, d):
    return relational.recurrent_labels(table(spark, d, "run_topics"))


@query("SELECT ontology_version, entity_type, count(*) AS entries FROM dim_entities GROUP BY ALL")
def dictionary_stats(spark, d):
    return relational.dictionary_stats(table(spark, d, "dim_entities"))


@query("SELECT 'entity' AS kind, entity_type, label FROM dim_entities WHERE entity_type <> 'attribute' UNION ALL SELECT 'attribute', entity_type, label FROM dim_entities WHERE entity_type = 'attribute'")
def entities_union(spark, d):
    e = table(spark, d, "dim_entities")
    part = lambda kind, cond: e.where(cond).select(F.lit(kind).alias("kind"), "entity_type", "label")
    return part("entity", F.col("entity_type") != "attribute").unionByName(part("attribute", F.col("entity_type") == "attribute"))


def _bad(t: str, c: str, allowed: tuple[str, ...]) -> str:
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS rows FROM {t} WHERE {c} NOT IN ({', '.join(map(_text, allowed))}) GROUP BY {c}"


@query(" UNION ALL ".join([_bad("projects", "source_type", SOURCE_TYPES), _bad("analysis_runs", "mode", RUN_MODES), _bad("analysis_runs", "status", RUN_STATUSES), _bad("run_topics", "merge_method", MERGE_METHODS)]))
def constraint_violations(spark, d):
    return relational.violations(table(spark, d, "projects"), table(spark, d, "analysis_runs"), table(spark, d, "run_topics"))


# --- Theme extraction ----------------------------------------------------------------------------------


def chunk_results(spark, d) -> DataFrame:
    v = _v(spark, d)
    return materialise(analysis.analyze_chunks(sampling.chunks(v, "ord", "project_id"), v), "chunk-results")


@query()
def chunk_themes(spark, d):
    """Themes of every chunk by the deterministic analyzer."""
    return analysis.flatten_themes(chunk_results(spark, d)).select("project_id", "chunk_index", "pos", "topic_label", F.size("example_verbatims").alias("examples"))


@query()
def chunk_outcome(spark, d):
    v = _v(spark, d)
    return analysis.outcome(analysis.analyze_chunks(sampling.chunks(v, "ord", "project_id"), v))


@query()
def pipeline_metrics(spark, d):
    """Topic metrics at the end of the whole pipeline: cleaned, deduplicated, chunked, analyzed, counted."""
    return analysis.Pipeline().run(_v(spark, d))["metrics"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
