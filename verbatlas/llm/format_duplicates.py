"""Records that are the same but for white space, case, punctuation or the order of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import attach_group
from ..session import materialise
from . import repeats

MIN_SIGNS = 20
MIN_FIELDS = 3
MAX_LABEL = 30
# Java patterns. A sign is a letter or digit; a mark between two digits is anything visible but a sign.
_BLANK = r"[\s\p{Z}\p{C}]"
_IGNORED = r"[^\p{L}\p{N}]{2,}|[\s\p{Z}\p{C}]|(?<!\p{Nd})[^\p{L}\p{N}]|[^\p{L}\p{N}](?!\p{Nd})"
_BREAK = r"[|;\r\n\u0085\u2028\u2029]"
_FIELD = rf"(?s)^{_BLANK}*[^:\s\p{{Z}}](?:[^:]{{0,{MAX_LABEL - 2}}}[^:\s\p{{Z}}])?{_BLANK}*:.*[^\s\p{{Z}}\p{{C}}].*$"


def canonical(text: Column) -> Column:
    """Its letters and digits in order, without case; a single mark directly between two digits stays."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _IGNORED, "")


def field_key(text: Column) -> Column:
    """The sorted canonical fields of a record of fields; null for any other text."""
    pieces = F.filter(F.split(text, _BREAK), lambda p: p.rlike(r"[^\s\p{Z}\p{C}]"))
    whole = (F.size(pieces) >= MIN_FIELDS) & F.forall(pieces, lambda p: p.rlike(_FIELD))
    return F.when(text.rlike(_BREAK) & whole, F.concat(F.lit("\u0001"), F.array_join(F.sort_array(F.transform(pieces, canonical)), "\u0001")))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (uid, id, raw, plain) of the cases: the key of a text's fields or plain form, and for records of fields that of their plain form.

    Keys are 16 bytes, of which two of a trillion texts would agree by chance once in 10^14 times; texts go no further.
    Texts that are no cases get no key where they are read, so that canonical forms are made once.
    """
    plain, fields = canonical(F.col(text_col)), field_key(F.col(text_col))
    case = F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}]", "")) >= MIN_SIGNS
    key = F.when(case, F.struct(_digest(F.coalesce(fields, plain)).alias("raw"), F.when(fields.isNotNull(), _digest(plain)).alias("plain")))
    rows = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), key.alias("key"))
    return materialise(rows, "canonical-keys").where("id is not null and key is not null").select("uid", "id", "key.raw", "key.plain")


def copies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, first, n) of every record that has copies: its group's smallest id and size.

    Texts are copies if their canonical forms are equal, or if both are records with the same fields in
    any order; a text that runs together the fields of a record in their order is its copy, too. Null
    texts and texts of fewer than MIN_SIGNS letters and digits have no copies; rows without an id are
    left out; a row delivered twice under one id counts as two members with that id; an empty table
    gives no rows.
    """
    keyed = _keyed(df, id_col, text_col)
    total = keyed.count()
    both = F.filter(F.array(F.xxhash64("raw"), F.when(F.col("plain").isNotNull(), F.xxhash64("plain"))), lambda h: h.isNotNull())
    met = repeats.possible(keyed.select(F.explode(both).alias("h"), "uid", "id", "raw", "plain"), total)
    # A record of fields is asked for by either key, and comes once.
    met = materialise(met.drop("h"), "possible-copies")
    rows = met.where(F.col("plain").isNull()).unionByName(met.where(F.col("plain").isNotNull()).dropDuplicates(["uid"])).select("id", "raw", "plain")
    # Everything from here to the join is one row per distinct key. A plain text that runs together the
    # fields of a record joins that record's group (the least one's, were there several).
    raw = rows.groupBy("raw").agg(F.min("id").alias("lo"), F.count("*").alias("m"))
    via = rows.where(F.col("plain").isNotNull()).groupBy("plain").agg(F.min("raw").alias("via"))
    keys = raw.join(via, raw["raw"] == via["plain"], "left").select("raw", "lo", "m", F.coalesce("via", "raw").alias("key"))
    keys = materialise(keys, "copy-keys")
    groups = keys.groupBy("key").agg(F.min("lo").alias("first"), F.sum("m").alias("n")).where("n > 1")
    return attach_group(rows.select("id", "raw"), keys.join(groups, "key").select("raw", "m", "first", "n"), "raw", total, size="m").select("id", "first", "n")


def collapse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (id, n_copies) per record: copies as one with their number, all other rows as themselves with 1."""
    repeated = copies(df, id_col, text_col)
    once = df.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    later = repeated.where(F.col("id") != F.col("first")).select("id")
    firsts = repeated.where(F.col("id") == F.col("first")).groupBy("id").agg(F.max("n").alias("n"))
    return once.dropDuplicates(["id"]).join(later, "id", "left_anti").join(firsts, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"))
