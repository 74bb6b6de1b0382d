"""Cleaning of texts as one Column expression; every step can be switched off but transliteration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Letters beyond ASCII and what they become.
LETTERS = "àâäáãåçéèêëíìîïñóòôöõøúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØÚÙÛÜÝŸ’‘“”–«»"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYY''\"\"-<>"
LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("…", "..."), ("—", "--"), ("€", "EUR"))
# Character classes that Java and RE2 read alike.
BLANKS = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{FE0F}\x{200D}\x{20E3}]"
URLS = r"https?://\S+|www\.\S+"
PUNCTUATION = r"([!?.,;:]){2,}"


@dataclass(frozen=True)
class CleaningOptions:
    lowercase: bool = True
    remove_urls: bool = True
    remove_emojis: bool = True
    remove_extra_spaces: bool = True
    remove_punctuation: bool = False
    ascii_only: bool = False


def transliterate(text: Column, ascii_only: bool = False) -> Column:
    """ASCII letters for accented ones; what has none stays, or goes with ascii_only."""
    out = F.translate(text, LETTERS, PLAIN)
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\x{00}-\x{7F}]", "") if ascii_only else out


def strip(text: Column) -> Column:
    """Without white space at both ends, also beyond ASCII."""
    return F.regexp_replace(text, f"^{BLANKS}+|{BLANKS}+$", "")


def squeeze_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{BLANKS}+", " "))


def squeeze_punctuation(text: Column) -> Column:
    """Runs of marks become their last mark."""
    return F.regexp_replace(text, PUNCTUATION, "$1")


def clean(text: Column, options: CleaningOptions = CleaningOptions()) -> Column:
    """The cleaned text; null becomes an empty text."""
    out = transliterate(F.coalesce(text.cast("string"), F.lit("")), options.ascii_only)
    if options.remove_urls:
        out = F.regexp_replace(out, URLS, "")
    if options.remove_emojis:
        out = F.regexp_replace(out, EMOJI, "")
    if options.lowercase:
        out = F.lower(out)
    if options.remove_punctuation:
        out = squeeze_punctuation(out)
    if options.remove_extra_spaces:
        out = squeeze_spaces(out)
    return strip(out)


def cleaning_stats(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: texts, mean lengths, reduction in percent, texts that became empty. An empty table gives nulls and 0."""
    a, b = F.avg(F.length(before)), F.avg(F.length(after))
    return df.agg(
        F.count("*").alias("total"),
        F.round(a, 1).alias("mean_before"),
        F.round(b, 1).alias("mean_after"),
        F.round(100 * (1 - b / F.nullif(a, F.lit(0.0))), 1).alias("reduction_pct"),
        F.coalesce(F.sum(F.when(F.length(strip(F.col(after))) == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("empty_after"),
    )


def repair_double_encoding(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read right; anything else unchanged.

    Only texts with one of the two tell-tale letters are tried, and only if all their characters are
    Latin-1 and their bytes are UTF-8.
    """
    tail = r"[\x{80}-\x{BF}]"
    utf8 = rf"^([\x{{00}}-\x{{7F}}]|[\x{{C2}}-\x{{DF}}]{tail}|\x{{E0}}[\x{{A0}}-\x{{BF}}]{tail}|[\x{{E1}}-\x{{EC}}\x{{EE}}\x{{EF}}]{tail}{{2}}|\x{{ED}}[\x{{80}}-\x{{9F}}]{tail}|\x{{F0}}[\x{{90}}-\x{{BF}}]{tail}{{2}}|[\x{{F1}}-\x{{F3}}]{tail}{{3}}|\x{{F4}}[\x{{80}}-\x{{8F}}]{tail}{{2}})*+$"
    return F.when(text.rlike("[ÃÂ]") & text.rlike(utf8), F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")).otherwise(text)


def repair_list(texts: Column) -> Column:
    """repair_double_encoding of each string of a list."""
    return F.transform(texts, repair_double_encoding)


def repair_map(texts: Column) -> Column:
    """repair_double_encoding of each value of a map."""
    return F.transform_values(texts, lambda k, v: repair_double_encoding(v))


def repair_nested(df: DataFrame) -> DataFrame:
    """The table with every string repaired: plain ones, and those in lists and maps of strings."""
    by_kind = {"string": repair_double_encoding, "array<string>": repair_list, "map<string,string>": repair_map}
    return df.withColumns({c: by_kind[kind](F.col(f"`{c}`")) for c, kind in df.dtypes if kind in by_kind})


def cleaning_examples(df: DataFrame, id_col: str, text_col: str, n: int = 5, options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """The first n texts before and after cleaning, with lengths."""
    first = df.select(id_col, F.coalesce(text_col, F.lit("")).alias("before")).orderBy(id_col).limit(n)
    after = first.withColumn("after", clean(F.col("before"), options))
    return after.withColumns({"chars_before": F.length("before").cast("long"), "chars_after": F.length("after").cast("long")})
