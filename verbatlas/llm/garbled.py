"""Text that was decoded with the wrong encoding: found and restored through the corpus's own words.

The distinct words of the corpus are written in every way a wrong decoding would leave them (all chains
of encodings); those ways that occur in the corpus make a table, garbled word to original, and the
documents' words are hash-joined against it. Words whose original is nowhere in the corpus are found by
the garbled forms of its single characters. Only words with characters beyond ASCII take part: no wrong
decoding between the encodings used here changes the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import attach_group
from ..session import materialise

#: Single-byte encodings as which UTF-8 bytes are misread; again on the result for the first three.
MISREAD_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1250", "cp1251")
AGAIN_AS = ("cp1252", "latin-1", "mac_roman")
#: Single-byte encodings misread as one another: from, to.
CONFUSED = (("cp1252", "cp1251"), ("cp1252", "cp1250"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"))
#: A word confused between single-byte encodings must be rarer than its original by this factor,
CONFUSED_RARITY = 0.5
#: and have a letter that the languages of the corpus don't use. Fixed values.
USUAL = frozenset("àâäáãåæçéèêëíìîïñóòôöõøœúùûüßÿºª°«»¡¿’‘…€“”–—£§")
#: Two-character forms of this shape are also a word's last letter and a closing mark.
_AMBIGUOUS = re.compile("[ãâ][»”“’‘…«–—]")
#: What separates words: ASCII signs and the blanks beyond ASCII but for the no-break space, which some garbled words end in.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF"
_GAPS = f"[{_GAP}]+"
_UNUSUAL = r"[^\x00-\x7F" + "".join(sorted(USUAL)) + "]"
_BEYOND = r"[^\x00-\x7F]"
RUN = "\x01"
#: Most rows of the table that are broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000


@lru_cache(None)
def _charset(name: str) -> dict[int, str]:
    """Byte to character. What cp1252 leaves undefined is read as the control character, as browsers do."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b) if name == "cp1252" else "�"
    return out


def _misread(word: str, charset: str) -> str:
    table = _charset(charset)
    return "".join([table[b] for b in word.encode("utf-8", "surrogatepass")])


def _recode(word: str, source: str, target: str) -> str | None:
    try:
        raw = word.encode(source)
    except UnicodeEncodeError:
        return None
    if target == "utf-8":
        return raw.decode("utf-8", "replace")
    table = _charset(target)
    return "".join([table[b] for b in raw])


def _raw_forms(w: str) -> Iterator[tuple[str, bool]]:
    """Forms that wrong decodings leave of a word as it is written, one at a time, as a word may be very long: of
    UTF-8 bytes, and (True) of single-byte encodings."""
    for enc in MISREAD_AS:
        if (once := _misread(w, enc)) != w:
            yield once, False
            for again in AGAIN_AS:
                yield _misread(once, again), False
    for enc in ("cp1252", "mac_roman"):
        if (lost := _recode(w, enc, "utf-8")) and "\ufffd" in lost:
            yield lost, False
    for a, b in CONFUSED:
        if (swapped := _recode(w, a, b)) and swapped != w:
            yield swapped, True


def _low_forms(word: str) -> Iterator[tuple[str, bool]]:
    """Lower-case forms that wrong decodings and a later cleaning leave of a word, some of them twice, never the word itself."""
    for w in dict.fromkeys((word, word.upper(), word.capitalize())):
        for f, confused in _raw_forms(w):
            low = f.lower()
            for v in dict.fromkeys((low, low.replace("\xa0", " ").strip())):
                if v.strip() and v != word and " " not in v:
                    yield v, confused


def garbled_forms(word: str) -> dict[str, bool]:
    """The lower-case forms of a word, each with whether it was only confused between single-byte encodings (such forms look like words)."""
    out: dict[str, bool] = {}
    for v, confused in _low_forms(word):
        out[v] = out.get(v, True) and confused
    return out


def _hash(word: str) -> int:
    """As xxhash64 of the word in Spark."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _words(text: Column) -> Column:
    """Distinct lower-case words with characters beyond ASCII and, marked by RUN, the runs of such characters."""
    low = F.lower(text)
    words = F.filter(F.split(low, _GAPS), lambda w: w.rlike(_BEYOND))
    runs = F.transform(F.regexp_extract_all(low, F.lit(f"({_BEYOND}+)"), 1), lambda r: F.concat(F.lit(RUN), r))
    return F.when(text.rlike(_BEYOND), F.array_union(words, runs)).otherwise(F.array().cast("array<string>"))


def _forms_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form, source, n, confused = [], [], [], []
        for word, own, count in zip(batch.column("word").to_pylist(), batch.column("h").to_pylist(), batch.column("n").to_pylist()):
            if word.strip() and "\ufffd" not in word and word[0] != RUN:
                found: dict[int, bool] = {}
                for f, c in _low_forms(word):
                    h = _hash(f)
                    found[h] = found.get(h, True) and c
                form += found
                confused += found.values()
                source += [own] * len(found)
                n += [count] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(form, pa.int64()), pa.array(source, pa.int64()), pa.array(n, pa.int64()), pa.array(confused, pa.bool_())], ["form", "source", "m", "confused"])


def garbled_words(vocabulary: DataFrame) -> DataFrame:
    """The table (word, original) of the garbled words of a vocabulary (word, n); original is null if unknown.

    Forms and words meet by 64-bit hashes, so that a form takes as little room however long the word is.
    """
    spark = vocabulary.sparkSession
    vocabulary = vocabulary.withColumn("h", F.xxhash64("word"))
    forms = vocabulary.mapInArrow(_forms_batches, "form long, source long, m long, confused boolean")
    met = forms.join(vocabulary, forms["form"] == vocabulary["h"])
    sure = ~F.col("confused") | ((F.col("m") >= CONFUSED_RARITY * F.col("n")) & F.col("word").rlike(_UNUSUAL))
    met = met.where(sure).select("word", "source", "m", "confused")
    met = materialise(met.join(vocabulary.select(F.col("word").alias("original"), F.col("h").alias("source")), "source").select("word", "original", "m", "confused"), "garbled-met")
    garbled = met.select("word").distinct()
    # A word garbled twice is also a form of the word garbled once; only clean words are originals.
    verified = met.join(garbled.withColumnRenamed("word", "original"), "original", "left_anti")
    verified = verified.groupBy("word").agg(F.max_by("original", F.struct(~F.col("confused"), "m", "original")).alias("original"))
    by_word = garbled.join(verified, "word", "left")
    # Characters of the corpus: at most as many as Unicode has.
    chars = [r.ch for r in vocabulary.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(f"({_BEYOND})"), 1))).alias("ch")).distinct().collect()]
    single = {f for ch in chars if ch != "�" for f, confused in garbled_forms(ch).items() if not confused and (len(f) > 1 or f == "�")}
    single = {f for f in single if not f.isascii() and not _AMBIGUOUS.fullmatch(f)}
    shared = spark.sparkContext.broadcast(sorted(single))

    def contains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for f in shared.value:
            finder.add_word(f, f)
        finder.make_automaton()
        for batch in batches:
            found = [w for w in batch.column("word").to_pylist() if len(finder) and next(finder.iter(w), None)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    by_char = vocabulary.where(F.col("word").startswith(RUN)).select("word").mapInArrow(contains, "word string")
    return by_char.join(by_word, "word", "full_outer").select("word", "original")


def find_garbled(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows (id_col, field, words): fields with garbled words, and those as array of (garbled, original), lower case.

    A word's original is null where the corpus doesn't have it; runs start with RUN. Null, empty and ASCII-only fields aren't
    affected; rows without an id are left out; rows repeated under one id give one row; an empty table none.
    """
    long = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _words(F.col(f)).alias("words")) for f in fields])).alias("x"))
    rows = materialise(long.where(F.size("x.words") > 0).select("id", "x.field", "x.words"), "garbled-words")
    words = rows.select("id", "field", F.explode("words").alias("word"))
    vocabulary = materialise(words.groupBy("word").agg(F.count("*").alias("n")), "garbled-vocabulary")
    table = materialise(garbled_words(vocabulary), "garbled-table")
    if table.count() <= BROADCAST_ROWS:
        met = words.join(F.broadcast(table), "word")
    else:
        met = attach_group(words, table.join(vocabulary, "word"), "word", words.count())
    pairs = F.sort_array(F.collect_set(F.struct(F.col("word").alias("garbled"), "original")))  # of one text
    return met.groupBy("id", "field").agg(pairs.alias("words")).withColumnRenamed("id", id_col)


@lru_cache(100_000)
def _in_case_of(garbled: str, original: str) -> str:
    """The original in the case from which the garbled word comes: as it is, with a capital, or all capitals."""
    for c in (original, original.capitalize(), original.upper()):
        if any(garbled == form for form, _ in _raw_forms(c)):
            return c
    letters = [c for c in garbled if c.isascii() and c.isalpha()]
    return original.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else original


def restore(text: str, words: dict[str, str]) -> str:
    """Replaces the garbled words of a text by their originals, in their case."""

    def one(m: re.Match) -> str:
        w = m.group()
        if (original := words.get(w.lower())) is None:
            return w
        return _in_case_of(w, original)

    return re.sub(f"[^{_GAP}]+", one, text)


def restore_garbled(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows (id_col, field, restored, complete) of the affected fields; `complete`: every garbled word had an original."""
    found = find_garbled(df, id_col, fields)
    texts = df.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select(id_col, "x.*")
    joined = found.join(texts, [id_col, "field"]).dropDuplicates([id_col, "field"])
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, whole = [], []
            for text, words in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist()):
                known = {w["garbled"]: w["original"] for w in words if w["original"] is not None}
                out.append(restore(text, known))
                rest = {w["garbled"].lstrip(RUN) for w in words if w["original"] is None}
                whole.append(not any(w in out[-1].lower() for w in rest))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("field"), pa.array(out, pa.string()), pa.array(whole)], [id_col, "field", "restored", "complete"])

    return joined.select(id_col, "field", "text", "words").mapInArrow(run, f"`{id_col}` {kind}, field string, restored string, complete boolean")
