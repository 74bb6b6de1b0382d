"""Timestamps in mixed notations, precisions and zones as one instant: microseconds since 1970 UTC.

Each distinct (raw string, zone, date order) is parsed once, by trying every notation, and kept in a
dictionary table; later runs parse only what the dictionary lacks. Rows get their instant by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import materialise, shared_dir
from .skew import attach_group

DICTIONARY_SCHEMA = "raw string, zone string, day_order string, utc_us long"

#: Hours from UTC of zone abbreviations. Fixed values.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "MET": 1, "MEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "JST": 9, "KST": 9,
    "AEST": 10, "AEDT": 11, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "BRT": -3, "BRST": -2, "ART": -3,
}

#: Month names and short forms by language. Fixed values.
MONTH_NAMES = """
january february march april may june july august september october november december
jan feb mar apr may jun jul aug sep oct nov dec
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
janv févr mars avr mai juin juil août sept oct nov déc
januar februar märz april mai juni juli august september oktober november dezember
jan feb mär apr mai jun jul aug sep okt nov dez
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
ene feb mar abr may jun jul ago sept oct nov dic
gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre
gen feb mar apr mag giu lug ago set ott nov dic
janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro
jan fev mar abr mai jun jul ago set out nov dez
januari februari maart april mei juni juli augustus september oktober november december
jan feb mrt apr mei jun jul aug sep okt nov dec
"""
_MONTHS = {w: k for line in MONTH_NAMES.strip().splitlines() for k, w in enumerate(line.split(), 1)} | {
    w: k for k, w in ((2, "fevrier"), (2, "fevr"), (8, "aout"), (12, "decembre"), (12, "dec"), (3, "marco"), (3, "maerz"))
}

_TIME = r"(?P<H>\d{1,2})[:h](?P<M>\d{2})?(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,12}))?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?(?:\s*Uhr)?"
_ZONE = r"\s*(?P<off>[+-]\d{2}(?::?\d{2})?(?::?\d{2})?|[A-Za-z]{1,5})?\s*(?:\[?(?P<iana>[A-Z][A-Za-z_]+/[A-Za-z_/+-]+)\]?)?"
_MONTH = r"(?P<mon>[^\W\d_]{3,10})\.?"
_NOTATIONS = [
    re.compile(p + r"\Z")
    for p in (
        rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:T|\s+|,\s*){_TIME}{_ZONE})?",
        rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})(?:\s+{_TIME}{_ZONE})?",
        rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?",
        rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}})(?:,?\s+(?:à\s+)?{_TIME}{_ZONE})?",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d{1,12}))?(?P<off>Z|[+-]\d{2}:?\d{2})?",
        rf"(?:[^\W\d_]{{2,10}}\.?,?\s+)?(?P<d>\d{{1,2}})(?:\.|er|º|st|nd|rd|th)?\s+(?:de\s+)?{_MONTH}\s+(?:de\s+)?(?P<y>\d{{4}})(?:(?:,|\s+à|\s+um|\s+alle|\s+at|\s+às|\s+om|\s+a\s+las)?\s+{_TIME}{_ZONE})?",
        rf"(?:[^\W\d_]{{2,10}}\.?,?\s+)?{_MONTH}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_ZONE})?",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    )
]
#: Digits of an epoch number and the factor that makes it microseconds.
_EPOCHS = {10: (1_000_000, 1), 13: (1_000, 1), 16: (1, 1), 19: (1, 1_000)}
_START = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(1000)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:  # not a zone
        return None


def _offset(text: str) -> timedelta | None:
    if text[0] not in "+-":
        hours = ABBREVIATIONS.get(text.upper())
        return None if hours is None else timedelta(hours=hours)
    digits = text[1:].replace(":", "")
    h, m, s = int(digits[:2]), int(digits[2:4] or 0), int(digits[4:6] or 0)
    if h > 18 or m > 59 or s > 59:
        return None
    return timedelta(hours=h, minutes=m, seconds=s) * (-1 if text[0] == "-" else 1)


def parse_instant(raw: str | None, zone: str | None, day_order: str | None) -> int | None:
    """Microseconds since 1970 UTC, or None where `raw` denotes no absolute instant.

    A zone, offset or epoch in the string wins; otherwise it is wall-clock time in `zone` (an IANA name).
    Slashed dates follow `day_order` (DMY or MDY). A date alone is its midnight; digits finer than
    microseconds are cut off. Times that occur twice are the earlier instant, skipped ones move forward
    by the gap. A named zone in the string counts only where it is known.
    """
    if raw is None or not (text := raw.strip()):
        return None
    if text.isdigit() and text.isascii() and len(text) in _EPOCHS:
        up, down = _EPOCHS[len(text)]
        return int(text) * up // down
    for notation in _NOTATIONS:
        if m := notation.match(text):
            break
    else:
        return None
    g = m.groupdict()
    if g.get("a") is not None:
        if day_order not in ("DMY", "MDY"):
            return None
        day, month = (g["a"], g["b"]) if day_order == "DMY" else (g["b"], g["a"])
    else:
        day, month = g["d"], g.get("m") or _MONTHS.get((g.get("mon") or "").lower())
    if month is None:
        return None
    hour, minute, second = int(g.get("H") or 0), int(g.get("M") or 0), int(g.get("S") or 0)
    if half := g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half[0] in "pP" else 0)
    micros = int(((g.get("f") or "") + "000000")[:6])
    try:
        wall = datetime(int(g["y"]), int(month), int(day), hour, minute, second, micros)
    except ValueError:
        return None
    if off := g.get("off"):
        if (shift := _offset(off)) is None:
            return None
        instant = wall.replace(tzinfo=timezone.utc) - shift
    else:
        named = g.get("iana")
        if (where := _zone(named or zone)) is None:
            return None
        try:
            instant = wall.replace(tzinfo=where).astimezone(timezone.utc)  # fold 0: the earlier; in a gap, the offset before it
        except OverflowError:
            return None
    return (instant - _START) // timedelta(microseconds=1)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, zone, order = (batch.column(k).to_pylist() for k in range(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(map(parse_instant, raw, zone, order)), pa.int64())], ["raw", "zone", "day_order", "utc_us"])


def _read_dictionary(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def extend_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """Parses the distinct keys (raw, zone, day_order, n) that the dictionary at `path` lacks, appends and returns it."""
    spark = keys.sparkSession
    same = ["raw", "zone", "day_order"]
    held = _read_dictionary(spark, path)
    new = keys.select(same)
    if held is not None:
        k, h = new.alias("k"), held.alias("h")
        new = k.join(h, [F.col(f"k.{c}").eqNullSafe(F.col(f"h.{c}")) for c in same], "left_anti")
    new.mapInArrow(_parse_batches, DICTIONARY_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)


def dictionary_path(spark: SparkSession) -> str:
    """Where the dictionary is kept in the shared folder; other notations or names of months and zones make another."""
    rules = repr([[p.pattern for p in _NOTATIONS], sorted(ABBREVIATIONS.items()), sorted(_MONTHS.items())])
    return f"{shared_dir(spark)}/instants-{hashlib.md5(rules.encode()).hexdigest()[:12]}"


def normalise_timestamps(rows: DataFrame, raw: str, zone: str, day_order: str, id_col: str, dictionary: str | None = None) -> DataFrame:
    """Rows (id_col, utc_us) of the rows whose `raw` denotes an absolute instant.

    dictionary: folder of the persistent dictionary; None takes that of the shared folder, which later calls extend.
    Runs that extend it at the same time may both add a key; it counts once.
    Null and blank strings, relative words, placeholders, impossible dates and wall-clock times without
    a zone have no instant and no row. Repeated rows give as many rows; an empty table gives none.
    A raw string that a third of all rows share is joined by broadcast (see operators.skew).
    """
    path = dictionary or dictionary_path(rows.sparkSession)
    # An empty string cannot denote a zone or order, so it stands for null in the joined key.
    src = rows.where(F.col(raw).rlike(r"\d")).select(
        F.col(id_col).alias("id"), F.col(raw).alias("raw"), F.coalesce(F.col(zone), F.lit("")).alias("zone"), F.coalesce(F.col(day_order), F.lit("")).alias("day_order")
    )
    same = ["raw", "zone", "day_order"]
    keys = materialise(src.groupBy(same).agg(F.count("*").alias("n")), "instant-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    known = extend_dictionary(keys, path).where(F.col("utc_us").isNotNull())
    one = F.struct(*same).alias("key")
    once = keys.join(known, same).groupBy(same).agg(F.max("n").alias("n"), F.min("utc_us").alias("utc_us"))  # as the join leaves it: no further shuffle
    groups = once.select(one, "n", "utc_us")
    return attach_group(src.select("id", one), groups, "key", total).select(F.col("id").alias(id_col), "utc_us")
