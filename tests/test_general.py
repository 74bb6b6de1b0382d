import random

import pytest
from pyspark.sql import functions as F

from verbatlas.operators import rejects, timestamps
from verbatlas.operators.timestamps import parse_instant

ISO = {
    ("2022-01-16T08:26:42[Europe/Paris]", "Asia/Tokyo", "DMY"): "2022-01-16T07:26:42",
    ("Tue, 11 Mar 2025 06:30:40 +0100", "UTC", "DMY"): "2025-03-11T05:30:40",
    ("1. September 2025, 22:17 Uhr", "Europe/Paris", "DMY"): "2025-09-01T20:17:00",
    ("07/07/2024 21h57", "Europe/Paris", "DMY"): "2024-07-07T19:57:00",
    ("07/08/2024", "Europe/London", "MDY"): "2024-07-07T23:00:00",
    ("2024-03-31 02:30:00", "Europe/Paris", "DMY"): "2024-03-31T01:30:00",  # skipped: moves on by the gap
    ("2024-10-27 02:30:00", "Europe/Paris", "DMY"): "2024-10-27T00:30:00",  # twice: the earlier
    ("2025-02-08T05:39:56.164258999Z", None, None): "2025-02-08T05:39:56.164258",
    ("22 de febrero de 2021 06:05", "America/Toronto", "MDY"): "2021-02-22T11:05:00",
    ("15 mars 2025 à 13:39", "Europe/Paris", "DMY"): "2025-03-15T12:39:00",
    ("Feb 12, 2022 12:05 AM", "UTC", "DMY"): "2022-02-12T00:05:00",
    ("1710600672958154", None, None): "2024-03-16T14:51:12.958154",
    ("1710600672", None, None): "2024-03-16T14:51:12",
    ("20241210T121321Z", None, None): "2024-12-10T12:13:21",
    ("2025-09-13 13:40:00 CEST", "UTC", "DMY"): "2025-09-13T11:40:00",
    (" 01.02.2024 03:04 ", "UTC", "MDY"): "2024-02-01T03:04:00",
}


@pytest.mark.parametrize("case", ISO)
def test_notations(case):
    from datetime import datetime, timedelta, timezone

    got = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=parse_instant(*case))
    assert got.replace(tzinfo=None).isoformat() == ISO[case]


@pytest.mark.parametrize("raw", ["", "  ", "hier", "yesterday", "n/a", "31/04/2024", "2024-02-30", "2024-01-01 25:00", "2024-01-01 10:75", "0000-00-00 00:00:00", "13:45", "12345", "31 foo 2024", "13/13/2024", "2024-01-01 10:00 XYZ"])
def test_no_instant(raw):
    assert parse_instant(raw, "Europe/Paris", "DMY") is None


def test_wall_clock_needs_a_zone():
    assert parse_instant("2024-01-01", None, "DMY") is None and parse_instant("2024-01-01", "Nowhere/At_All", "DMY") is None
    assert parse_instant("01/02/2024", "UTC", None) is None


def test_dictionary_is_kept_and_extended(spark, tmp_path):
    schema, path = "ord long, raw string, zone string, day string, utc_us string", f"file://{tmp_path}/dict"
    a = spark.createDataFrame([(1, "2024-01-01", "UTC", "DMY", "x"), (2, "2024-01-01", "UTC", "DMY", "x"), (3, None, None, None, None), (4, "hier", "UTC", "DMY", "")], schema)
    assert sorted(map(tuple, timestamps.normalise_timestamps(a, "raw", "zone", "day", "ord", path).collect())) == [(1, 1704067200000000), (2, 1704067200000000)]
    assert spark.read.parquet(path).count() == 1
    b = spark.createDataFrame([(5, "2024-01-01", "UTC", "DMY", "x"), (6, "2024-01-02Z"[:10], "Asia/Tokyo", None, "x")], schema)
    assert timestamps.normalise_timestamps(b, "raw", "zone", "day", "ord", path).count() == 2
    assert spark.read.parquet(path).count() == 2
    assert timestamps.normalise_timestamps(a.limit(0), "raw", "zone", "day", "ord").count() == 0


def test_keys_added_twice_count_once(spark, tmp_path):
    schema, path = "ord long, raw string, zone string, day string", f"file://{tmp_path}/twice"
    a = spark.createDataFrame([(1, "2024-01-01", "UTC", "DMY"), (2, "2024-01-01", "UTC", "DMY")], schema)
    timestamps.normalise_timestamps(a, "raw", "zone", "day", "ord", path).collect()
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert timestamps.normalise_timestamps(a, "raw", "zone", "day", "ord", path).count() == 2
    assert timestamps.normalise_timestamps(a, "raw", "zone", "day", "ord").count() == 2  # in the shared folder
    assert not timestamps._read_dictionary(spark, timestamps.dictionary_path(spark)).isEmpty()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from verbatlas.session import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(fake)


FILES = "file_id long, delimiter string, header string, text_column string, date_column string, sentiment_column string, date_format string, reason string"
RECORDS = "file_id long, line_no long, raw_record string, reason string"


def load(spark, records):
    files = spark.createDataFrame([(1, ";", "id;t;d;s", "t", "d", "s", "dd/MM/yyyy HH:mm", "clash")], FILES)
    df = spark.createDataFrame([(1, i, r, "clash") for i, r in enumerate(records, 2)], RECORDS)
    return {r.line_no: r for r in rejects.read_with_rejects(df, files).collect()}


def test_reasons(spark):
    cases = {
        '1;ok;01/02/2024 03:04;positive': None, '1;ok;;': None, '"1";"a;b ""q""\nc";"";"mixed"': None,
        '1;"open;01/02/2024 03:04;positive': "broken_quote", '1;"a" fin;;': "broken_quote", '1;a"b"c;;': "broken_quote", '1;x"y;;': "broken_quote",
        "1;a;b": "column_count", "1;a;;;": "column_count", "": "column_count", None: "column_count",
        "1; 　 ;;": "empty_text", "1;;99/99/2024 00:00;bad": "empty_text",
        "1;a;31/02/2024 00:00;": "bad_date", "1;a;1/2/2024 00:00;": "bad_date", "1;a; ;": "bad_date", "1;a;2024-01-01;bad": "bad_date",
        "1;a;;Positive": "bad_sentiment", "1;a;;7": "bad_sentiment",
    }
    got = load(spark, list(cases))
    assert [got[i].reason for i in range(2, 2 + len(cases))] == list(cases.values())
    assert got[4].full_text == 'a;b "q"\nc' and got[4].sentiment == "mixed" and str(got[2].source_date) == "2024-02-01 03:04:00" and got[3].source_date is None


def test_long_and_repeated_records_and_unknown_files(spark):
    long = "1;" + "x" * 3_000_000 + ";;"
    got = load(spark, [long, long, "1;a;;"])
    assert [got[i].reason for i in (2, 3, 4)] == [None] * 3 and len(got[2].full_text) == 3_000_000
    files = spark.createDataFrame([], FILES)
    df = spark.createDataFrame([(9, 1, "a", None), (None, None, None, None)], RECORDS)
    assert [r.reason for r in rejects.read_with_rejects(df, files).collect()] == ["unknown_file"] * 2
    assert rejects.read_with_rejects(df.limit(0), files).count() == 0


def test_random_records_round_trip(spark):
    rng, records, fields = random.Random(5), [], []
    for _ in range(200):
        f = ["".join(rng.choices(['a', ';', '"', '\n', ' ', 'é'], k=rng.randrange(1, 8))) for _ in range(4)]
        f[1], f[2], f[3] = f[1] + "x", "", ""
        fields.append(f)
        records.append(";".join('"' + x.replace('"', '""') + '"' for x in f))
    got = load(spark, records)
    assert [got[i].full_text for i in range(2, 202)] == [f[1] for f in fields]


def test_the_reader_decides(monkeypatch):
    head = {"delimiter": ";", "header": "id;t", "text_column": "t", "date_column": None, "sentiment_column": None, "date_format": None}
    records = ["1;a", "1;b;c", '1;"open', "1;d", "1", '1;"x\n2;y"', '1;q"q']
    reason, detail, read = rejects._one_block(head, records)
    assert reason == [None, "column_count", "broken_quote", None, "column_count", None, "broken_quote"]
    assert detail == [None, "TOO MANY COLUMNS", "UNQUOTED VALUE", None, "MISSING COLUMNS", None, rejects.LENIENT] and sorted(read.column("_k").to_pylist()) == [0, 3, 5, 6]
    whole = rejects._read
    monkeypatch.setattr(rejects, "_read", lambda *a: ({}, whole(*a)[1].slice(0, 0)))
    assert rejects._one_block(head, records)[0] == ["broken_quote"] * len(records)


def test_reader_against_the_exact_rule():
    head = {"delimiter": ";", "header": "id;t", "text_column": "t", "date_column": None, "sentiment_column": None, "date_format": None}
    rng = random.Random(11)
    for _ in range(30):
        records = ["".join(rng.choices('a;"\n\r é', k=rng.randrange(0, 10))) if rng.random() < 0.6 else '1;"a ""b""\nc"' for _ in range(50)]
        reason, _, read = rejects._one_block(head, records)
        rows = dict(zip(read.column("_k").to_pylist(), read.column("reason").to_pylist()))
        for k, r in enumerate(records):
            fields = rejects.split_record(r, ";")
            exact = "broken_quote" if fields is None else "column_count" if len(fields) != 2 else "empty_text" if not fields[1].strip() else None
            assert (reason[k] or rows[k]) == exact, (r, records[k - 1])
