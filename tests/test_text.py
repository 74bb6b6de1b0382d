from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from verbatlas.functions import similarity, text


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first().x


def test_clean_steps(spark):
    c = F.col("t")
    assert one(spark, text.clean(c), t="  Déjà vu  https://x.y/z 👍 ŒUF ") == "deja vu oeuf"
    assert one(spark, text.squeeze_punctuation(c), t="wow?!!.. ok") == "wow. ok"
    assert one(spark, text.clean(c), t=None) == ""
    assert one(spark, text.clean(c, text.CleaningOptions(lowercase=False, remove_urls=False)), t="WWW.X.Y") == "WWW.X.Y"
    assert one(spark, text.clean(c), t="a" * 300_000) == "a" * 300_000


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([("É  !!  à　b",), ("",), ("x..y  ",)], "t string")
    once = df.select(text.clean(F.col("t"), text.CleaningOptions(remove_punctuation=True)).alias("t"))
    twice = once.select(text.clean(F.col("t"), text.CleaningOptions(remove_punctuation=True)).alias("t"))
    assert once.collect() == twice.collect()


def test_double_encoding(spark):
    c = F.col("t")
    for good in ("déjà vu", "été", "naïve façon", "Ä"):
        bad = good.encode().decode("latin-1")
        assert one(spark, text.repair_double_encoding(c), t=bad) == (good if any(x in bad for x in "ÃÂ") else bad)
    for same in ("NÃO", "Ã©tÃ", "Ã© œ", "plain", ""):
        assert one(spark, text.repair_double_encoding(c), t=same) == same


def test_stats_of_an_empty_table(spark):
    r = text.cleaning_stats(spark.createDataFrame([], "a string, b string"), "a", "b").first()
    assert (r.total, r.mean_before, r.empty_after) == (0, None, 0)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé", max_size=30), st.text("abcé", max_size=30))
def test_lcs_by_bits(a, b):
    assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.indel_ratio(a, b) == similarity.indel_ratio(b, a)


def test_short_form_equals_udf(spark):
    words = ["", "a", "kitten", "sitting", "été", "abcdefgh" * 7, "abcdxfgh" * 7, "zzz"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    rows = df.select("a", "b", similarity.indel_ratio_short(F.col("a"), F.col("b")).alias("s"), similarity.indel_udf()(F.col("a"), F.col("b")).alias("u")).collect()
    for r in rows:
        assert abs(r.s - r.u) < 1e-12, r
    assert similarity.indel_ratio(None, "a") is None
