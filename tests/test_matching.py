import random
import re

from pyspark.sql import functions as F

from verbatlas.functions.matching import Matcher, compiled_keywords, compiled_regexes, highlight, matched_terms, valid_patterns
from verbatlas.operators import topics


def empty():
    return F.array().cast("array<string>")


def model(text, keywords, negatives, patterns):
    low, found = (text or "").lower(), set()
    if not low or any(n and n.lower() in low for n in negatives):
        return []
    for k in keywords:
        if k and k.lower() in low:
            at = [m.start() for m in re.finditer(f"(?={re.escape(k.lower())})", low)]
            if not any(p in low[max(0, i - 30) : i] for i in at for p in patterns):
                found.add(k)
    return sorted(found)


def run(spark, cases):
    df = spark.createDataFrame(cases, "text string, k array<string>, n array<string>, p array<string>")
    return [r.x for r in df.select(matched_terms(F.lower(F.coalesce("text", F.lit(""))), compiled_keywords(F.col("k"), F.col("p")), F.col("n")).alias("x")).collect()]


def test_documented_cases(spark):
    cases = [
        ("pas de livraison", ["livraison"], [], ["pas de"]),
        ("livraison ok, pas de livraison demain", ["livraison"], [], ["pas de"]),
        ("pas de" + "x" * 25 + "livraison", ["livraison"], [], ["pas de"]),
        ("un mot normal", ["mal", "Mal"], [], []),
        ("prix bas mais cher", ["prix"], ["CHER"], []),
        (None, ["a"], [], []),
        ("texte", ["", "texte"], [""], [""]),
    ]
    assert run(spark, cases) == [[], [], ["livraison"], ["Mal", "mal"], [], [], ["texte"]]


def test_random_cases_against_the_model(spark):
    rng = random.Random(3)
    bits = ["pas de ", "ni ", "prix", "été", "(a+b)", "\n", "x" * 20, "Prix ", ". ", "\\E", "sans "]
    cases = [("".join(rng.choices(bits, k=rng.randrange(9))), rng.sample(["prix", "été", "(a+b)", "\\E", "Prix"], 3), rng.sample(["sans", "zzz"], 1), rng.sample(["pas de", "ni", "sans"], 2)) for _ in range(400)]
    assert run(spark, cases) == [model(*c) for c in cases]


def test_regexes(spark):
    df = spark.createDataFrame([("t", ["a(", r"\bété\b", None])], "topic_id string, regex_patterns array<string>")
    kept = valid_patterns(spark, df, "regex_patterns")
    assert kept.first().regex_patterns == [r"\bété\b"]
    x = kept.select(matched_terms(F.lit("un été chaud"), compiled_keywords(empty(), empty()), empty(), compiled_regexes(F.col("regex_patterns"))).alias("x")).first().x
    assert x == [r"[regex:\bété\b]"]


def test_highlight(spark):
    df = spark.createDataFrame([("Le PRIX (bas)",)], "t string")
    assert df.select(highlight(F.col("t"), F.array(F.lit("prix"), F.lit("(bas)"))).alias("x")).first().x == "Le **PRIX** **(bas)**"


def test_metrics(spark):
    v = spark.createDataFrame([(1, "p", "prix et odeur"), (2, "p", "rien"), (3, "p", ""), (4, "p", None), (5, "q", "prix")], "ord long, project_id string, full_text string")
    t = spark.createDataFrame(
        [("a", "r", 0, "A", None, ["prix", "Prix", "odeur"], [], [], True), ("b", "r", 0, "B", "", None, None, None, True), ("c", "r", 1, "C", None, ["prix"], [], [], False)],
        "topic_id string, run_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>, negative_keywords array<string>, regex_patterns array<string>, is_active boolean",
    )
    runs = spark.createDataFrame([("r", "p")], "id string, project_id string")
    rules = topics.topic_rules(t, runs)
    m = {r.topic_id: r for r in topics.topic_metrics(v, rules, topics.topic_matches(v, rules)).collect()}
    assert (m["a"].volume_verbatims, m["a"].volume_mentions, m["a"].pct_of_dataset) == (1, 3, 50.0)
    assert (m["b"].volume_verbatims, m["b"].pct_of_dataset) == (0, 0.0) and "c" not in m


def test_matcher_against_the_model():
    rng = random.Random(4)
    bits = ["pas de ", "ni ", "prix", "été", "(a+b)", "\n", "x" * 20, "Prix ", ". ", "\\E", "sans "]
    for _ in range(300):
        text, words = "".join(rng.choices(bits, k=rng.randrange(9))), rng.sample(["prix", "été", "(a+b)", "\\E", "Prix"], 3)
        nots, negations = rng.sample(["sans", "zzz"], 1), rng.sample(["pas de", "ni", "sans"], 2)
        matcher = Matcher([("p", "t", [(w, w.lower(), negations) for w in words], nots, []), ("q", "u", [("x", "x", [])], [], [])])
        got = dict(matcher.match("p", text.lower()))
        assert got.get("t", []) == model(text, words, nots, negations) and "u" not in got


def test_more_rules_than_are_broadcast(spark, monkeypatch):
    v = spark.createDataFrame([(i, "pq"[i % 2], f"prix {i} sans odeur rouge") for i in range(20)], "ord long, project_id string, full_text string")
    t = spark.createDataFrame(
        [(str(k), "rs"[k % 2], k, "A", None, [f"prix {k}", "odeur"], ["19"] if k == 3 else [], ["rou(ge|x)", "a("], True) for k in range(6)],
        "topic_id string, run_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>, negative_keywords array<string>, regex_patterns array<string>, is_active boolean",
    )
    rules = topics.topic_rules(t, spark.createDataFrame([("r", "p"), ("s", "q")], "id string, project_id string"))
    words = spark.createDataFrame([("a", "x", ["rouge"]), ("a", "y", ["prix 1", ""]), (None, "z", None), ("b", "x", ["nichts"])], "entity_type string, label string, keywords array<string>")
    few = sorted(map(str, topics.topic_matches(v, rules).collect())), sorted(map(str, topics.entity_matches(v, words).collect()))
    monkeypatch.setattr(topics, "BROADCAST_RULES", 2)
    assert few == (sorted(map(str, topics.topic_matches(v, rules).collect())), sorted(map(str, topics.entity_matches(v, words).collect())))
    assert len(few[0]) == 59 and len(few[1]) == 31
