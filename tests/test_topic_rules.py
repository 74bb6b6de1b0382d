"""Topic queries at size: rules are evaluated once for all signatures, and texts that no rule can meet are left where they are read."""

import random
import re

import pytest
from test_topics_at_size import folder  # noqa: F401

from verbatlas.functions import matching
from verbatlas.operators import topics
from verbatlas.queries import reference

NAMES = "topic_keyword_counts topic_metrics topic_summary enriched_verbatims explorer_matches keyword_sheet label_groupby_merge topic_summary_top10 slide_table topics_without_match".split()


@pytest.mark.parametrize("name", NAMES)
def test_texts_of_projects_without_rules_are_not_shuffled(spark, folder, name, monkeypatch):  # noqa: F811
    met, swept = [], topics._swept
    monkeypatch.setattr(topics, "_swept", lambda rows, *a, **k: (met.append(rows), swept(rows, *a, **k))[1])
    want = sorted(map(str, reference.QUERIES[name](spark, folder).collect()))
    assert {r.project_id for r in met[-1].select("project_id").distinct().collect()} == {"p", "q"}
    monkeypatch.setattr(topics, "BROADCAST_PROJECTS", 1)
    assert sorted(map(str, reference.QUERIES[name](spark, folder).collect())) == want


def test_counts_of_signatures_equal_one_by_one(monkeypatch):
    """Topics listed twice, terms shared by entries, excluded and repeated rules, several blocks."""
    rng, words, nots = random.Random(7), ["a", "b", "c", "d"], ["x", "y"]
    vocabulary = matching.Vocabulary([*(("k", w, "") for w in words), *(("n", w, "") for w in nots), ("p", "q+", "")])
    for block in (3, 65_536):
        monkeypatch.setattr(matching.ProjectRules, "block", block)
        listed = [(f"t{rng.randrange(9)}", {"words": [[w.upper() if rng.random() < 0.5 else w, w, ""] for w in rng.sample(words, rng.randrange(3))], "nots": rng.sample(nots, rng.randrange(2)), "patterns": [["[regex:q+]", "q+"]] * rng.randrange(2)}) for _ in range(12)]
        texts = {"".join(rng.sample("abcdxyq ", rng.randrange(6))): rng.randrange(1, 9) for _ in range(40)}
        want: dict = {}
        for text, n in texts.items():
            found = set()
            for name, rule in listed:
                if not any(w in text for w in rule["nots"]):
                    found |= {(name, term) for term, low, _ in rule["words"] if low in text} | {(name, label) for label, _ in rule["patterns"] if "q" in text}
            for key in found | {(name, None) for name, _ in found}:
                want[key] = want.get(key, 0) + n
        rules, sums, calls, one = matching.ProjectRules(listed, vocabulary.ids), {}, [], matching._met
        monkeypatch.setattr(matching, "_met", lambda *a: (calls.append(a), one(*a))[1])
        rules.counted([vocabulary.signature(t) for t in texts], list(texts.values()), sums)
        monkeypatch.setattr(matching, "_met", one)
        assert {(name, term): n for name, term, n in rules.totals(sums)} == want
        kinds = {*rules._kinds[0], *rules._kinds[1].values()}
        assert block == 3 or len(calls) <= len(kinds)


def test_literals_stand_in_all_that_a_pattern_matches():
    literal = lambda source: matching._literal(re.compile(source))
    assert [literal(p) for p in (r"\bpeau\w*", "rouge(ur)?s?", "a|b", "(?i)Prix", "ab?c", "t.$", "")] == ["peau", "rouge", "", "", "a", "t", ""]


def test_entities_of_texts_equal_those_of_the_join(spark, monkeypatch):
    v = spark.createDataFrame([(i, "p", t) for i, t in enumerate(["rouge zone", "", None, "odeur rouge", "rien", "zz odeur"])], "ord long, project_id string, full_text string")
    t = spark.createDataFrame([("a", "r", 0, "A", None, ["odeur"], [], [], True)], "topic_id string, run_id string, topic_ord int, canonical_label string, canonical_subtopic string, keywords array<string>, negative_keywords array<string>, regex_patterns array<string>, is_active boolean")
    rules = topics.topic_rules(t, spark.createDataFrame([("r", "p")], "id string, project_id string"))
    words = spark.createDataFrame([("b", "y", ["rouge"]), ("b", "x", ["ROUGE", "odeur"]), ("c", "z", ["zone"]), ("other", "w", ["rouge"]), ("b", None, ["rouge"])], "entity_type string, label string, keywords array<string>")
    found = sorted(map(str, topics.enriched(v, rules, words, ("b", "c")).collect()))
    monkeypatch.setattr(topics, "_repeated", lambda _: True)
    assert found == sorted(map(str, topics.enriched(v, rules, words, ("b", "c")).collect()))
    assert "Row(ord=0, topics='', entity_b='x | y', entity_c='z')" in found
