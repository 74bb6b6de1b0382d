"""The sweep of topic queries: what is made once for rows that match the same, parts of large projects, small projects."""

import random

import contract
import pytest
from test_topics_at_size import folder  # noqa: F401

from verbatlas.functions import matching
from verbatlas.operators import topics
from verbatlas.queries import reference


def swept(spark, folder, name, monkeypatch):  # noqa: F811
    """What _swept takes and gives in a query, and the query's rows."""
    met, sweep = [], topics._swept
    with monkeypatch.context() as m:
        m.setattr(topics, "_swept", lambda rows, *a, **k: (met.append((rows, *a)), met.append(sweep(rows, *a, **k)))[1] or met[-1])
        out = contract.rows(reference.QUERIES[name](spark, folder).toPandas())
    return met[0], met[1], out


@pytest.mark.parametrize("name", ["explorer_matches", "enriched_verbatims"])
def test_matches_leave_once_for_rows_that_match_the_same(spark, folder, name, monkeypatch):  # noqa: F811
    """The rows of a large project are divided, but what a signature gives is in few parts; results stay."""
    monkeypatch.setattr(topics, "LEAST_HOT", 20)
    args, given, out = swept(spark, folder, name, monkeypatch)
    assert given.count() < args[0].count() / 2
    monkeypatch.setattr(topics, "_hot", lambda _: {})
    assert out == swept(spark, folder, name, monkeypatch)[2]
    monkeypatch.setattr(topics, "_hot", lambda _: {"p": 9})
    assert out == swept(spark, folder, name, monkeypatch)[2]


COUNTED = "keyword_sheet label_groupby_merge topic_metrics topic_summary_top10 slide_table topics_without_match".split()


@pytest.mark.parametrize("name", COUNTED)
def test_small_projects_are_counted_without_arrays(spark, folder, name, monkeypatch):  # noqa: F811
    """Counts by bits one by one equal those by arrays, which small projects don't use."""
    out = contract.rows(reference.QUERIES[name](spark, folder).toPandas())
    rng, made = random.Random(3), []
    signatures = [matching.array("i", sorted(rng.sample(range(6), rng.randrange(4)))).tobytes() for _ in range(50)]
    n = [rng.randrange(1, 70) for _ in signatures]
    rules = matching.ProjectRules([("a", {"words": [["X", "x", ""], ["Y", "y", ""]], "nots": ["z"]}), ("b", {"words": [["Y", "y", ""]]})], {("k", "x", ""): 0, ("k", "y", ""): 1, ("n", "z", ""): 2})
    one, many = {}, {}
    with monkeypatch.context() as m:
        m.setattr(matching, "_many_bits", lambda *a: made.append(a))
        rules.counted(signatures, n, one)
    assert not made and one
    monkeypatch.setattr(matching.ProjectRules, "few", 0)
    rules.counted(signatures, n, many)
    assert one == many
    assert out == contract.rows(reference.QUERIES[name](spark, folder).toPandas())


@pytest.mark.parametrize("name", ["topic_summary", *COUNTED])
def test_projects_with_rules_are_read_once(spark, folder, name, monkeypatch):  # noqa: F811
    """They are sought together with the vocabulary, not again by each join of texts."""
    seen, ruled = [], topics._ruled
    monkeypatch.setattr(topics, "_ruled", lambda flat: (seen.append(ruled(flat)), seen[-1])[1])
    reference.QUERIES[name](spark, folder).collect()
    assert seen and all("parquet" not in p._jdf.queryExecution().analyzed().toString().lower() for p in seen)
