"""Operators with an exact definition, against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import format_duplicates, leaks, raking, repeats, shared_spans, tokenize

DOCS = "doc_id long, text string, ids string, id string, h string, start string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in texts], DOCS)


# --- 8: token ids --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    tokens = tokenize.load_ranks(tokenize.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_token_ids(spark, reference):
    rng = random.Random(1)
    signs = [chr(c) for c in (*range(32, 127), 0xE9, 0xB2, 0xBD, 0x2167, 0x300, 0x1C, 0x85, 0xA0, 0x200B, 0x4E00, 0x1F600, 0x661, 0x3000, 10, 9)] + ["aaaa", "   ", "the", "\n\n", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(800)] + ["", None, "a" * 20_000, " " * 5_000, "ab" * 5_000, "naïve" * 2_000, "same", "same"]
    df = docs(spark, enumerate(texts))
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        assert got[i] == (reference.encode_ordinary(t) if t else []), repr(t)[:80]
    back = {r.doc_id: r.text for r in tokenize.decode_corpus(tokenize.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokenize.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# --- 2: formatting duplicates --------------------------------------------------------------------------


def plain_key(t):
    t = t.lower().replace("ß", "ss")
    keep = lambda i: t[i].isalnum() or (0 < i < len(t) - 1 and not t[i].isspace() and t[i - 1].isdigit() and t[i + 1].isdigit())
    return "".join(t[i] for i in range(len(t)) if keep(i))


def test_copies(spark):
    texts = [
        (1, "The bottle is far too small, 1,5 litres at most!"), (2, "THE BOTTLE  is far too small 1,5 litres at most"), (3, "The bottle is far too small, 1.5 litres at most!"),
        (4, "Straße und Maß sind hier ganz anders"), (5, "STRASSE UND MASS SIND HIER GANZ ANDERS"), (6, "Note : 5/5 | Avis : très bon parfum | Produit : Xyz"),
        (7, "produit:xyz;note:5/5;avis:très bon parfum"), (8, "Avis : tres bon parfum | Produit : Xyz | Note : 5/5"), (9, "Note 5/5 Avis très bon parfum Produit Xyz"),
        (10, "short"), (11, "SHORT"), (12, ""), (13, None), (14, None), (2, "THE BOTTLE  is far too small 1,5 litres at most"), (15, "x" * 500_000), (16, "X" * 500_000 + "."), (None, "The bottle is far too small, 1,5 litres at most!"),
    ]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "ord long, full_text string, key string, n int")
    got = sorted((r["first"], r.id) for r in format_duplicates.copies(df, "ord", "full_text").collect())
    # 9 runs together the fields of 6 in their order, so it joins the group of 6 and 7.
    assert got == [(1, 1), (1, 2), (1, 2), (4, 4), (4, 5), (6, 6), (6, 7), (6, 9), (15, 15), (15, 16)]
    n = {r.ord: r.n_copies for r in format_duplicates.collapse(df, "ord", "full_text").collect()}
    assert n[1] == 3 and n[6] == 3 and n[10] == 1 and 2 not in n and 13 in n
    assert format_duplicates.copies(df.limit(0), "ord", "full_text").count() == 0


def test_copies_with_a_hot_group_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "1,5", "2024", "épsilon", "ß"]
    base = [" ".join(rng.choices(words, k=6)) for _ in range(150)] + ["one very common remark of customers"] * 150
    texts = [(i, rng.choice([str.upper, str.lower, str.title, lambda s: s.replace(" ", "  "), lambda s: s + "!!"])(t)) for i, t in enumerate(base)]
    df = spark.createDataFrame(texts, "ord long, full_text string")
    groups = defaultdict(list)
    for i, t in texts:
        if sum(map(str.isalnum, t)) >= 20:
            groups[plain_key(t)].append(i)
    exp = sorted((min(g), i, len(g)) for g in groups.values() if len(g) > 1 for i in g)
    assert sorted((r["first"], r.id, r.n) for r in format_duplicates.copies(df, "ord", "full_text").collect()) == exp


@pytest.mark.parametrize("keys, part", [(40_000, 1_000_000), (40, 1_000_000), (40_000, 300)])  # as many as there are; far too few; hot ranges
def test_filter_never_loses_a_repeat(spark, monkeypatch, keys, part):
    monkeypatch.setattr(repeats, "PART_ROWS", part)
    key = F.when(F.col("id") % 4 == 0, F.col("id") % 2000).when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))
    rows = spark.range(40_000).select(F.xxhash64(key).alias("h"), "id").repartition(5)
    passed = repeats.possible(rows, keys).toPandas()
    again = rows.toPandas().groupby("h").filter(lambda g: len(g) > 1)
    assert len(again) == 20_000 and not passed.id.duplicated().any() and set(again.id) <= set(passed.id)
    assert keys < 1000 or len(passed) - len(again) < 0.02 * (40_000 - len(again))
    assert repeats.possible(rows.limit(0), 0).count() == 0


@pytest.mark.parametrize("total", [10**6, 10**9, 10**12])
def test_few_single_keys_pass_whatever_their_number(total):
    layout = repeats.Layout.of(total)
    n = min(total >> layout.ranges, 1_000_000)  # the keys of one range, in two reports
    assert n >= total >> layout.ranges and layout.bits <= repeats.RANGE_LOG2
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << (64 - layout.ranges), n, dtype=np.int64)
    reports = []
    for part in (h[::2], np.append(h[1::2], h[:100])):
        places, seen = np.unique(np.concatenate(layout.places(part)), return_counts=True)
        reports.append((repeats._pack(places[seen == 1]), repeats._pack(places[seen > 1])))
    bits = layout.merge(reports)
    passed = layout.maybe(h, bits)
    assert passed[:100].all() and passed[100:].mean() < 0.02


# --- 10: shared spans ----------------------------------------------------------------------------------


def shared_by_force(texts, k=250):
    seen = defaultdict(set)
    for i, t in texts:
        for a in range(len(t or "") - k + 1):
            seen[t[a : a + k]].add(i)
    out = {}
    for i, t in texts:
        marked = set()
        for a in range(len(t or "") - k + 1):
            if len(seen[t[a : a + k]]) > 1:
                marked.update(range(a, a + k))
        if marked:
            out[i] = len(marked)
    return out


def planted(rng, n):
    sign = lambda: rng.choice("abcdefghij  .!é\n")
    pool = ["".join(sign() for _ in range(rng.choice([240, 249, 250, 251, 252, 260, 300, 400, 900]))) for _ in range(12)]
    texts = []
    for i in range(n):
        parts = ["".join(sign() for _ in range(rng.randrange(0, 200)))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(pool)
            cut = rng.choice([0, 0, rng.randrange(0, 60)])
            parts += [s[cut:], "".join(sign() for _ in range(rng.randrange(0, 120)))]
        texts.append((i, "".join(parts)))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_against_brute_force(spark, seed):
    texts = planted(random.Random(seed), 60) + [(100, "a" * 700), (101, "b" + "a" * 300), (102, "ab" * 400), (103, "x" * 5 + "ab" * 140), (104, None), (105, ""), (106, "short")]
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared_amounts(docs(spark, texts), "doc_id", "text").collect()}
    assert got == shared_by_force(texts)


def test_shared_spans_with_hot_runs_and_slices(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "HOT_RUN", 5)
    monkeypatch.setattr(shared_spans, "_LONGEST", 700)
    monkeypatch.setattr(shared_spans, "_BATCH", 3000)
    texts = planted(random.Random(9), 50)
    texts.append((200, "".join(t for _, t in texts[:12])))
    got = {r.doc_id: r.shared_chars for r in shared_spans.shared_amounts(docs(spark, texts), "doc_id", "text").collect()}
    assert got == shared_by_force(texts)


def test_later_holders_lose_repeated_sentences(spark):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()
    rng = random.Random(8)
    common = " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(8))
    df = docs(spark, [(1, "Alpha one. " + common + " Omega one."), (2, "Alpha two. " + common + " Omega two."), (3, "Nothing here."), (4, None), (5, common)])
    got = {r.doc_id: (r.kept, r.removed) for r in shared_spans.without_repeats(df, "doc_id", "text").collect()}
    assert got[1] == ("Alpha one. " + common + " Omega one.", 0) and got[2] == ("Alpha two. Omega two.", 8)
    assert got[3] == ("Nothing here.", 0) and got[4] == (None, 0) and got[5] == ("", 8)


def test_repeats_within_one_document_are_not_shared(spark):
    t = "".join(random.Random(4).choices("abcdefgh ", k=300))
    df = docs(spark, [(1, t + "--" + t), (2, "other" * 100), (None, t), (3, None)])
    assert shared_spans.shared_amounts(df, "doc_id", "text").count() == 0
    assert shared_spans.shared_amounts(df.limit(0), "doc_id", "text").count() == 0


# --- 9: leaks ------------------------------------------------------------------------------------------


def leaks_by_force(texts, items, n=12):
    grams = lambda t: {tuple(w[k : k + n]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for k in range(len(w) - n + 1)}
    g = {i: grams(t) for i, t in items}
    return sorted((d, i) for d, t in texts for i in g if g[i] & grams(t))


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_leaks_against_brute_force(spark, edits):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "ké", "zo", "mi") for b in ("tor", "lin", "7", "vas", "x")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 12, 20, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "same words " * 8), (93, "same words " * 8)]
    texts = []
    for d in range(80):
        w = rng.choices(words, k=30)
        if d % 2:
            source = items[rng.randrange(25)][1].split()
            k = rng.randrange(0, max(1, len(source) - 10))
            part = [x.upper() if rng.random() < 0.3 else x for x in source[k : k + rng.choice([8, 11, 12, 13, 25])]]
            w[10:10] = part
        texts.append((d, rng.choice([" ", ", ", "\n", " - "]).join(w)))
    texts += [(200, None), (201, ""), (202, "same words " * 30), (203, "Same-Words " * 6)]
    it = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = leaks.find_leaks(docs(spark, texts), it, "doc_id", "text", "item_id", "text", edits=edits).where("exact")
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == leaks_by_force(texts, items)


def test_near_passages_and_blocks(spark, monkeypatch):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"
    df = docs(spark, [(1, "well " + item.replace("echo", "ecco") + " yes"), (2, item.replace("echo", "sierra")), (3, item)])
    it = spark.createDataFrame([(7, item), (8, "nothing " * 12)], "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 10)
    got = {(r.doc_id, r.item_id): r.exact for r in leaks.find_leaks(df, it, "doc_id", "text", "item_id", "text", edits=1).collect()}
    assert got == {(1, 7): False, (3, 7): True}
    assert leaks.find_leaks(df, it.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.find_leaks(df.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0


# --- 7: samples ----------------------------------------------------------------------------------------

PLAN = "plan_id int, target_no int, project_id string, sample_size long, sentiment string, page_type string, category string, share double, min_rows long"


def test_needed_rows():
    assert raking.needed_rows(0.05, 10, 2) == 2 and raking.needed_rows(0.25, 10, 1) == 3 and raking.needed_rows(0.15, 30, None) == 5 and raking.needed_rows(None, None, 0) == 0


v_plans = "plan_id int, target_no int, project_id string, sample_size long, sentiment string, page_type string, category string, share double, min_rows long"


def test_key_bounds_enclose_the_sample():
    rng = np.random.default_rng(2)
    counts, weights = [50_000, 20_000, 10], [1.0, 0.1, 1e-12]
    keys = np.sort(np.concatenate([rng.exponential(1 / w, n) for n, w in zip(counts, weights)]))
    for take in (1, 100, 20_000, 60_000, 70_009):
        low, high = raking.key_bounds(counts, weights, take)
        below, within = np.searchsorted(keys, [low, high])
        assert below <= take <= within and (high == np.inf or within - below < 40 * np.sqrt(take) + 300)
    assert raking.key_bounds(counts, weights, 70_010) == (np.inf, np.inf)


def test_large_samples_are_the_smallest_keys(spark, monkeypatch):
    v = spark.range(20_000).selectExpr("id ord", "'p' project_id", "if(id % 3 = 0, 'negative', 'positive') sentiment", "cast(null as string) page_type", "if(id % 5 = 0, 'a', 'b') category")
    plans = spark.createDataFrame([(1, 1, None, 8_000, "negative", None, None, 0.5, 0), (1, 2, None, 8_000, "positive", None, None, 0.5, 0)], v_plans)
    sample, report = raking.raked_sample(v, plans, "ord")
    assert [(r.taken, r.gap) for r in report.orderBy("target_no").collect()] == [(4000, 0)] * 2
    monkeypatch.setattr(raking, "key_bounds", lambda *a: (0.0, float("inf")))  # all rows ranked
    assert sorted(sample.collect()) == sorted(raking.raked_sample(v, plans, "ord")[0].collect())
    monkeypatch.setattr(raking, "key_bounds", lambda *a: (5.0, 6.0))  # wrong bounds are noticed
    assert sorted(sample.collect()) == sorted(raking.raked_sample(v, plans, "ord")[0].collect())


def test_raking_meets_margins():
    counts = [40, 10, 30, 20]  # cells of two fields with two values each
    w = raking.rake(counts, [[0, 1], [2, 3], [0, 2], [1, 3]], [0.3, 0.7, 0.6, 0.4])
    total = sum(a * b for a, b in zip(w, counts))
    share = lambda m: sum(w[i] * counts[i] for i in m) / total
    assert share([0, 1]) == pytest.approx(0.3, abs=1e-6) and share([0, 2]) == pytest.approx(0.6, abs=1e-6)


def test_plans(spark):
    v = spark.createDataFrame([(i, "p" if i % 3 else "q", ["pos", "neg", None, "unknown"][i % 4], "forum", None, "clash") for i in range(200)], "ord long, project_id string, sentiment string, page_type string, category string, plan_id string")
    plans = spark.createDataFrame([(1, 1, None, 100, "pos", None, None, 0.5, 5), (1, 2, None, 100, "neg", None, None, 0.3, 5), (1, 3, None, 100, "unknown", None, None, 0.2, 5), (2, 1, "q", 10, "rare", None, None, 0.1, 3), (2, 2, "q", 10, None, "forum", "unknown", 0.9, 1), (3, 1, "none", 10, None, None, None, 1.0, 0)], PLAN)
    r = {(x.plan_id, x.target_no): (x.needed, x.available, x.met) for x in raking.plan_report(v, plans).collect()}
    assert r == {(1, 1): (50, 50, True), (1, 2): (30, 50, True), (1, 3): (20, 50, True), (2, 1): (3, 0, False), (2, 2): (9, 67, True), (3, 1): (10, 0, False)}
    sample, report = raking.raked_sample(v, plans, "ord")
    rows = sample.collect()
    assert len({(x.plan_id, x.ord) for x in rows}) == len(rows)
    assert {(x.plan_id, x.target_no): (x.taken, x.gap) for x in report.collect()} == {(1, 1): (50, 0), (1, 2): (30, 0), (1, 3): (20, 0), (2, 1): (0, 3), (2, 2): (9, 0), (3, 1): (0, 10)}
    assert sorted(rows) == sorted(raking.raked_sample(v.repartition(7), plans, "ord")[0].collect())
    assert raking.plan_report(v.limit(0), plans).where("available > 0").count() == 0 and raking.plan_report(v, plans.limit(0)).count() == 0


def test_overlapping_targets_share_their_rows(spark):
    # All of y is positive: rows drawn for y count for pos too.
    v = spark.createDataFrame([(i, "p", "pos" if i < 60 else "neg", "forum", "y" if i < 40 else "z") for i in range(200)], "ord long, project_id string, sentiment string, page_type string, category string")
    plans = spark.createDataFrame([(1, 1, None, 100, "pos", None, None, 0.5, 5), (1, 2, None, 100, "neg", None, None, 0.5, 5), (1, 3, None, 100, None, None, "y", 0.4, 38), (1, 4, None, 100, None, None, "z", 0.6, 5)], PLAN)
    sample, report = raking.raked_sample(v, plans, "ord")
    rows = sample.collect()
    assert len({r.ord for r in rows}) == len(rows) == 100
    assert {r.target_no: (r.taken, r.gap) for r in report.collect()} == {1: (50, 0), 2: (50, 0), 3: (40, 0), 4: (60, 0)}


def test_repair_moves_rows_along_targets():
    # a target takes from a group whose other target has none to spare, which takes elsewhere in turn
    meets = [{0, 2}, {0, 3}, {1, 2}, {1, 3}]
    x = raking.repair([0, 5, 5, 0], [5, 5, 5, 5], meets, [7, 3, 5, 5], 10, [0.25] * 4)
    assert sum(x) == 10 and (x[0] + x[1], x[2] + x[3], x[0] + x[2], x[1] + x[3]) == (7, 3, 5, 5)
    assert raking.repair([10, 0], [10, 4], [{0}, {1}], [0, 6], 10, [0.9, 0.1], beyond=True) == [6, 4]
    assert raking.repair([10, 0], [10, 4], [{0}, {1}], [10, 3], 10, [0.9, 0.1], beyond=True) == [10, 3]
