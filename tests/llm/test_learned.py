"""Operators with a learned or corpus-built part: examples, held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatlas.llm import garbled, language, personal

DATA = "/root/testdata/sf0.01"


# --- 1: languages --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def documents(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null and length(text) > 100").select("doc_id", "text", "lang")
    return d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0")


@pytest.fixture(scope="module")
def model(documents):
    return language.fit((documents[0], "doc_id", "text", "lang", 400))


def test_labels():
    for label, lang in {"FR": "fr", "fr-FR": "fr", "fra": "fr", "français": "fr", "French": "fr", "pt_BR": "pt", " Dutch ": "nl", "spa": "es", "und": None, "??": None, "": None, None: None, "xx": None, "frx": None}.items():
        assert language.label_language(label) == lang


def test_units_cover_the_text():
    for t in ("", "a", "One. Two! Three?\nFour " + "word " * 60 + "x" * 300, "no end", "...", "a|b;c"):
        units = language.split_units(t)
        assert "".join(t[a:b] for a, b, _ in units) == t


def test_held_out_accuracy(model, documents):
    rows = documents[1].collect()
    found = language.identify(model, [r.text for r in rows])
    right = [max(s, key=lambda x: x[2])[0] == r.lang for s, r in zip(found, rows) if s]
    assert len(right) > 200 and sum(right) / len(right) > 0.95  # a few labels are wrong


def test_mixed_texts(model):
    fr, de, en = "Le flacon me donne la nausée, je ne rachèterai pas.", "Die Anleitung macht mir Übelkeit, gar nicht überzeugt.", "The bottle beats my expectations, my friends are won over."
    for parts, langs in (((fr, de), ["fr", "de"]), ((en, fr, en), ["en", "fr", "en"]), ((de, de, fr), ["de", "fr"]), ((en,), ["en"]), ((fr.upper(), en.upper()), ["fr", "en"])):
        assert [s[0] for s in language.identify(model, [" ".join(parts)])[0]] == langs


def test_short_sentences_are_segments(model):
    fr, en = "Le flacon me donne la nausée, je ne rachèterai pas.", "The bottle beats my expectations, my friends are won over."
    for parts, langs in (((en, "Je suis très déçue.", en), ["en", "fr", "en"]), ((fr, "Ich bin sehr zufrieden."), ["fr", "de"]), ((en, "Gar nicht überzeugt."), ["en", "de"]), ((en, "8,4 ml / Pefofa."), ["en"])):
        assert [s[0] for s in language.identify(model, [" ".join(parts)])[0]] == langs, parts


def test_language_rows(spark, model):
    fr = "Le flacon me donne la nausée, je ne rachèterai pas."
    rows = [(1, fr, "FR", "x"), (2, fr, "de", "x"), (3, fr, None, "x"), (4, "ok", None, "x"), (5, None, None, "x"), (6, "", None, "x"), (6, fr, "und", "x"), (7, fr * 3000, "fr", "x"), (8, "1234567890 " * 9 + "!?", None, "x")]
    df = spark.createDataFrame(rows, "ord long, full_text string, language string, lang string")
    got = language.identify_languages(df, model, "ord", "full_text", "language").collect()
    assert sorted((r.ord, r.seg, r.lang, r.label) for r in got) == [(1, 0, "fr", "fr"), (2, 0, "fr", "de"), (3, 0, "fr", None), (6, 0, "fr", None), (7, 0, "fr", "fr")]
    assert all(0 <= r.confidence <= 1 for r in got)
    assert language.identify_languages(df.limit(0), model, "ord", "full_text", "language").count() == 0


def test_confidence_is_calibrated(spark):
    """Against labels of rows that neither fit has seen, with the noise that was found in the labels taken into account."""
    v = spark.read.parquet(f"{DATA}/project_verbatims.parquet").select("ord", "full_text", "language")
    model = language.fit((v.where("ord % 3 <> 0"), "ord", "full_text", "language", 1500))
    rows = [(r.full_text, language.label_language(r.language)) for r in v.where("ord % 3 = 0").collect() if r.full_text and language.label_language(r.language)]
    stated, right = [], []
    for (_, label), found in zip(rows, language.identify(model, [t for t, _ in rows])):
        if len(found) == 1:
            stated.append((1 - model.noise) * found[0][1] + model.noise / 7)
            right.append(found[0][0] == label)
    stated, right = np.array(stated), np.array(right, float)
    parts = np.array_split(np.argsort(stated), 8)
    assert len(right) > 500 and sum(abs(stated[p].mean() - right[p].mean()) * len(p) for p in parts) / len(right) < 0.06
    assert 0.05 < model.noise < 0.25


def test_calibration_tells_noise_from_doubt(model, documents):
    rows, rng = documents[1].collect(), random.Random(3)
    wrong = [rng.choice(language.LANGUAGES) if rng.random() < 0.35 else r.lang for r in rows]
    found = language.calibrate(model, [r.text for r in rows], wrong)
    assert 0.2 < found.noise < 0.5 and [x[0] for x in language.identify(found, [rows[0].text])[0]] == [x[0] for x in language.identify(model, [rows[0].text])[0]]
    assert language.calibrate(model, [], []) is model and language.calibrate(model, ["", "ab"], ["fr", "fr"]) is model


def test_model_without_examples():
    assert language.identify(language.train([], []), ["Le flacon me donne la nausée"])[0][0][2] == 23


# --- 4: garbled text -----------------------------------------------------------------------------------

WORDS = "été déjà façon garçon crème brûlée où naïf über schön straße señor corazón perché città ação não mão cœur l’été voilà 👍 € €…".split()


def table_of(spark, rows):
    return spark.createDataFrame(rows, "ord long, a string, b string, word string, n long")


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850")]


def test_round_trip_of_every_chain(spark):
    clean = [(i, f"le mot {w} ici", None, "clash", 0) for i, w in enumerate(WORDS)]
    bad = {}
    for k, (enc, dec) in enumerate(CHAINS):
        for i, w in enumerate(WORDS):
            try:
                g = w.encode(enc).decode(dec)
                gg = g.encode(enc).decode(dec) if dec == "cp1252" else None
            except UnicodeDecodeError:
                continue
            bad[1000 * (k + 1) + i] = (g, w)
            if gg:
                bad[1000 * (k + 1) + 500 + i] = (gg, w)
    rows = clean + [(i, f"le mot {g} ici", f"LE MOT {g} ICI", "clash", 0) for i, (g, _) in bad.items()]
    found = {(r.ord, r.field): r.restored for r in garbled.restore_garbled(table_of(spark, rows), "ord", ("a", "b")).collect()}
    assert {i for i, _ in found} == set(bad)
    wrong = [(g, w, found[i, "a"]) for i, (g, w) in bad.items() if found[i, "a"] != f"le mot {w} ici"]
    assert len(wrong) <= 0.05 * len(bad), wrong


def test_lost_confused_and_lowered_forms(spark):
    rows = [(i, "une crème déjà brûlée", None, "x", 0) for i in range(6)] + [
        (10, "une cr�me", None, "x", 0), (11, "une crиme", None, "x", 0), (12, None, "une crã¨me dã©jã brã»lã©e", "x", 0), (13, "inconnu zÃ©zÃ©", None, "x", 0),
        (14, "NÃO É SABÃO, É ALGODÃO", "a manhã» e o «sol»", "x", 0), (15, "", " ", "x", 0), (16, None, None, "x", 0), (None, "crÃ¨me", None, "x", 0), (17, "crÃ¨me " * 30_000, None, "x", 0), (10, "une cr�me", None, "x", 0),
    ]
    df = table_of(spark, rows)
    got = {(r.ord, r.field): r for r in garbled.restore_garbled(df, "ord", ("a", "b")).collect()}
    assert set(got) == {(10, "a"), (11, "a"), (12, "b"), (13, "a"), (17, "a")}
    assert got[10, "a"].restored == got[11, "a"].restored == "une crème" and got[12, "b"].restored == "une crème déjà brûlée"
    assert got[17, "a"].restored == "crème " * 30_000
    assert garbled.find_garbled(df.limit(0), "ord", ("a", "b")).count() == 0


# --- 5: personal data ----------------------------------------------------------------------------------

SAMPLES = [
    ("Écrivez-moi : jean.dupont+avis@mail.example. Merci.", {("email", "jean.dupont+avis@mail.example")}),
    ("Write to me: zoe_81 [at] mail [dot] test today", {("email", "zoe_81 [at] mail [dot] test")}),
    ("Tel +33 (0)5 36 49 98 71.", {("phone", "+33 (0)5 36 49 98 71")}),
    ("Call me back on (305) 555-0118, it is urgent.", {("phone", "(305) 555-0118")}),
    ("Rappelez-moi vite au 04-65-71-29-58, c'est urgent.", {("phone", "04-65-71-29-58")}),
    ("NIR 1 52 40 99 403 659 80, dossier ouvert au nom de Maëlle Tarvin.", {("id_number", "1 52 40 99 403 659 80"), ("name", "Maëlle Tarvin")}),
    ("Mi DNI es 00070946Z para el expediente.", {("id_number", "00070946Z")}),
    ("Meine Steuer-ID lautet 00 937 757 017.", {("id_number", "00 937 757 017")}),
    ("Merci de m'envoyer un échantillon au 167 ter place des Hirondelles - 99786 Oultonne.", {("address", "167 ter place des Hirondelles - 99786 Oultonne")}),
    ("Please send a sample to Flat 4, 156 Heron Road, Haldonne ZZ4 3ZZ.", {("address", "Flat 4, 156 Heron Road, Haldonne ZZ4 3ZZ")}),
    ("Bitte senden Sie eine Probe an Molenstraße 12, 00915 Sorbstead.", {("address", "Molenstraße 12, 00915 Sorbstead")}),
    ("Mme DURVAL Inès m'a répondu au téléphone, mais rien depuis.", {("name", "DURVAL Inès")}),
    ("Regards, holly kerben-vard.", {("name", "holly kerben-vard")}),
    ("Lot 97678, commande n° 41017439, reçu le 17/07/2024.", set()),
    ("Code-barres 3995732141218, payé 33,65 euros.", set()),
    ("Le docteur et la secrétaire étaient adorables.", set()),
    ("Vu à la pharmacie de la grande rue. Merci à @bababa_fan !", set()),
    ("", set()), (None, set()), ("   ", set()), ("x" * 200_000, set()),
]


def test_finds_and_placeholders(spark):
    # Real texts beside the samples, so that reliabilities are estimated from a corpus.
    corpus = spark.read.parquet(f"{DATA}/project_verbatims.parquet").select((F.col("ord") + 1000).alias("ord"), "full_text", F.lit("clash").alias("kind"), F.lit(1).alias("start"))
    samples = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(SAMPLES)], "ord long, full_text string, kind string, start int")
    df = corpus.unionByName(samples).unionByName(samples.limit(3))
    found = personal.find_personal(df, "ord", "full_text").where("ord < 1000").collect()
    for i, (text, exp) in enumerate(SAMPLES):
        assert {(r.kind, text[r.start : r.end]) for r in found if r.ord == i} == exp, text
    assert len(found) == sum(len(e) for _, e in SAMPLES)
    red = {r.ord: r.redacted for r in personal.redact(df, "ord", "full_text").where("ord < 1000").collect()}
    assert red[5] == "NIR [ID], dossier ouvert au nom de [NAME]." and red[0] == "Écrivez-moi : [EMAIL]. Merci." and 14 not in red
    assert personal.find_personal(df.limit(0), "ord", "full_text").count() == 0


def test_a_long_gazetteer_loses_no_name(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/project_verbatims.parquet").select("ord", "full_text")
    found = lambda: sorted(map(tuple, personal.find_personal(df, "ord", "full_text").collect()))
    whole = found()
    monkeypatch.setattr(personal, "GAZETTEER_SIZE", 1)
    assert personal.harvest_names(df, "full_text").count() > 1 and found() == whole


def test_reliabilities_follow_the_votes():
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        true = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < p) == true else -1) if rng.random() < 0.8 else 0 for p in (0.95, 0.9, 0.85, 0.8, 0.6, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
    p = personal.reliabilities(counts)
    assert p[1, 1, 1, 1, 1, 1] > 0.99 and p[-1, -1, -1, -1, -1, -1] < 0.01 if (1,) * 6 in p and (-1,) * 6 in p else True
    score = personal.train_classifier(counts, p)
    assert sum(abs(score[k] - p[k]) * n for k, n in counts.items()) / 4000 < 0.1
    assert personal.reliabilities({}) == {} and personal.train_classifier({}, {}) == {}


def test_long_words_are_restored(spark):
    word = "é" + "xyzé" * 40
    bad = word.encode().decode("cp1252")
    huge = "ñ" * 100_000
    df = spark.createDataFrame([(1, f"le {word} ici"), (2, f"le {bad} ici"), (3, huge), (4, huge.encode().decode("latin-1"))], "ord long, full_text string")
    got = {r.ord: r.restored for r in garbled.restore_garbled(df, "ord", ("full_text",)).collect()}
    assert got == {2: f"le {word} ici", 4: huge}
    assert spark.range(1).select(F.xxhash64(F.lit(word))).first()[0] == garbled._hash(word)
