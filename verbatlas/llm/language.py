"""Languages of texts and of the segments of mixed ones, with a calibrated confidence.

A sparse multinomial logistic regression on TF-IDF of character n-grams, trained on the driver from a
bounded sample of labelled rows with follow-the-regularised-leader and elastic-net penalties. As labels
are often wrong, rows that a first fit contradicts are left out of the next, twice; a temperature for
sentences is fitted on sentences that were held out. What is reported, the confidence of whole texts and
segments, is calibrated on further labelled rows that no fit has seen, all of them: a second temperature
and the share of wrong labels are fitted together, so that the labels' noise doesn't pass for doubt.

A text is cut into sentences; the scores of all n-grams of a batch are summed once, so that each
sentence costs one subtraction. The most likely sequence of languages, with a price for each change
(higher within a sentence than between two), gives the segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .codes import codes

LANGUAGES = ("fr", "en", "de", "es", "it", "pt", "nl")
#: Spellings of the languages' labels. Fixed values.
LABELS = {
    "fr": "fr fra fre french français francais francese francés frances französisch frans francês",
    "en": "en eng english anglais englisch inglés ingles inglese engels inglês",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco duits alemão",
    "es": "es spa spanish español espanol espagnol spanisch spagnolo spaans espanhol castellano",
    "it": "it ita italian italiano italien italienisch italiaans",
    "pt": "pt por portuguese português portugues portugais portugiesisch portoghese portugees",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch holandés olandese holandês",
}
_BY_LABEL = {w: lang for lang, words in LABELS.items() for w in words.split()}

#: Most labelled rows that the model is trained on, by table; a quarter as many more calibrate it, in a smaller table one in sixteen.
TRAIN_VERBATIMS, TRAIN_DOCUMENTS = 4_000, 600
MIN_LETTERS = 20
GRAMS = 4
BUCKETS_LOG2 = 17
#: Prices, in log-likelihood, of a change of language between sentences and within one.
BETWEEN, WITHIN = 3.5, 7.0
_UNIT = 48
_ENDS = re.compile(r"[.!?…]+[\"»”’)\]]*(?=\s|$)|[\n\r\u2028\u2029|;]+")
#: Addresses, handles and tags say nothing about a language.
_NEUTRAL = re.compile(r"https?://\S+|www\.\S+|[^\s@]+\s?(?:@|\(at\)|\[at\])\s?\S+(?: ?\[dot\] ?\S+)*|[@#]\w+", re.I)
#: A sentence with contact data is mostly names.
_CONTACT = re.compile(r"@|\(at\)|\[at\]|\d[\d .()/-]{6,}\d|\b(?:signé|regards|groeten|saluti|saludo|cumprimentos|grüße|cordialement)\b")
_CONTACT_WEIGHT = 0.3
#: Sentences are calibrated by their number of letters: up to the first, the second, …, and longer ones.
_SIZES = (8, 12, 16, 20, 26)


def label_language(label: str | None) -> str | None:
    """The language that a label names in any spelling, or None if it names none of LANGUAGES."""
    low = (label or "").strip().lower()
    return _BY_LABEL.get(low) or _BY_LABEL.get(re.split(r"[-_ (]", low)[0])


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for i in range(0x30000):
        if chr(i).isalpha():
            table[i] = True
    return table


_LETTERS: list[np.ndarray] = []


def _signs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a lower-case text with everything but letters made a blank, and which are letters."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    cp = codes(text)
    letter = _LETTERS[0][cp]
    return np.where(letter, cp, 32).astype(np.uint64), letter


def _buckets(signs: np.ndarray) -> list[np.ndarray]:
    """The bucket of each n-gram, by n; of n = 2 … there are n - 1 fewer."""
    out, h = [], np.zeros(len(signs), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS + 1):
            if n > len(signs):
                break
            h = h[: len(signs) - n + 1] * np.uint64(0x100000001B3) + signs[n - 1 :]
            out.append(((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64))
    return out


def split_units(text: str) -> list[tuple[int, int, bool]]:
    """Spans (start, end, begins a sentence?) of at most about _UNIT characters; sentences are whole unless longer."""
    out, at = [], 0
    edges = [m.end() for m in _ENDS.finditer(text)]
    for end in [*edges, len(text)]:
        first = True
        while at < end:
            cut = end if end - at <= 1.5 * _UNIT else text.find(" ", at + _UNIT, end - 12)
            cut = end if cut < 0 else cut
            out.append((at, cut, first))
            at, first = cut, False
    return out


@dataclass
class Model:
    weights: np.ndarray  # bucket x language, times idf, over the temperature of long sentences
    warmth: np.ndarray | None = None  # by class of _SIZES: how much less sure its scores are than those of long sentences
    heat: float = 1.0  # how much less sure the sum of a text's sentences is than they say
    noise: float = 0.0  # share of labels that say nothing about their text

    def sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Running sums, from 0, of all n-grams' scores and of letters."""
        signs, letter = _signs(text)
        score = np.zeros((len(signs), len(LANGUAGES)), np.float32)
        for b in _buckets(signs):
            score[: len(b)] += self.weights[b]
        zero = np.zeros((1, len(LANGUAGES)))
        return np.concatenate([zero, np.cumsum(score, axis=0, dtype=np.float64)]), np.concatenate([[0], np.cumsum(letter)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per text: buckets, counts, and the root of the number of n-grams."""
    out = []
    for t in texts:
        signs, _ = _signs(t.lower())
        b, n = np.unique(np.concatenate(_buckets(signs)), return_counts=True)
        out.append((b, n.astype(np.float64), np.sqrt(n.sum())))
    return out


def _ftrl(rows: list, labels: np.ndarray, idf: np.ndarray, epochs: int, seed: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.005, l2: float = 0.005) -> np.ndarray:
    """Follow-the-regularised-leader with a learning rate per weight; l1 leaves most weights at zero."""
    z, n = np.zeros((1 << BUCKETS_LOG2, len(LANGUAGES))), np.zeros((1 << BUCKETS_LOG2, len(LANGUAGES)))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, count, root = rows[i]
            x = count * idf[b] / root
            zb, nb = z[b], n[b]
            w = weights(zb, nb)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            gg = g * g
            z[b] = zb + g - (np.sqrt(nb + gg) - np.sqrt(nb)) / alpha * w
            n[b] = nb + gg
    return weights(z, n)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A model of labelled texts; languages without examples are never chosen. Without any texts, all are alike."""
    keep = [i for i, t in enumerate(texts) if sum(map(str.isalpha, t)) >= 8]
    y = np.array([LANGUAGES.index(labels[i]) for i in keep], np.int64)
    rows = _features([texts[i] for i in keep])
    if not rows:
        return Model(np.zeros((1 << BUCKETS_LOG2, len(LANGUAGES)), np.float32))
    df = np.bincount(np.concatenate([b for b, _, _ in rows]), minlength=1 << BUCKETS_LOG2)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    kind = np.searchsorted(_SIZES, [sum(map(str.isalpha, texts[i])) for i in keep])
    held = np.random.default_rng(seed).random(len(rows)) < 0.1
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))

    def scores(w: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.array([(rows[i][1] * idf[rows[i][0]] / rows[i][2]) @ w[rows[i][0]] for i in which])

    doubtful = np.zeros(len(rows), bool)
    for _ in range(2):  # labels are often wrong: what a first fit contradicts is left out of the next
        kept = fit[~doubtful[fit]]
        p = _softmax(scores(_ftrl([rows[i] for i in kept], y[kept], idf, 1, seed), np.arange(len(rows))))
        # A short one may hold nothing but names and figures: what contradicts it is its evidence, not its label.
        doubtful = (p.argmax(1) != y) & (p.max(1) > 0.5) & (kind == len(_SIZES))
    fit = fit[~doubtful[fit]]
    w = _ftrl([rows[i] for i in fit], y[fit], idf, 3, seed)
    long = kind == len(_SIZES)
    noise = doubtful[long].mean() if long.any() else 0.0  # of the labels, in short rows as in long ones
    grid, temperature = np.geomspace(0.05, 20, 90), np.ones(len(_SIZES) + 1)

    def best(which: np.ndarray, noise: float) -> float:
        s, at = scores(w, which), (np.arange(len(which)), y[which])
        return float(grid[int(np.argmin([-np.log((1 - noise) * _softmax(s / t)[at] + noise / len(LANGUAGES) + 1e-9).mean() for t in grid]))])

    if (check := held & ~doubtful & long).any():
        temperature[:] = best(np.flatnonzero(check), 0.0)
    for k in range(len(_SIZES)):
        if (check := held & (kind == k)).any():
            temperature[k] = max(temperature[-1], best(np.flatnonzero(check), noise))
    return Model((w * idf[:, None] / temperature[-1]).astype(np.float32), temperature / temperature[-1])


def _path(score: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The most likely language of each unit, given log-likelihoods and the prices of changes."""
    best, back = score[0].copy(), np.zeros(score.shape, np.int64)
    for i in range(1, len(score)):
        j = int(best.argmax())
        jump = best[j] - (BETWEEN if begins[i] else WITHIN)
        stay = best >= jump
        back[i] = np.where(stay, np.arange(len(best)), j)
        best = np.where(stay, best, jump) + score[i]
    path = np.zeros(len(score), np.int64)
    path[-1] = int(best.argmax())
    for i in range(len(score) - 1, 0, -1):
        path[i - 1] = back[i][path[i]]
    return path


def _segments(path: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (language, first unit, last unit + 1), of any number of letters: the path's prices have decided."""
    edges = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
    return [(int(path[x]), x, y) for x, y in zip(edges, edges[1:])]


def _units(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of the sentences of all texts: text, whether one begins, letters, and weighted log-likelihoods of the languages."""
    low = [t.lower() for t in texts]
    blank = [_NEUTRAL.sub(lambda m: " " * len(m.group()), t) if "@" in t or "#" in t or "www" in t or "://" in t or "at" in t and ("[at]" in t or "(at)" in t) else t for t in low]
    gap = " " * GRAMS
    sums, letters = model.sums(gap.join(blank))
    a, b, begins, owner, plain, at = [], [], [], [], [], 0
    for k, t in enumerate(low):
        for x, y, first in split_units(t):
            a.append(at + x)
            b.append(at + y)
            begins.append(first)
            owner.append(k)
            plain.append(not _CONTACT.search(t, x, y))
        at += len(t) + GRAMS
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, len(LANGUAGES)))
    a, b, begins, owner = np.array(a), np.array(b), np.array(begins), np.array(owner)
    count = letters[b] - letters[a]
    total = (sums[b] - sums[a]) / np.sqrt(GRAMS * np.maximum(1, b - a))[:, None]
    if model.warmth is not None:
        total /= model.warmth[np.searchsorted(_SIZES, count)][:, None]
    log_p = np.log(_softmax(total) + 1e-5) * (np.minimum(1, count / 12) * np.where(plain, 1, _CONTACT_WEIGHT))[:, None]  # a few letters say little
    return owner, begins, count, log_p


def identify(model: Model, texts: list[str]) -> list[list[tuple[str, float, int]]]:
    """Of each text its segments (language, confidence, letters) in order; none for fewer than MIN_LETTERS letters."""
    owner, begins, count, log_p = _units(model, texts)
    if not len(owner):
        return [[] for _ in texts]
    best, sure = log_p.argmax(1), count > 0  # the path cannot change where all agree
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    last = np.append(first[1:], len(owner))
    many = np.maximum.reduceat(np.where(sure, best, -1), first) > np.minimum.reduceat(np.where(sure, best, len(LANGUAGES)), first)
    whole, size = np.add.reduceat(log_p, first, axis=0), np.add.reduceat(count, first)
    main = whole.argmax(1)
    text_p = _softmax(whole / model.heat)
    out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
    for k, f, e, n, mixed, lang, p in zip(owner[first].tolist(), first.tolist(), last.tolist(), size.tolist(), many.tolist(), main.tolist(), text_p.max(1).tolist()):
        if n < MIN_LETTERS:
            continue
        if not mixed:
            out[k] = [(LANGUAGES[lang], p, n)]
            continue
        for lang, x, y in _segments(_path(log_p[f:e], begins[f:e])):
            p = float(_softmax(log_p[f + x : f + y].sum(0) / model.heat)[lang])
            out[k].append((LANGUAGES[lang], p, int(count[f + x : f + y].sum())))
    return out


def calibrate(model: Model, texts: list[str], labels: list[str]) -> Model:
    """The model with the temperature of whole texts and the share of wrong labels that make these labels most likely."""
    owner, _, count, log_p = _units(model, texts)
    if not len(owner):
        return model
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    whole, long = np.add.reduceat(log_p, first, axis=0), np.add.reduceat(count, first) >= MIN_LETTERS
    y = np.array([LANGUAGES.index(labels[k]) for k in owner[first]])[long]
    if not len(y):
        return model
    best = (np.inf, 1.0, 0.0)
    for heat in np.geomspace(0.25, 64, 65):
        p = _softmax(whole[long] / heat)[np.arange(len(y)), y]
        for noise in np.linspace(0, 0.5, 51):
            best = min(best, (-np.log((1 - noise) * p + noise / len(LANGUAGES) + 1e-12).mean(), float(heat), float(noise)))
    return Model(model.weights, model.warmth, best[1], best[2])


def _sample(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """About `rows` labelled rows to train on and a quarter as many to calibrate, never more than twice that: by
    bounds on their hash, the same in every run; of a small table one in sixteen calibrates.

    All labelled rows are counted to set the bounds, so that only sampled texts leave the workers.
    """
    label = F.lower(F.trim(label_col))
    known = df.where((F.length(text_col) >= MIN_LETTERS) & F.split(label, "[-_ (]")[0].isin(sorted(_BY_LABEL)))
    space = 1 << 40
    bound = min(space * 15 // 16, space * rows // max(1, known.count()))
    drawn = known.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), label.alias("label")).where(F.pmod("h", F.lit(space)) < bound + bound // 4)
    found = sorted(drawn.limit(5 * rows // 2).collect(), key=lambda r: (r.h, r.text))
    pairs = [[(r.text, label_language(r.label)) for r in found if (r.h % space < bound) == train] for train in (True, False)]
    return pairs[0], pairs[1]


def fit(*tables: tuple[DataFrame, str, str, str, int]) -> Model:
    """Trains on the sentences of labelled rows of tables (df, id, text, label, most rows), and calibrates on other rows of them."""
    texts, labels, further = [], [], []
    for df, id_col, text_col, label_col, rows in tables:
        train_rows, held = _sample(df, id_col, text_col, label_col, rows)
        further += held
        for text, lang in train_rows:
            for a, b, first in split_units(text):
                texts.append(_NEUTRAL.sub(" ", text[a:b]))
                labels.append(lang)
    return calibrate(train(texts, labels), [t for t, _ in further], [x for _, x in further])


def identify_languages(df: DataFrame, model: Model, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows (id_col, seg, lang, confidence, letters, label) of every text of at least MIN_LETTERS letters.

    seg 0 is the main language, that with most letters; seg 1, 2, … are the segments of a mixed text, in
    order. `label` is the language that the row's label names, null if none. Null, empty and shorter
    texts give no row; repeated rows give rows each; texts are read whole; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.warmth, model.heat))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for i, segments in enumerate(identify(model, texts)):
                    if not segments:
                        continue
                    letters: dict[str, int] = {}
                    for lang, _, n in segments:
                        letters[lang] = letters.get(lang, 0) + n
                    main = max(letters, key=lambda x: letters[x])
                    sure = [(p, n) for lang, p, n in segments if lang == main]
                    rows.append((i, 0, main, sum(p * n for p, n in sure) / sum(n for _, n in sure), letters[main]))
                    if len(segments) > 1:
                        rows += [(i, s, *x) for s, x in enumerate(segments, 1)]
                at, seg, lang, p, n = zip(*rows) if rows else ((), (), (), (), ())
                labels = list(map(label_language, part.column("label").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(at, pa.int64())), pa.array(seg, pa.int32()), pa.array(lang, pa.string()), pa.array(p, pa.float64()), pa.array(n, pa.int64()), pa.array([labels[i] for i in at], pa.string())],
                    [id_col, "seg", "lang", "confidence", "letters", "label"],
                )

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, seg int, lang string, confidence double, letters long, label string")
