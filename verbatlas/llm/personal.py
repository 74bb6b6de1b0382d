"""Personal data in free text: found by labelers that vote, and replaced by typed placeholders.

Patterns propose spans; names are proposed by phrases, titles and verbs around them and, anywhere in
prose, by runs of capitalised words of which the gazetteer knows one. For each span, labelers (check of
form, context before and after, gazetteer, shape, signs of something else) vote for, against, or
abstain. Votes are counted over the whole corpus by pattern of votes; expectation-maximisation estimates
from these counts how reliable each labeler is and how likely each pattern is personal data. A logistic
regression on votes, pairs of votes, the span's shape and the words next to it, trained on those
likelihoods, decides on every span. The gazetteer of names is read off the corpus itself: names that
follow phrases of introduction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
LABELERS = ("form", "before", "after", "gazetteer", "shape", "decoy")
#: A given name enters the gazetteer if so many texts introduce it; a gazetteer of up to so many names is broadcast, a longer one joined.
GAZETTEER_TEXTS, GAZETTEER_SIZE = 2, 50_000

#: About how many spans of each kind the classifier is trained on, and the buckets of its hashed features.
TRAIN_SPANS, BUCKETS_LOG2 = 4_000, 14

# --- Fixed values: phrases and words of the languages -------------------------------------------------
INTRODUCTIONS = """
je m'appelle|mon nom est|au nom de|de la part de|my name is|in the name of|ich heiße|ich heisse|mein name ist|auf den namen|im namen von
me llamo|mi nombre es|a nombre de|mi chiamo|il mio nome è|a nome di|chamo-me|o meu nome é|em nome de|ik heet|mijn naam is|op naam van
signé|signed|gezeichnet|firmado|firmato|assinado|getekend|opened for|eröffnet für|aperta per|abierto para|aberto para|geopend voor
un saludo,|un abrazo,|regards,|best wishes,|sincerely,|cordialement,|bien à vous,|salutations,|grüße,|gruß,|saludos,|atentamente,|saluti,|cumprimentos,|atenciosamente,|groeten,|groet,
contact -|contact :|kontakt -|kontakt :|contacto -|contatto -|contato -
"""
TITLES = "mme madame mlle monsieur mr mr. mrs mrs. ms ms. miss frau herr herrn señora señor sra. sr. signora signor sig. sig.ra senhora senhor mevrouw meneer dhr. mevr. dr dr. dra. prof prof. docteur docteure doctor doctora doktor dottor dottore dottoressa doutor doutora dokter dott. dott.ssa"
ANSWERED = """
m'a répondu|m'a rappelé|a répondu|answered the phone|picked up the phone|hat abgehoben|hat geantwortet|contestó|respondió|ha risposto|atendeu|respondeu|nam op|antwoordde
me l'avait|had warned|hatte mir|me lo había|me l'aveva|tinha-me|bem me tinha|had het me|had me
"""
CALLS = """
tel|tél|téléphone|telephone|phone|telefon|teléfono|telefono|telefone|telefoon|mobile|portable|handy|call|rappelez|appelez|joindre|llamar|llámenme|chiamat|richiamat|ligar|liguem|bellen|bel me
erreichen|rufen|contact|kontakt|contacto|urgent|urgente|dringend|dringen|whatsapp|bereikbaar|contattar|chiamarmi|raggiung
"""
IDENTITY = """
nir|sécu|sécurité sociale|insurance|social security|ssn|dni|nie|nif|codice fiscale|steuer-id|steuernummer|steuer-identifikationsnummer|bsn|burgerservicenummer|cpf|passport|passeport|identity|identité|sozialversicherung
id no|id nr|id number|id-nr|n° d'identité|ausweisnummer|número de identidad|número de identificação|numero di identità
"""
LIVING = """
habite|adresse|échantillon au|arriver au|envoyer|live at|sample to|gone to|address|wohne|probe an|anschrift|vivo en|muestra a|dirección|abito|campione in|indirizzo|moro|amostra para|endereço|woon|monster naar|adres
"""
DECOYS = """
lot|lote|charge|batch|partij|lotto|commande|bestellung|order|pedido|ordine|encomenda|bestelling|code-barres|barcode|strichcode|codice a barre|código|streepjescode|réf|référence|reference|referenz|referencia|riferimento|referência|version|note
"""
STREETS_BEFORE = {  # number, then type, then name; or type, name, number
    "fr": "rue avenue av. place bd bd. boulevard chemin impasse allée allee cours quai route square passage sentier faubourg",
    "es": "calle c/ avenida avda. plaza paseo camino carretera travesía ronda",
    "it": "via viale piazza corso largo vicolo strada",
    "pt": "rua avenida travessa praça largo alameda estrada",
}
STREETS_AFTER = "street st. road rd. lane close avenue drive way court crescent gardens place square terrace hill"
STREET_ENDINGS = "straße strasse str. gasse weg platz allee ring damm ufer straat laan plein gracht kade singel dijk"
#: National numbers without a leading 0 or +, digits only: Spain, Portugal, Italy, North America.
NATIONAL = r"[6789]\d{8}|2\d{8}|3\d{8,9}|[2-9]\d\d[2-9]\d{6}"
#: Words whose full stop doesn't end a sentence.
SHORTENED = "tel tél tfno tlf mob no nr n nº num núm ref réf st av avda bd c dr dra sr sra mr mrs ms sig prof"
SMALL_WORDS = "le la les un une des du de et mais est the a an and but is of der die das und aber ist von el los y pero es il lo gli e ma o os as um uma het een en maar mon ma mes my mein meine mi mio me had hatte"
# ------------------------------------------------------------------------------------------------------


def _phrases(text: str) -> str:
    return "|".join(re.escape(p).replace(r"\ ", r"\s+").replace("'", "['’]") for line in text.strip().splitlines() for p in sorted(line.split("|"), key=len, reverse=True))


def _words(text: str) -> str:
    return "|".join(re.escape(w) for w in sorted(text.split(), key=len, reverse=True))


_I = re.IGNORECASE
_TOKEN = r"(?:[^\W\d_]\.|[^\W\d_][^\W\d_'’]+(?:-[^\W\d_'’]+)*)"
_INTRO = re.compile(rf"(?:(?<!\w)(?:{_phrases(INTRODUCTIONS)})|(?<!\w)(?P<title>{_words(TITLES)})(?=\s))\s*(?P<name>{_TOKEN}(?:\s+{_TOKEN}){{0,2}})", _I)
_INTRO_ONLY = re.compile(rf"(?<!\w)(?:{_phrases(INTRODUCTIONS)})\s*(?P<name>{_TOKEN}(?:\s+{_TOKEN})?)", _I)
_TITLE = re.compile(rf"(?:{_words(TITLES)})\Z", _I)
_ANSWER = re.compile(rf"(?P<name>(?:{_TOKEN}\s+){{1,4}})(?:{_phrases(ANSWERED)})(?!\w)", _I)
_AT = r"(?:@|\(at\)|\[at\]|\{at\})"
_EMAIL = re.compile(rf"(?P<v>[\w+-]+(?:\.[\w+-]+)*\s?{_AT}\s?[\w-]+(?:(?:\.|\s?(?:\[dot\]|\(dot\))\s?)[^\W_][\w-]*)+)", _I)
_DIGITS = re.compile(r"(?<![\w+.,/-])(?P<v>(?:\+|00)?\(?\d(?:[\s.()/-]{0,2}\d){6,16})(?!\w)")
_CODES = re.compile(r"(?<!\w)(?P<v>[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]|[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]|[XYZ]?\d{7,8}-?[A-Z]|[12]\s?\d\d\s?\d\d\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d\d)?)(?!\w)", _I)
_HOUSE = r"\d{1,4}(?:\s?(?:bis|ter|quater|[a-d]))?"
_ADDRESSES = [
    re.compile(rf"(?<!\w)(?P<v>{_HOUSE},?\s+(?:{_words(STREETS_BEFORE['fr'])})\s+[^\W\d_])", _I),
    re.compile(rf"(?<!\w)(?P<v>(?:(?:flat|apartment|apt\.?|unit)\s+\d+\w?,\s*)?{_HOUSE}\s+(?:[^\W\d_][\w'’-]*\s+){{1,3}}(?:{_words(STREETS_AFTER)})(?!\w))", _I),
    re.compile(rf"(?<!\w)(?P<v>(?:{_words(' '.join(STREETS_BEFORE[x] for x in ('es', 'it', 'pt')))})\s+(?:[^\W\d_][\w'’-]*\s+){{0,4}}[^\W\d_][\w'’-]*,?\s+(?:n\.?º\s*)?{_HOUSE}(?!\w))", _I),
    re.compile(rf"(?<!\w)(?P<v>[^\W\d_][\w'’-]*(?:{_words(STREET_ENDINGS)})\s+{_HOUSE}(?!\w))", _I),
]
_STREET_REST = re.compile(r"(?:[\w'’]*(?:[ \t\xa0]+[^\W\d_][\w'’]*){0,5}?)(?=\s*[,.\n–-]|\s+\d|\Z)")
_CITY = re.compile(r"(?:,\s*\d+º\s*\w)?(?:\s*[,–-]\s*|\s+)(?:\d{4,5}(?:-\d{3})?(?:\s?[A-Z]{2})?\s+[^\W\d_][\w'’-]+|[^\W\d_][\w'’-]+\s+[A-Z]{1,2}\d\w?\s?\d[A-Z]{2})", _I)
_POSTAL = re.compile(r"[\s,–-]+(?:\d{4,5}(?:-\d{3})?|[A-Z]{1,2}\d)|,?\s+\d{4}\s?[A-Z]{2}|,?\s+[^\W\d_]\w+\s+[A-Z]{1,2}\d", _I)
_CALLS, _IDENTITY, _LIVING, _DECOYS = (re.compile(rf"(?<!\w)(?:{_phrases(x)})", _I) for x in (CALLS, IDENTITY, LIVING, DECOYS))
_SMALL = frozenset(SMALL_WORDS.split())
_NATIONAL = re.compile(NATIONAL)
_SHORTENED = frozenset(SHORTENED.split())
_LAST_WORD = re.compile(r"\w*\Z")
#: Two or three words with a capital; the first words of sentences are among them.
_CAPITALS = re.compile(r"(?<![\w@#])[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[ \xa0-][^\W\d_a-zß-öø-ÿ][^\W\d_]+){1,2}(?!\w)")
#: Characters that take no room on the page, made blanks so that patterns see words; positions stay.
_UNSEEN = {c: " " for c in (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD, 0x2060)}
#: What tells which patterns are worth trying on a text: flags by word that must stand in it.
INTRO, TITLE, ANSWER, AT, STREET, NUMBER = 1, 2, 4, 8, 16, 32
_SIX_DIGITS = re.compile(r"(?:\d[\s.()/-]{0,2}){6}|[a-z]{6}\d\d[a-z]\d\d", _I)


@lru_cache(1)
def _finder():
    import ahocorasick

    flags: dict[str, int] = {}
    for flag, phrases in ((INTRO, INTRODUCTIONS), (ANSWER, ANSWERED)):
        for p in phrases.strip().replace("\n", "|").split("|"):
            word = max(re.split(r"[\s'’]+", p), key=len).strip(",:-")
            flags[word] = flags.get(word, 0) | flag
    for words, flag in ((TITLES, TITLE), (" ".join([*STREETS_BEFORE.values(), STREETS_AFTER, STREET_ENDINGS]), STREET), ("@ (at) [at] {at}", AT)):
        for w in words.split():
            flags[w] = flags.get(w, 0) | flag
    automaton = ahocorasick.Automaton()
    for w, flag in flags.items():
        automaton.add_word(w, flag)
    automaton.make_automaton()
    return automaton


def flags_of(text: str) -> int:
    """Which kinds of personal data the words of a text leave possible."""
    out = 0
    for _, flag in _finder().iter(text.lower()):
        out |= flag
    return out | (NUMBER if _SIX_DIGITS.search(text) else 0)


def _near(text: str, at: int, size: int) -> str:
    """The end of the sentence up to `at`, of at most `size` characters; the full stop of a shortened word ends none."""
    part = text[max(0, at - size) : at]
    cut = max(part.rfind("\n"), part.rfind("! "), part.rfind("? "))
    stop = part.rfind(". ")
    while stop > cut and _LAST_WORD.search(part, max(0, stop - 8), stop).group().lower() in _SHORTENED:
        stop = part.rfind(". ", 0, stop)
    cut = max(cut, stop)
    return part[cut + 1 :] if cut >= 0 else part


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def _name_votes(text: str, a: int, b: int, intro: bool, title: bool, answer: bool, given: frozenset[str]) -> tuple[int, ...]:
    tokens = re.findall(_TOKEN, text[a:b])
    capital = [t[0].isupper() for t in tokens]
    small = any(t.lower() in _SMALL for t in tokens)
    known = any(t.lower() in given for t in tokens)
    return (_vote(2 <= len(tokens) <= 3, len(tokens) == 0), _vote(intro or title), _vote(answer), _vote(known), _vote(all(capital), small), _vote(False, small and not known))


def _inside_name(text: str, a: int, b: int, before: bool) -> tuple[int, int] | None:
    """The words of a proposed name that can be one: up to three, of one case, without small words at the end."""
    words = [(a + m.start(), a + m.end(), m.group()) for m in re.finditer(_TOKEN, text[a:b])]
    if before:  # read back from the verb
        taken = []
        for w in reversed(words):
            if len(taken) == 3 or w[2].lower() in _SMALL or _TITLE.match(w[2]) or (taken and w[2][0].isupper() != taken[-1][2][0].isupper()):
                break
            taken.append(w)
        words = taken[::-1]
    else:
        kept = []
        for w in words:
            if w[2].lower() in _SMALL or w[2].lower() in ("contact", "tel") or (kept and w[2][0].isupper() != kept[0][2][0].isupper()):
                break
            kept.append(w)
        words = kept
    return (words[0][0], words[-1][1]) if words else None


def _address_end(text: str, at: int) -> int:
    """The end of an address whose street and number end, or whose street's name begins, at `at`."""
    if text[at - 1 : at].isalpha() and text[at : at + 1].isalpha() or text[at : at + 1] in ("'", "’"):
        if m := _STREET_REST.match(text, at):
            at = m.end()
    m = _CITY.match(text, at)
    return m.end() if m else at


def candidates(text: str, given: frozenset[str]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """Proposed spans (kind, start, end, votes) of a text; starts count from 0."""
    flags = flags_of(text)
    text = text.translate(_UNSEEN)
    out: dict[tuple[str, int], tuple[int, tuple[int, ...]]] = {}

    def add(kind: str, a: int, b: int, votes: tuple[int, ...]) -> None:
        if (kind, a) not in out or sum(votes) > sum(out[kind, a][1]):
            out[kind, a] = (b, votes)

    if flags & AT:
        for m in _EMAIL.finditer(text):
            v = m["v"]
            add("email", m.start("v"), m.end("v"), (1, 0, 0, 0, _vote("." in v or "dot" in v.lower()), 0))
    if flags & NUMBER:
        for m in _CODES.finditer(text):
            a, before = m.start("v"), _near(text, m.start("v"), 60)
            letters = any(c.isalpha() for c in m["v"])
            long = sum(c.isdigit() for c in m["v"]) >= 13
            add("id_number", a, m.end("v"), (_vote(letters or long), _vote(bool(_IDENTITY.search(before)), not _IDENTITY.search(before)), 0, 0, _vote(letters), _vote(False, bool(_DECOYS.search(before)))))
        for m in _DIGITS.finditer(text):
            a, b, v = m.start("v"), m.end("v"), m["v"]
            digits, before = sum(c.isdigit() for c in v), _near(text, a, 60)
            identity, call, decoy = bool(_IDENTITY.search(before)), bool(_CALLS.search(before) or _CALLS.search(text[b : b + 20])), bool(_DECOYS.search(_near(text, a, 30)))
            date = bool(re.match(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d\d-\d\d", v))
            dialled, national = v[0] in "+(0", bool(_NATIONAL.fullmatch("".join(filter(str.isdigit, v))))
            if 7 <= digits <= 15 and not identity:
                add("phone", a, b, (_vote(dialled and digits >= 9 or national, date), _vote(call), 0, 0, _vote(bool(re.search(r"\d[\s.()/-]\d", v)) or dialled, not (dialled or national)), _vote(False, decoy or date)))
            if 8 <= digits <= 15 and not date:
                add("id_number", a, b, (_vote(digits in (9, 11, 13, 15)), _vote(identity, not identity), 0, 0, _vote(False, v[0] in "+("), _vote(False, decoy or call and not identity)))
    if flags & STREET and any(map(str.isdigit, text)):
        for pattern in _ADDRESSES:
            for m in pattern.finditer(text):
                a, b = m.start("v"), _address_end(text, m.end("v"))
                after = bool(_POSTAL.search(text[m.end("v") : m.end("v") + 60]))
                add("address", a, b, (1, _vote(bool(_LIVING.search(_near(text, a, 60)))), _vote(after), 0, _vote(any(c.isupper() for c in m["v"])), _vote(False, bool(_DECOYS.search(_near(text, a, 20))))))
    for m in _INTRO.finditer(text) if flags & (INTRO | TITLE) else ():
        if span := _inside_name(text, m.start("name"), m.end("name"), False):
            add("name", *span, _name_votes(text, *span, not m["title"], bool(m["title"]), bool(_ANSWER.search(text[span[0] : span[1] + 30])), given))
    for m in _ANSWER.finditer(text) if flags & ANSWER else ():
        if span := _inside_name(text, m.start("name"), m.end("name"), True):
            title = bool(_TITLE.search(text[max(0, span[0] - 12) : span[0]].rstrip()))
            add("name", *span, _name_votes(text, *span, False, title, True, given))
    taken = sorted((a, b) for (_, a), (b, _) in out.items())
    for m in _CAPITALS.finditer(text):
        a, b = m.span()
        if not any(x < b and a < y for x, y in taken) and any(t.lower() in given for t in re.findall(_TOKEN, m.group())) and (span := _inside_name(text, a, b, False)):
            add("name", *span, _name_votes(text, *span, False, False, False, given))
    return [(kind, a, b, votes) for (kind, a), (b, votes) in sorted(out.items(), key=lambda x: x[0][1])]


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Likelihood that spans with a pattern of votes are personal data, by expectation-maximisation.

    Labelers vote independently given the truth; each has a rate of yes, no and abstention for either
    truth. Starts from: labelers are more often right than wrong.
    """
    if not counts:
        return {}
    patterns = np.array(list(counts))
    n = np.array(list(counts.values()), float)
    p = 1 / (1 + np.exp(-1.5 * patterns.sum(1) + 1.0))
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        yes, no = np.zeros(len(n)) + np.log(prior), np.zeros(len(n)) + np.log(1 - prior)
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                is_v = patterns[:, j] == v
                # A for-vote counts at least as much for as against, whatever the counts say.
                a, b = ((n * p * is_v).sum() + 1 + (v == 1)) / ((n * p).sum() + 4), ((n * (1 - p) * is_v).sum() + 1 + (v == -1)) / ((n * (1 - p)).sum() + 4)
                if v == 1:
                    a = max(a, b)
                elif v == -1:
                    b = max(a, b)
                yes[is_v] += np.log(a)
                no[is_v] += np.log(b)
        p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
    return {k: float(x) for k, x in zip(counts, p)}


def _vote_weights(counts: dict[tuple[int, ...], int], likelihood: dict[tuple[int, ...], float], rounds: int = 400) -> np.ndarray:
    """Of a logistic regression on votes and pairs of votes, trained on likelihoods."""
    x = np.array([_features(k) for k in counts])
    y, n = np.array([likelihood[k] for k in counts]), np.sqrt(np.array(list(counts.values()), float))
    w = np.zeros(x.shape[1])
    n /= n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (n * (p - y)) + 1e-4 * w)
    return w


def train_classifier(counts: dict[tuple[int, ...], int], likelihood: dict[tuple[int, ...], float], rounds: int = 400) -> dict[tuple[int, ...], float]:
    """The score of each pattern by votes and pairs of votes alone."""
    if not counts:
        return {}
    w = _vote_weights(counts, likelihood, rounds)
    return {k: float(1 / (1 + np.exp(-np.dot(_features(k), w)))) for k in counts}


def shape_and_neighbours(text: str, a: int, b: int) -> list[int]:
    """Buckets of the span's shape and length, and of two words on either side."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", text[a:b][:80])))
    before, after = re.findall(r"\w+|[^\w\s]", text[max(0, a - 40) : a].lower())[-2:], re.findall(r"\w+|[^\w\s]", text[b : b + 40].lower())[:2]
    keys = [f"s{shape}", f"n{min(40, (b - a) // 3)}", *(f"b{k}{w}" for k, w in enumerate(reversed(before))), *(f"a{k}{w}" for k, w in enumerate(after))]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) >> (32 - BUCKETS_LOG2) for k in keys]


@dataclass
class SpanClassifier:
    """Scores of one kind's spans: votes, their pairs, and what stands in and next to the span."""

    votes: np.ndarray
    context: np.ndarray

    def score(self, votes: list[tuple[int, ...]], near: list[list[int]]) -> np.ndarray:
        x = np.array([_features(v) for v in votes]) @ self.votes + np.array([self.context[f].sum() for f in near])
        return 1 / (1 + np.exp(-x))


def train_spans(counts: dict[tuple[int, ...], int], likelihood: dict[tuple[int, ...], float], sample: list[tuple[tuple[int, ...], list[int]]], epochs: int = 4, rate: float = 0.2) -> SpanClassifier:
    """Starts from the votes' weights; a sample of spans (votes, buckets) then teaches what contexts add, in shrunken steps per weight."""
    w, c = _vote_weights(counts, likelihood), np.zeros(1 << BUCKETS_LOG2)
    seen = np.ones(1 << BUCKETS_LOG2)
    x, y = np.array([_features(v) for v, _ in sample]).reshape(len(sample), -1), np.array([likelihood[v] for v, _ in sample])
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(sample)):
            f = sample[i][1]
            g = 1 / (1 + np.exp(-(x[i] @ w + c[f].sum()))) - y[i]
            seen[f] += g * g
            c[f] -= rate * (g / np.sqrt(seen[f]) + 1e-3 * c[f])
    return SpanClassifier(w, c)


def _features(votes: tuple[int, ...]) -> list[float]:
    v = list(votes)
    return [1.0, *v, *(float(a > 0 and b > 0) for i, a in enumerate(v) for b in v[i + 1 :]), float(min(v) < 0)]


class _Asked(frozenset):
    """A gazetteer that knows no name and keeps those that it is asked for."""

    def __new__(cls) -> _Asked:
        self = super().__new__(cls)
        self.names = set()
        return self

    def __contains__(self, name: object) -> bool:
        self.names.add(name)
        return False


def harvest_names(df: DataFrame, text_col: str) -> DataFrame:
    """Rows (name): all given names that GAZETTEER_TEXTS texts introduce, counted over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                if not flags_of(text) & INTRO:
                    continue
                text = text.translate(_UNSEEN)
                for m in _INTRO_ONLY.finditer(text):
                    if span := _inside_name(text, m.start("name"), m.end("name"), False):
                        found += {t.lower() for t in re.findall(_TOKEN, text[span[0] : span[1]]) if len(t) > 2}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["name"])

    src = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    counts = src.mapInArrow(run, "name string").groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= GAZETTEER_TEXTS)
    return materialise(counts.select("name"), "given-names")


def _known_names(src: DataFrame, names: DataFrame) -> DataFrame:
    """src (id, text) with the names of each text's proposals that the gazetteer holds (null: none), by a shuffle of both."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                asked = _Asked()
                candidates(text, asked)
                at += [i] * len(asked.names)
                found += asked.names
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["h", "name"])

    # Texts of one hash may share their lists: a list holds nothing but names of the gazetteer.
    keyed = src.withColumn("h", F.xxhash64("text"))
    known = keyed.select("h", "text").mapInArrow(ask, "h long, name string").distinct().join(names, "name").groupBy("h").agg(F.collect_set("name").alias("known"))
    return keyed.join(known, "h", "left").select("id", "text", "known")


def find_personal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id_col, kind, start, end, score): personal data in each text; start counts from 0, end is exclusive.

    Overlapping finds keep the first of id_number, email, phone, address, name. Null and empty texts have
    none; rows without an id are left out; rows repeated under one id give the same finds once; an empty
    table gives no rows. Texts are searched whole.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    names = harvest_names(df, text_col)
    small = names.count() <= GAZETTEER_SIZE
    given = spark.sparkContext.broadcast(frozenset(r.name for r in names.collect()) if small else frozenset())
    src = src.withColumn("known", F.lit(None).cast("array<string>")) if small else _known_names(src, names)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            at, kinds, starts, ends, votes, near = [], [], [], [], [], []
            for i, (text, known) in enumerate(zip(batch.column("text").to_pylist(), batch.column("known").to_pylist())):
                for k, a, b, v in candidates(text, frozenset(known) if known else given.value):
                    at.append(i)
                    kinds.append(k)
                    starts.append(a)
                    ends.append(b)
                    votes.append(list(v))
                    near.append(shape_and_neighbours(text, a, b))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(votes, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.int32()))], ["id", "kind", "start", "end", "votes", "near"]
            )

    spans = materialise(src.mapInArrow(propose, f"id {kind}, kind string, start int, end int, votes array<int>, near array<int>"), "personal-spans")
    # Three votes of six labelers on five kinds: at most 3,645 patterns, whatever the corpus.
    counted = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    by_kind = {k: {tuple(r.votes): r.n for r in counted if r.kind == k} for k in KINDS}
    # The same spans in every run: those whose hash falls below a bound that their kind's number sets.
    space, part = 1 << 40, F.lit(0)
    for k, counts in by_kind.items():
        part = F.when(F.col("kind") == k, min(1 << 40, (1 << 40) * TRAIN_SPANS // max(1, sum(counts.values())))).otherwise(part)
    drawn = spans.where(F.pmod(F.xxhash64("id", "kind", "start"), F.lit(space)) < part).select("kind", "votes", "near").limit(2 * len(KINDS) * TRAIN_SPANS).collect()
    drawn = sorted((r.kind, tuple(r.votes), r.near) for r in drawn)
    trained = {k: train_spans(counts, reliabilities(counts), [(v, near) for kind_, v, near in drawn if kind_ == k]) for k, counts in by_kind.items() if counts}
    deciders = spark.sparkContext.broadcast(trained)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, votes, near = (batch.column(c).to_pylist() for c in ("kind", "votes", "near"))
            score = np.zeros(batch.num_rows)
            for k, decider in deciders.value.items():
                if at := [i for i, x in enumerate(kinds) if x == k]:
                    score[at] = decider.score([tuple(votes[i]) for i in at], [near[i] for i in at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "kind", "start", "end")), pa.array(score)], ["id", "kind", "start", "end", "score"])

    accepted = spans.mapInArrow(decide, f"id {kind}, kind string, start int, end int, score double").where("score >= 0.5")
    found = F.collect_set(F.struct(F.array_position(F.array(*[F.lit(k) for k in ("id_number", "email", "phone", "address", "name")]), F.col("kind")).alias("rank"), "start", "end", "kind", "score"))
    kept = F.aggregate(  # of one text
        F.sort_array(found),
        F.array().cast("array<struct<rank:bigint,start:int,end:int,kind:string,score:double>>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return accepted.groupBy("id").agg(kept.alias("x")).select(F.col("id").alias(id_col), F.explode("x").alias("x")).select(id_col, "x.kind", "x.start", "x.end", "x.score")


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id_col, redacted, n) of the texts with personal data: placeholders in its place, all else as it was."""
    found = find_personal(df, id_col, text_col).groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    texts = df.select(id_col, F.col(text_col).alias("_text")).dropDuplicates([id_col])
    marks = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substring("_text", s["at"] + 1, x["start"] - s["at"]), marks[x["kind"]]).alias("out"), x["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring("_text", s["at"] + 1, F.length("_text"))),
    )
    return found.join(texts, id_col).select(id_col, step.alias("redacted"), F.size("spans").alias("n"))
