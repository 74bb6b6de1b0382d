"""Deterministic matching of keywords, negative keywords, negations and regular expressions."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import cached_property, lru_cache
from re import _parser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import NEGATION_PATTERNS, SETTINGS


def quoted(text: Column) -> Column:
    """A regular expression for exactly this text."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def negation_regex(keyword: Column, patterns: Column, window: int = SETTINGS.negation_window_chars) -> Column:
    """Matches where a pattern ends within `window` characters before the keyword; null without usable patterns."""
    usable = F.filter(patterns, lambda p: (F.length(p) > 0) & (F.length(p) <= window))
    alternatives = F.transform(usable, lambda p: F.concat(quoted(p), F.lit(".{0,"), (F.lit(window) - F.length(p)).cast("string"), F.lit("}")))
    return F.when(F.size(usable) > 0, F.concat(F.lit("(?s)(?:"), F.array_join(alternatives, "|"), F.lit(")"), quoted(keyword)))


def compiled_keywords(keywords: Column, patterns: Column) -> Column:
    """Keywords with their lower-case form, negation regex and negations; empty ones are left out, repeated ones merged."""
    terms = F.array_distinct(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.length(k) > 0))
    return F.transform(terms, lambda k: F.struct(k.alias("term"), F.lower(k).alias("low"), negation_regex(F.lower(k), patterns).alias("negated"), patterns.alias("negations")))


def compiled_regexes(patterns: Column) -> Column:
    """Valid patterns with the label that a match gets; \\w and \\b mean Unicode letters."""
    return F.transform(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.struct(F.concat(F.lit("[regex:"), F.substring(p, 1, 20), F.lit("]")).alias("label"), F.concat(F.lit("(?U)"), p).alias("pattern"), p.alias("source")))


def valid_patterns(spark: SparkSession, topics: DataFrame, column: str) -> DataFrame:
    """Topics with only those regular expressions that compile. Their distinct texts, settings that people write, are tried on the driver."""
    bad = []
    for row in topics.select(F.explode(column).alias("p")).where("p is not null").distinct().collect():
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile("(?U)" + row.p)
        except Exception:
            bad.append(row.p)
    kept = F.filter(column, lambda p: p.isNotNull() & ~p.isin(bad)) if bad else F.filter(column, lambda p: p.isNotNull())
    return topics.withColumn(column, kept)


def matched_terms(low: Column, keywords: Column, negatives: Column, regexes: Column | None = None, negation: bool = True) -> Column:
    """Distinct terms that a lower-case text matches, sorted; none where a negative keyword stands.

    keywords and regexes: from compiled_keywords and compiled_regexes; negatives: array of strings.
    """
    excluded = F.exists(F.coalesce(negatives, F.array().cast("array<string>")), lambda n: (F.length(n) > 0) & F.contains(low, F.lower(n)))

    def matches(k: Column) -> Column:
        found = F.contains(low, k["low"])
        return F.when(found & k["negated"].isNotNull(), ~F.rlike(low, k["negated"])).otherwise(found) if negation else found

    terms = F.transform(F.filter(keywords, matches), lambda k: k["term"])
    if regexes is not None:
        terms = F.concat(terms, F.transform(F.filter(regexes, lambda r: F.rlike(low, r["pattern"])), lambda r: r["label"]))
    return F.when((F.length(low) == 0) | excluded, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(terms)))


class Matcher:
    """The rules of some projects' topics for whole texts: one automaton finds all their keywords and negative
    keywords in a single pass; negations and regular expressions are compiled once and tried only where they can matter."""

    def __init__(self, topics: list[tuple], negation: bool = True, regexes: bool = True, window: int = SETTINGS.negation_window_chars):
        """topics: (project, topic, [(term, lower-case term, negations)], [negative keywords, lower case], [(label, regular expression)])."""
        import ahocorasick

        words: dict[str, int] = {}
        self.uses: dict[str, dict[int, list]] = {}  # project → word → (topic, its term, its negation)
        self.bars: dict[str, dict[int, set]] = {}  # project → word → topics that it excludes
        self.patterns: dict[str, dict[re.Pattern, list]] = {}
        self.names: list = []
        for project, topic, terms, nots, patterns in topics:
            k = len(self.names)
            self.names.append(topic)
            uses, bars = self.uses.setdefault(project, {}), self.bars.setdefault(project, {})
            for term, low, negations in terms or ():
                if low:
                    uses.setdefault(words.setdefault(low, len(words)), []).append((k, term, _negated(low, tuple(negations or ()), window) if negation else None))
            for low in nots or ():
                if low:
                    bars.setdefault(words.setdefault(low, len(words)), set()).add(k)
            for label, source in (patterns or ()) if regexes else ():
                if (compiled := _compiled(source)) is not None:
                    self.patterns.setdefault(project, {}).setdefault(compiled, []).append((k, label))
        self.finder = ahocorasick.Automaton()
        for w, i in words.items():
            self.finder.add_word(w, i)
        if words:
            self.finder.make_automaton()

    def match(self, project: str, low: str) -> list[tuple[object, list[str]]]:
        """(topic, sorted distinct terms) of the project's topics that a lower-case text matches."""
        if (uses := self.uses.get(project)) is None:
            return []
        found: dict[int, set] = {}
        hits = {i for _, i in self.finder.iter(low)} if len(self.finder) else ()
        negated: dict[re.Pattern, bool] = {}
        for i in hits:
            for k, term, no in uses.get(i, ()):
                if no is not None and no not in negated:
                    negated[no] = no.search(low) is not None
                if no is None or not negated[no]:
                    found.setdefault(k, set()).add(term)
        for pattern, owners in self.patterns.get(project, {}).items():
            if pattern.search(low):
                for k, label in owners:
                    found.setdefault(k, set()).add(label)
        if found:
            bars = self.bars[project]
            for i in hits:
                for k in bars.get(i, ()):
                    found.pop(k, None)
        return [(self.names[k], sorted(terms)) for k, terms in found.items()]


#: Stands for NEGATION_PATTERNS where a keyword's negations are given as text.
DEFAULT_NEGATIONS = "*"


class Vocabulary:
    """Distinct keywords with their negations, negative keywords and regular expressions of many topics. A text's
    signature says which of them it holds; all that its topics and terms are depends on this alone."""

    def __init__(self, entries: Iterable[tuple], window: int = SETTINGS.negation_window_chars):
        """entries: ("k", lower-case keyword, negations as JSON, DEFAULT_NEGATIONS or ""), ("n", lower-case negative keyword, "") or ("p", regular expression, "")."""
        import ahocorasick

        self.ids: dict[tuple, int] = {}
        self.patterns: list[tuple[int, str, re.Pattern]] = []  # (entry, what stands in all that it matches, pattern)
        words: dict[str, int] = {}
        self.keys: list[list] = []  # word → (entry, its negation, the words of which one must be there for it)
        self.nots: list[int] = []  # word → entry, or -1

        def word(low: str) -> int:
            if (w := words.setdefault(low, len(words))) == len(self.keys):
                self.keys.append([])
                self.nots.append(-1)
            return w

        for entry in entries:
            if entry in self.ids or not entry[1]:
                continue
            kind, low, negations = entry
            if kind == "p":
                if (compiled := _compiled(low)) is not None:
                    self.patterns.append((self.ids.setdefault(entry, len(self.ids)), _literal(compiled), compiled))
                continue
            k, w = self.ids.setdefault(entry, len(self.ids)), word(low)
            if kind == "n":
                self.nots[w] = k
            else:
                no = NEGATION_PATTERNS if negations == DEFAULT_NEGATIONS else tuple(json.loads(negations) or ()) if negations else ()
                self.keys[w].append((k, _negated(low, no, window), frozenset(word(n) for n in no if n and len(n) <= window)))
        self.finder = ahocorasick.Automaton()
        for low, w in words.items():
            self.finder.add_word(low, w)
        if words:
            self.finder.make_automaton()

    def signature(self, low: str) -> bytes:
        """The sorted entries that a lower-case text holds, four bytes each."""
        hits = {w for _, w in self.finder.iter(low)} if len(self.finder) else ()
        held = [k for k, literal, pattern in self.patterns if literal in low and pattern.search(low)]
        for w in hits:
            if (k := self.nots[w]) >= 0:
                held.append(k)
            for k, no, needs in self.keys[w]:
                if no is None or needs.isdisjoint(hits) or not no.search(low):
                    held.append(k)
        return array("i", sorted(held)).tobytes() if held else b""


class ProjectRules:
    """The topics of one project: what signatures match, by sets of bits."""

    #: Signatures whose bits are held at once, and up to which they are set one by one: arrays cost more for so few.
    block, few = 65_536, 64

    def __init__(self, topics: list[tuple], ids: dict[tuple, int]):
        """topics: (topic, {words: [[term, keyword, negations]], nots, patterns: [[label, regular expression]]}); ids: of a Vocabulary.

        A topic that is listed several times matches as one, by each of its rules.
        """
        names: dict = {}
        self.first: dict = {}  # topic → its first rule
        self.listed: list[tuple] = []  # (topic's position in names, [(entry, term)], entries that exclude it)
        for name, rule in topics:
            t = names.setdefault(name, len(names))
            used = [(ids[e], term) for e, term in [*((("k", low, no or ""), term) for term, low, no in rule.get("words") or ()), *((("p", source, ""), label) for label, source in rule.get("patterns") or ())] if e in ids]
            self.listed.append((t, used, tuple(sorted({ids[e] for low in rule.get("nots") or () if (e := ("n", low, "")) in ids}))))
            self.first.setdefault(name, rule)
        self.names = list(names)

    @cached_property
    def _masks(self) -> tuple[dict[int, int], dict[int, int]]:
        """Entry → the rules (bits, by position in listed) that it meets, and those that it excludes."""
        uses, bars = {}, {}
        for k, (_, used, nots) in enumerate(self.listed):
            for e in {e for e, _ in used}:
                uses.setdefault(e, []).append(k)
            for e in nots:
                bars.setdefault(e, []).append(k)
        return {e: _bits(k) for e, k in uses.items()}, {e: _bits(k) for e, k in bars.items()}

    def met(self, signature: bytes) -> int:
        """The rules (bits, by position in listed) that a text of this signature matches."""
        uses, bars = self._masks
        found = barred = 0
        for e in memoryview(signature).cast("i"):
            if e in uses:
                found |= uses[e]
            if e in bars:
                barred |= bars[e]
        return found & ~barred

    def topics(self, met: int) -> np.ndarray:
        """Positions in names of the topics of these rules, sorted, each once."""
        at = _positions(met)
        return at if len(self.names) == len(self.listed) else np.unique(np.array([t for t, _, _ in self.listed], np.int64)[at])

    def terms(self, met: int, signature: bytes) -> list[tuple[object, list[str]]]:
        """(topic, sorted distinct terms) of the rules that a text of this signature matches."""
        held, found = set(memoryview(signature).cast("i")), {}
        for k in _positions(met).tolist() if met else ():
            t, used, _ = self.listed[k]
            found.setdefault(t, set()).update(term for e, term in used if e in held)
        return [(self.names[t], sorted(terms)) for t, terms in found.items()]

    @cached_property
    def _kinds(self) -> tuple[list[tuple], dict[tuple, tuple]]:
        """Of each topic, and of each (topic, term): what meets it, ((entries), (entries that exclude it)) of each of its rules."""
        topics, pairs = [{} for _ in self.names], {}
        for t, used, nots in self.listed:
            terms: dict[str, set] = {}
            for e, term in used:
                terms.setdefault(term, set()).add(e)
            for term, entries in terms.items():
                pairs.setdefault((t, term), {})[tuple(sorted(entries)), nots] = None
            if used:
                topics[t][tuple(sorted({e for e, _ in used})), nots] = None
        return [tuple(sorted(x)) for x in topics], {pair: tuple(sorted(x)) for pair, x in pairs.items()}

    def counted(self, signatures: list[bytes], n: list[int] | None, sums: dict[tuple, int]) -> None:
        """Adds to `sums`, by kind of topic or term, the texts that match; n: texts of each signature, 1 without.

        Entries become sets of signatures, so that kinds are evaluated once for all of them.
        """
        topics, pairs = self._kinds
        kinds = {*topics, *pairs.values()} - {()}
        if not kinds:
            return
        for at in range(0, len(signatures), self.block):
            some = signatures[at : at + self.block]
            held, planes = (_few_bits if len(some) <= self.few else _many_bits)(some, None if n is None else n[at : at + self.block], kinds)
            for kind in kinds:
                if m := _met(kind, held):
                    sums[kind] = sums.get(kind, 0) + sum((m & plane).bit_count() << b for b, plane in planes)

    def totals(self, sums: dict[tuple, int]) -> list[tuple]:
        """(topic, None, texts) of each topic and (topic, term, texts) of each of its terms that was met."""
        topics, pairs = self._kinds
        return [*((self.names[t], None, sums[kind]) for t, kind in enumerate(topics) if kind in sums), *((self.names[t], term, sums[kind]) for (t, term), kind in pairs.items() if kind in sums)]


def _many_bits(signatures: list[bytes], n: list[int] | None, kinds: set[tuple]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """_few_bits by arrays, of the entries of these kinds."""
    wanted = {e for kind in kinds for part in kind for es in part for e in es}
    texts = np.ones(len(signatures), np.int64) if n is None else np.array(n, np.int64)
    order = np.argsort(-texts, kind="stable")  # the high bits of n are then in few, low places
    place = np.empty(len(signatures), np.int64)
    place[order] = np.arange(len(signatures))
    entries = np.frombuffer(b"".join(signatures), np.int32)
    rows = np.repeat(place, np.array([len(x) for x in signatures]) // 4)
    by = np.argsort(entries, kind="stable")
    found, starts = np.unique(entries[by], return_index=True)
    ends = [*starts[1:].tolist(), len(by)]
    held = {e: _bits(rows[by[a:b]]) for e, a, b in zip(found.tolist(), starts.tolist(), ends) if e in wanted}
    return held, [(b, _bits(x)) for b in range(int(texts.max()).bit_length()) if len(x := np.flatnonzero(texts[order] >> b & 1))]


def _few_bits(signatures: list[bytes], n: list[int] | None, kinds: set[tuple]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Entry → the signatures (bits) that hold it; (b, the signatures whose n has bit b) of each bit."""
    held: dict[int, int] = {}
    planes: dict[int, int] = {}
    for i, signature in enumerate(signatures):
        one = 1 << i
        for e in memoryview(signature).cast("i"):
            held[e] = held.get(e, 0) | one
        texts, b = 1 if n is None else n[i], 0
        while texts:
            if texts & 1:
                planes[b] = planes.get(b, 0) | one
            texts, b = texts >> 1, b + 1
    return held, list(planes.items())


def _met(kind: tuple, held: dict[int, int]) -> int:
    """The signatures (bits) that meet a kind of topic or term; held: those of each entry."""
    out = 0
    for entries, nots in kind:
        m = 0
        for e in entries:
            m |= held.get(e, 0)
        for e in nots if m else ():
            m &= ~held.get(e, 0)
        out |= m
    return out


def _bits(positions: list[int] | np.ndarray) -> int:
    """A number with these bits set."""
    if len(positions) < 3:
        return sum(1 << k for k in set(map(int, positions)))
    flags = np.zeros(int(np.max(positions)) + 1, bool)
    flags[positions] = True
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _positions(bits: int) -> np.ndarray:
    """Those of the bits that are set, sorted."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


@lru_cache(100_000)
def _negated(low: str, negations: tuple[str, ...], window: int) -> re.Pattern | None:
    """Matches where a negation ends within `window` characters before the keyword; None without usable negations."""
    usable = [n for n in negations if n and len(n) <= window]
    return re.compile("(?:" + "|".join(f"{re.escape(n)}.{{0,{window - len(n)}}}" for n in usable) + ")" + re.escape(low), re.S) if usable else None


@lru_cache(100_000)
def _compiled(source: str | None) -> re.Pattern | None:
    """A rule's regular expression; None for one that is null or does not compile."""
    try:
        return None if source is None else re.compile(source)
    except re.error:
        return None


def _literal(pattern: re.Pattern) -> str:
    """The longest run of characters that stand in every text that the pattern matches; empty where none is plain to see."""
    runs = [[]]
    if not pattern.flags & re.IGNORECASE:
        for op, value in _parser.parse(pattern.pattern, pattern.flags):
            if op is _parser.LITERAL:
                runs[-1].append(chr(value))
            else:
                runs.append([])
    return "".join(max(runs, key=len))


def default_negations() -> Column:
    return F.array(*[F.lit(p) for p in NEGATION_PATTERNS])


def highlight(text: Column, keywords: Column, first: int = 5) -> Column:
    """Marks the first keywords in turn with **, without regard to case."""
    return F.aggregate(F.slice(keywords, 1, first), text, lambda t, k: F.regexp_replace(t, F.concat(F.lit("(?iu)"), quoted(k)), F.lit(r"**$0**")))
