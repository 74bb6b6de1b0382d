"""Counting of topics and dictionary entities in verbatims."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.matching import DEFAULT_NEGATIONS, Matcher, ProjectRules, Vocabulary, compiled_keywords, compiled_regexes, default_negations

#: Most distinct entries of rules, or rows of the dictionary, that are broadcast at once; more of rules are sought project by project, more of the dictionary take more passes.
BROADCAST_RULES = 50_000
#: Most regular expressions that every text is tried with, whatever its project.
BROADCAST_PATTERNS = 20
#: Most projects with rules whose names are broadcast, so that texts of other projects are left out where they are read.
BROADCAST_PROJECTS = 200_000
#: Rules of a project up to which what a set of them gives is kept.
FEW_RULES = 64
#: A project with more than 1/HOT_SHARE of all verbatims is divided.
HOT_SHARE, LEAST_HOT = 200, 1_000


def topic_rules(run_topics: DataFrame, runs: DataFrame, active_only: bool = True) -> DataFrame:
    """One row per topic with its project and compiled rules. Topics of unknown runs have no verbatims and are left out."""
    topics = run_topics.where("is_active") if active_only else run_topics
    r = runs.select(F.col("id").alias("run_id"), "project_id")
    terms = F.array_distinct(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.length(k) > 0))
    return topics.join(r, "run_id").select(
        "topic_id", "run_id", "project_id", "topic_ord", "canonical_label", "canonical_subtopic", "keywords",
        F.transform(terms, lambda k: F.array(k, F.lower(k), F.lit(DEFAULT_NEGATIONS))).alias("words"),
        compiled_keywords(F.col("keywords"), default_negations()).alias("rules"), F.col("negative_keywords").alias("negatives"), compiled_regexes(F.col("regex_patterns")).alias("regexes"), "regex_patterns",
    )


def _known(rules: DataFrame) -> DataFrame:
    """Rules of a project."""
    return rules.where(F.col("project_id").isNotNull())


def _plain(rules: DataFrame) -> bool:
    """Whether rules have their texts as they were given, of topic_rules."""
    return {"words", "regex_patterns"} <= {*rules.columns}


def _flat(rules: DataFrame, negation: bool = True, regexes: bool = True, *more: str, shared: Broadcast | None = None) -> DataFrame:
    """Rules as (project_id, topic_id, rule with the columns `more`): texts as they were given where `shared` knows
    their lower-case forms, else JSON, with the entries of its Vocabulary."""
    if shared is not None and _plain(rules):
        patterns = F.col("regex_patterns") if regexes else F.array().cast("array<string>")
        return rules.select("project_id", "topic_id", F.struct(F.col("keywords").alias("words"), F.col("negatives").alias("nots"), patterns.alias("patterns"), *more).alias("rule"))
    none, nones = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    # Compiled rules repeat their negations with each keyword: `words`, where they are there, cost less.
    if "words" in rules.columns:
        words = F.col("words") if negation else F.transform("words", lambda k: F.array(k[0], k[1], F.lit("")))
    else:
        words = F.transform("rules", lambda k: F.array(k["term"], k["low"], F.to_json(k["negations"]) if negation else F.lit("")))
    nots = F.transform(F.filter(F.coalesce("negatives", none), lambda n: F.length(n) > 0), lambda n: F.lower(n))
    patterns = F.transform("regexes", lambda r: F.array(r["label"], r["source"])) if regexes else nones
    flat = rules.select("project_id", "topic_id", F.coalesce(words, nones).alias("words"), nots.alias("nots"), F.filter(F.coalesce(patterns, nones), lambda r: r[1].isNotNull()).alias("patterns"), *more)
    of = lambda kind, c, a, b: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), a(x).alias("low"), b(x).alias("negations")))
    blank = lambda x: F.lit("")
    entries = F.concat(of("k", "words", lambda x: x[1], lambda x: F.coalesce(x[2], F.lit(""))), of("n", "nots", lambda x: x, blank), of("p", "patterns", lambda x: x[1], blank))
    return flat.select("project_id", "topic_id", F.to_json(F.struct("words", "nots", "patterns", *more)).alias("rule"), entries.alias("entries"))


def _at_once(spark: SparkSession, *jobs: Callable) -> list:
    """What jobs give that don't need each other, started together: one alone leaves cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _vocabulary(rules: DataFrame, negation: bool = True, regexes: bool = True) -> Broadcast | None:
    """The distinct entries of all rules; None where they are more than BROADCAST_RULES or BROADCAST_PATTERNS.

    With it, the lower-case form of each text of rules of topic_rules, and what stands for their negations.
    """
    if _plain(rules):
        met = _distinct_texts(rules, regexes).limit(BROADCAST_RULES + 1).collect()
        lows, no = {r.text: r.low for r in met if r.kind != "p"}, DEFAULT_NEGATIONS if negation else ""
        entries = {(r.kind, r.text if r.kind == "p" else r.low, no if r.kind == "k" else "") for r in met}
    else:
        met = _flat(_known(rules), negation, regexes).select(F.explode("entries").alias("e")).select("e.*").distinct().limit(BROADCAST_RULES + 1).collect()
        lows, no, entries = {}, "", map(tuple, met)
    if len(met) > BROADCAST_RULES or sum(r.kind == "p" for r in met) > BROADCAST_PATTERNS:
        return None
    return rules.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(entries), lows, no))


def _distinct_texts(rules: DataFrame, regexes: bool) -> DataFrame:
    """Distinct (kind of entry, text, lower-case text) of rules of topic_rules: found in Arrow, so that no row is made of each."""
    kinds, most = {"keywords": "k", "negatives": "n"} | ({"regex_patterns": "p"} if regexes else {}), BROADCAST_RULES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            if len(seen) > most:
                continue  # too many to be broadcast, whatever else there is
            met = {(kind, x) for c, kind in kinds.items() for x in pc.unique(pc.list_flatten(batch.column(c))).to_pylist() if x or (kind == "p" and x is not None)} - seen
            seen |= met
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in met], pa.string()), pa.array([x for _, x in met], pa.string())], ["kind", "text"])

    return _known(rules).select(*kinds).mapInArrow(run, "kind string, text string").distinct().select("kind", "text", F.lower("text").alias("low"))


def _texts(lists: pa.Array) -> list[list]:
    """Lists of strings, each distinct one made once; a null list is empty."""
    codes = pc.list_flatten(lists).dictionary_encode("encode")
    texts = np.array([*codes.dictionary.to_pylist(), None], object)[codes.indices.to_numpy(False)].tolist()
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(False)).tolist()
    return [texts[a:b] for a, b in zip([0, *ends], ends)]


def _read(rules: pa.Array, shared: Broadcast | None) -> list[dict]:
    """Rules of _flat as ProjectRules takes them."""
    if not pa.types.is_struct(rules.type):
        return list(map(json.loads, rules.to_pylist()))
    _, _, lows, no = shared.value
    names = [rules.type.field(k).name for k in range(rules.type.num_fields)]
    columns = {name: _texts(c) if name in ("words", "nots", "patterns") else c.to_pylist() for name, c in zip(names, rules.flatten())}
    words = {k: (k, low, no) for k, low in lows.items()}
    columns["words"] = [[words[k] for k in dict.fromkeys(x) if k] for x in columns["words"]]
    columns["nots"] = [[lows[k] for k in x if k] for x in columns["nots"]]
    columns["patterns"] = [[(f"[regex:{p[:20]}]", p) for p in x if p is not None] for x in columns["patterns"]]
    return [dict(zip(names, row)) for row in zip(*[columns[c] for c in names])]


_held: dict[str, Vocabulary] = {}


def _opened(shared: Broadcast) -> Vocabulary:
    """The vocabulary of a broadcast, kept by the worker as long as its tasks use the same."""
    name, entries, *_ = shared.value
    if name not in _held:
        _held.clear()
        _held[name] = Vocabulary(entries)
    return _held[name]


def _signed(rows: DataFrame, shared: Broadcast | None, keep_all: bool, named: Broadcast | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the signature of the text `low` in its place; with keep_all, those that hold nothing of the vocabulary too.

    Without `shared`, texts stay. With `named`, the dictionary, a column for each type has the labels that the text contains.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signature = None if shared is None else _opened(shared).signature
        labels = None if named is None else _labeler(named.value, types)
        for batch in batches:
            lows, more = batch.column("low").to_pylist(), []
            if labels is not None:
                more = labels(lows)
            low = batch.column("low") if signature is None else pa.array([b"" if x is None else signature(x) for x in lows], pa.binary())
            out = pa.RecordBatch.from_arrays([*[low if c == "low" else batch.column(c) for c in names], *more], [*names, *(f"entity_{t}" for t in types)])
            yield out if keep_all else out.filter(pc.greater(pc.binary_length(low), 0))

    low = [StructField("low", BinaryType()) if f.name == "low" and shared is not None else f for f in rows.schema]
    return rows.mapInArrow(run, StructType([*low, *(StructField(f"entity_{t}", StringType()) for t in types)]))


def _labeler(entries: list[tuple], types: tuple[str, ...]) -> Callable[[list], list[pa.Array]]:
    """Of texts: for each type, the sorted labels that each contains, joined by ` | `. entries: (type, label, lower-case keywords)."""
    import ahocorasick

    owners: dict[str, list[int]] = {}
    for k, (_, label, words) in enumerate(entries):
        for w in words if label is not None else ():
            owners.setdefault(w, []).append(k)
    finder = ahocorasick.Automaton()
    for w in owners:
        finder.add_word(w, w)
    if owners:
        finder.make_automaton()
    known: dict[frozenset, int] = {}  # words of a text → position in made
    made: list[tuple[str, ...]] = []

    def position(low: str | None) -> int:
        found = frozenset([w for _, w in finder.iter(low)]) if low and owners else frozenset()
        if (at := known.get(found)) is None:
            own = sorted((entries[k][1], entries[k][0]) for k in {k for w in found for k in owners[w]})
            at = known[found] = len(made)
            made.append(tuple(" | ".join(label for label, t in own if t == wanted) for wanted in types))
        return at

    def labels(lows: list) -> list[pa.Array]:
        if len(made) > 10_000:
            known.clear()
            made.clear()
        at = pa.array([position(low) for low in lows], pa.int64())
        return [pa.array([row[c] for row in made], pa.string()).take(at) for c in range(len(types))]

    return labels


def _ruled(flat: DataFrame) -> DataFrame | None:
    """The projects with rules; None where they are more than BROADCAST_PROJECTS."""
    projects = flat.select("project_id").distinct().limit(BROADCAST_PROJECTS + 1).toArrow()
    return F.broadcast(flat.sparkSession.createDataFrame(projects, flat.select("project_id").schema)) if projects.num_rows <= BROADCAST_PROJECTS else None


class _Sink:
    """What becomes of the texts of each project: made of one partition's rows, project after project."""

    #: Rows, or characters, that are held before they leave.
    most = 200_000

    #: Whether a row that is there twice counts once; whether projects without rows are opened and closed, too.
    distinct = every = False
    kind: pa.DataType | None = None  # of topic_id
    rule: pa.DataType | None = None  # of the rules

    def __init__(self, columns: list[str]):
        self.columns, self.size, self.rows = columns, 0, []

    def opened(self, rules: ProjectRules) -> None: ...

    def take(self, batch: pa.RecordBatch, at: int, signatures: list[bytes], rules: ProjectRules) -> Iterator[pa.RecordBatch]:
        """Rows of the project, from position `at` of the batch on."""
        last = before = met = None
        ords = batch.column("ord").slice(at, len(signatures)).to_pylist() if self.distinct else None
        for i, signature in enumerate(signatures):
            again = signature == last
            if again and ords and ords[i] == before:
                continue
            if not again:
                last, met = signature, rules.met(signature)
            before = ords[i] if ords else None
            self.add(at + i, rules, met, signature, again)
            if self.size > self.most and (done := self.flush(batch)) is not None:
                yield done

    def add(self, i: int, rules: ProjectRules, met: int, signature: bytes, again: bool) -> None: ...

    def closed(self, rules: ProjectRules) -> pa.RecordBatch | None: ...

    def flush(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """What the batch's rows so far have given."""

    def ended(self) -> pa.RecordBatch | None: ...


def _swept(rows: DataFrame, flat: DataFrame, shared: Broadcast | None, sink: Callable[[], _Sink], schema: str | StructType, spread_hot: dict[str, int], order: tuple[str, ...] = ()) -> DataFrame:
    """Every project's rules, then its rows, in one sorted stream: a project's rules are read once for all of its rows.

    rows: project_id, low (signature, or text without `shared`), `n` where a row stands for several texts, other columns.
    The rows of the projects in spread_hot go to as many parts, each with the rules.
    """
    if spread_hot:
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in spread_hot.items() for x in kv])[F.col("project_id")], F.lit(1))
        # What a signature gives is made once in each part that has it: its rows go to few, those that hold nothing to all.
        few = F.xxhash64("low", F.pmod(F.xxhash64("ord"), F.floor(F.sqrt(parts)).cast("int")))
        rows = rows.withColumn("_part", F.pmod(F.when(F.length("low") > 0, few).otherwise(F.xxhash64("ord")), parts).cast("int"))
        flat = flat.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        rows, flat = rows.withColumn("_part", F.lit(0)), flat.withColumn("_part", F.lit(0))
    columns = [c for c in rows.columns if c not in ("project_id", "low", "_part")]
    both = flat.select("project_id", "_part", "topic_id", "rule").unionByName(rows, allowMissingColumns=True)
    # A project's rows are few or spread; more partitions than cores even them out.
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    # Rules of no project meet no rows.
    key = F.xxhash64("project_id", F.when(F.col("project_id").isNull(), F.xxhash64("topic_id"))) if "ord" not in columns else F.xxhash64("project_id", F.when(F.col("project_id").isNull(), F.xxhash64("ord")))
    # The parts of a project are next to each other, so that no partition gets several before all have one.
    both = both.repartitionById(tasks, F.pmod(F.pmod(key, F.lit(tasks)) + F.col("_part"), F.lit(tasks)).cast("int")).sortWithinPartitions("project_id", "_part", F.col("rule").isNull(), *(() if "n" in columns else ("low",)), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, listed, rules = sink(columns), None, [], None
        words = None if shared is None else _opened(shared)

        def begun() -> tuple[ProjectRules, Vocabulary]:
            own = words if words is not None else Vocabulary(e for _, r in listed for e in [*(("k", low, no or "") for _, low, no in r.get("words") or ()), *(("n", low, "") for low in r.get("nots") or ()), *(("p", p, "") for _, p in r.get("patterns") or ())])
            rules = ProjectRules(listed, own.ids)
            out.opened(rules)
            return rules, own

        for batch in batches:
            out.kind, out.rule = batch.schema.field("topic_id").type, batch.schema.field("rule").type
            project, part, texts = batch.column("project_id"), batch.column("_part"), batch.column("rule")
            # A project's rows are next to each other, its rules first.
            given = _read(texts.drop_null(), shared) if texts.null_count < len(texts) else []
            codes = project.dictionary_encode("encode").indices.to_numpy(), part.to_numpy(), texts.is_null().to_numpy(False)
            before = np.concatenate([[0], np.cumsum(~codes[2])])  # rules before each row
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(texts)]):
                if a == b:
                    continue
                if at != (now := (project[a].as_py(), part[a].as_py())):
                    if rules is None and listed and out.every:
                        rules, _ = begun()
                    if rules is not None and (done := out.closed(rules)) is not None:
                        yield done
                    at, listed, rules = now, [], None
                if texts[a].is_valid:
                    listed += zip(batch.column("topic_id").slice(a, b - a).to_pylist(), given[before[a] : before[b]])
                    continue
                if rules is None:
                    rules, own = begun()
                held = batch.column("low").slice(a, b - a).to_pylist()
                yield from out.take(batch, a, [x or b"" for x in held] if shared is not None else [own.signature(x) if x else b"" for x in held], rules)
            if (done := out.flush(batch)) is not None:
                yield done
        if rules is None and listed and out.every:
            rules, _ = begun()
        if rules is not None and (done := out.closed(rules)) is not None:
            yield done
        if (done := out.ended()) is not None:
            yield done

    return both.mapInArrow(run, schema)


def _hot(verbatims: DataFrame) -> dict[str, int]:
    """Projects with more than 1/HOT_SHARE of the rows, with the number of parts that leaves less in each."""
    sizes = verbatims.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.count("*").alias("n"))
    least = max(LEAST_HOT, verbatims.count() // HOT_SHARE)
    return {r.project_id: -(-r.n // least) for r in sizes.where(F.col("n") > least).collect()}


def _rows(verbatims: DataFrame, projects: DataFrame | None, shared: Broadcast | None, text: str, *columns: str, keep_all: bool = False) -> DataFrame:
    """Texts that can match, as _swept takes them; projects: of _ruled. With keep_all, those of their projects that can't, too."""
    v = verbatims.where((F.length(text) > 0) & F.col("project_id").isNotNull())
    if projects is not None:
        v = v.join(projects, "project_id", "left_semi")
    v = v.select(*columns, "project_id", F.lower(text).alias("low"))
    return v if shared is None else _signed(v, shared, keep_all)


def _grouped(rows: DataFrame) -> DataFrame:
    """Texts of a project with the same signature as one row, with their number `n`."""
    return rows.groupBy("project_id", "low").agg(F.count("*").alias("n"))


def _ambiguous(rows: DataFrame, key: str) -> bool:
    """Whether a key stands for several rows, or is null."""
    return bool(rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).head(1))


def _repeated(verbatims: DataFrame) -> bool:
    """Whether an ord stands for several texts."""
    return bool(verbatims.groupBy("ord").agg(F.count("*").alias("n")).where("n > 1").head(1))


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _listed(values: pa.Array, rows: list[list[int]]) -> pa.Array:
    """A list of values for each list of their positions."""
    return pa.ListArray.from_arrays(_offsets([len(r) for r in rows]), values.take(pa.array(np.concatenate(rows), pa.int64())))


class _Matches(_Sink):
    """(ord, topic_id, terms) of each match."""

    def __init__(self, columns):
        super().__init__(columns)
        self.rows, self.names, self.terms, self.last = [], [], [], []

    def add(self, i, rules, met, signature, again):
        if not again:
            self.last = rules.terms(met, signature)
        for name, terms in self.last:
            self.rows.append(i)
            self.names.append(name)
            self.terms.append(terms)
        self.size += len(self.last)

    def flush(self, batch):
        if self.rows:
            out = pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(self.rows, pa.int64())), pa.array(self.names, self.kind), pa.array(self.terms, pa.list_(pa.string()))], ["ord", "topic_id", "terms"])
            self.rows, self.names, self.terms, self.size = [], [], [], 0
            return out


class _Pairs(_Sink):
    """(ords, topics) of texts with the same matches: every ord has every topic."""

    distinct = True

    def __init__(self, columns):
        super().__init__(columns)
        self.own, self.base, self.names, self.bases, self.found, self.last = [], 0, [], [], [], None

    def opened(self, rules):
        self.own, self.base, self.known = rules.names, len(self.names), {}
        self.names += rules.names

    def add(self, i, rules, met, signature, again):
        if met:
            if again and self.rows:
                self.rows[-1].append(i)
                return
            if not again:
                self.last = self.known.get(met)
                if self.last is None:
                    self.last = rules.topics(met)
                    if len(rules.listed) <= FEW_RULES:
                        self.known[met] = self.last
            self.rows.append([i])
            self.bases.append(self.base)
            self.found.append(self.last)
            self.size += len(self.last)

    def flush(self, batch):
        out = None
        if self.rows:
            n = [len(t) for t in self.found]
            names = pa.array(self.names, self.kind).take(pa.array(np.concatenate(self.found) + np.repeat(self.bases, n)))
            out = pa.RecordBatch.from_arrays([_listed(batch.column("ord"), self.rows), pa.ListArray.from_arrays(_offsets(n), names)], ["ords", "topics"])
        self.names, self.base, self.rows, self.bases, self.found, self.size = list(self.own), 0, [], [], [], 0
        return out


class _Met(_Sink):
    """The ord of each text with a match."""

    distinct = True

    def add(self, i, rules, met, signature, again):
        if met:
            self.rows.append(i)

    def flush(self, batch):
        if self.rows:
            out = pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(self.rows, pa.int64()))], ["ord"])
            self.rows = []
            return out


class _Counts(_Sink):
    """Per topic (topic_id, null, texts), and per term (topic_id, term, texts)."""

    def opened(self, rules):
        self.signatures, self.n, self.sums = [], [], {}

    def take(self, batch, at, signatures, rules):
        self.signatures += signatures
        self.n += batch.column("n").slice(at, len(signatures)).to_pylist() if "n" in self.columns else [1] * len(signatures)
        if len(self.signatures) >= rules.block:
            self.counted(rules)
        return ()

    def counted(self, rules):
        rules.counted(self.signatures, self.n, self.sums)
        self.signatures, self.n = [], []

    def closed(self, rules):
        if self.signatures:
            self.counted(rules)
        self.rows += rules.totals(self.sums)
        if len(self.rows) > self.most:
            return self.ended()

    def ended(self):
        if self.rows:
            names, terms, n = zip(*self.rows)
            self.rows = []
            return pa.RecordBatch.from_arrays([pa.array(names, self.kind), pa.array(terms, pa.string()), pa.array(n, pa.int64())], ["topic_id", "term", "verbatims"])


class _Metrics(_Counts):
    """Per topic, met or not: the columns `more` of its rule, texts, distinct terms met, and texts of the project."""

    every, more = True, ("run_id", "topic_ord", "canonical_label")

    def opened(self, rules):
        super().opened(rules)
        self.total = 0

    def counted(self, rules):
        self.total += sum(self.n)
        super().counted(rules)

    def closed(self, rules):
        if self.signatures:
            self.counted(rules)
        texts, terms = [0] * len(rules.names), [0] * len(rules.names)
        topics, pairs = rules._kinds
        for t, kind in enumerate(topics):
            texts[t] = self.sums.get(kind, 0)
        for (t, _), kind in pairs.items():
            terms[t] += kind in self.sums
        self.rows += ((name, *[rule[c] for c in self.more], texts[t], terms[t], self.total) for t, (name, rule) in enumerate(rules.first.items()))
        if len(self.rows) > self.most:
            return self.ended()

    def ended(self):
        if self.rows:
            kinds = [self.kind, *[self.rule.field(c).type for c in self.more], *[pa.int64()] * 3]
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*self.rows), kinds)], ["topic_id", *self.more, "volume_verbatims", "volume_mentions", "n"])
            self.rows = []
            return out


class _Texts(_Sink):
    """The number of texts with a match, of each partition."""

    def __init__(self, columns):
        super().__init__(columns)
        self.texts = 0

    def take(self, batch, at, signatures, rules):
        n = batch.column("n").slice(at, len(signatures)).to_pylist()
        self.texts += sum(k for signature, k in zip(signatures, n) if rules.met(signature))
        return ()

    def ended(self):
        return pa.RecordBatch.from_arrays([pa.array([self.texts], pa.int64())], ["with_match"])


class _Labels(_Sink):
    """(rows, topics) of rows with the same matches: the labels of their topics, in topic order, joined by ` | `."""

    most = 8_000_000

    def __init__(self, columns):
        super().__init__(columns)
        self.joined, self.last = [], ""

    def opened(self, rules):
        listed = [(label.get("topic_ord") is None, label.get("topic_ord"), name is None, name, t, label["canonical_label"]) for t, (name, rule) in enumerate(rules.first.items()) for label in rule["labels"] if label.get("canonical_label") is not None]
        listed.sort(key=lambda x: x[:5])
        self.topic, self.label = np.array([x[4] for x in listed], np.int64), np.array([x[5] for x in listed], object)
        self.flags, self.known = np.zeros(len(rules.names), bool), {0: ""}

    def add(self, i, rules, met, signature, again):
        if again and self.rows:
            self.rows[-1].append(i)
            return
        if not again:
            self.last = self.known.get(met)
            if self.last is None:
                self.flags[topics := rules.topics(met)] = True
                self.last = " | ".join(self.label[self.flags[self.topic]].tolist())
                self.flags[topics] = False
                if len(rules.listed) <= FEW_RULES:
                    self.known[met] = self.last
        self.rows.append([i])
        self.joined.append(self.last)
        self.size += len(self.last)

    def flush(self, batch):
        if self.rows:
            rows = pa.StructArray.from_arrays([batch.column(c) for c in self.columns], self.columns)
            out = pa.RecordBatch.from_arrays([_listed(rows, self.rows), pa.array(self.joined, pa.string())], ["rows", "topics"])
            self.rows, self.joined, self.size = [], [], 0
            return out


def topic_matches(verbatims: DataFrame, rules: DataFrame, text: str = "full_text", negation: bool = True, regexes: bool = True) -> DataFrame:
    """Rows (ord, topic_id, terms) of every match of a topic in a verbatim of its project.

    An automaton of all keywords reads each text once; what it found goes to the project's rules. More entries
    than are broadcast are sought project by project. Null and empty texts match nothing; a topic listed twice
    matches once, by each of its rules; regular expressions that do not compile match nothing.
    """
    shared, projects, hot = _at_once(rules.sparkSession, lambda: _vocabulary(rules, negation, regexes), lambda: _ruled(_known(rules)), lambda: _hot(verbatims))
    flat = _flat(_known(rules), negation, regexes, shared=shared)
    kinds = verbatims.schema["ord"].dataType.simpleString(), rules.schema["topic_id"].dataType.simpleString()
    return _swept(_rows(verbatims, projects, shared, text, "ord"), flat, shared, _Matches, f"ord {kinds[0]}, topic_id {kinds[1]}, terms array<string>", hot)


def matched_pairs(verbatims: DataFrame, rules: DataFrame, negation: bool = True, regexes: bool = True) -> DataFrame:
    """Distinct rows (ord, topic_id) of topic_matches."""
    shared, projects, hot, repeated = _at_once(rules.sparkSession, lambda: _vocabulary(rules, negation, regexes), lambda: _ruled(_known(rules)), lambda: _hot(verbatims), lambda: _repeated(verbatims))
    flat = _flat(_known(rules), negation, regexes, shared=shared)
    kinds = verbatims.schema["ord"].dataType.simpleString(), rules.schema["topic_id"].dataType.simpleString()
    met = _swept(_rows(verbatims, projects, shared, "full_text", "ord"), flat, shared, _Pairs, f"ords array<{kinds[0]}>, topics array<{kinds[1]}>", hot, ("ord",))
    pairs = met.select(F.explode("ords").alias("ord"), "topics").select("ord", F.explode("topics").alias("topic_id"))
    # Topics of a text are distinct already: only an ord of several texts can repeat one.
    return pairs.distinct() if repeated else pairs


def matched_texts(verbatims: DataFrame, rules: DataFrame) -> DataFrame:
    """The ord of each text with a topic."""
    shared, projects, hot = _at_once(rules.sparkSession, lambda: _vocabulary(rules), lambda: _ruled(_known(rules)), lambda: _hot(verbatims))
    return _matched_texts(verbatims, rules, shared, projects, hot)


def _matched_texts(verbatims: DataFrame, rules: DataFrame, shared: Broadcast | None, projects: DataFrame | None, hot: dict[str, int]) -> DataFrame:
    flat = _flat(_known(rules), shared=shared)
    return _swept(_rows(verbatims, projects, shared, "full_text", "ord"), flat, shared, _Met, f"ord {verbatims.schema['ord'].dataType.simpleString()}", hot, ("ord",))


def topic_counts(verbatims: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (topic_id, term, verbatims) of the topics and terms met, `term` null for the topic as a whole.

    Texts of a project with the same signature are counted before they meet the rules, so that the work grows
    with the kinds of texts, not with texts times topics.
    """
    shared, projects = _at_once(rules.sparkSession, lambda: _vocabulary(rules), lambda: _ruled(_known(rules)))
    return _topic_counts(verbatims, rules, shared, projects)


def _topic_counts(verbatims: DataFrame, rules: DataFrame, shared: Broadcast | None, projects: DataFrame | None) -> DataFrame:
    flat = _flat(_known(rules), shared=shared)
    schema = f"topic_id {rules.schema['topic_id'].dataType.simpleString()}, term string, verbatims long"
    if shared is None:
        parts = _swept(_rows(verbatims, projects, None, "full_text", "ord"), flat, None, _Counts, schema, _hot(verbatims))
    else:
        parts = _swept(_grouped(_rows(verbatims, projects, shared, "full_text")), flat, shared, _Counts, schema, {})
    return parts.groupBy("topic_id", "term").agg(F.sum("verbatims").alias("verbatims"))


def _counted(matches: DataFrame) -> DataFrame:
    """topic_counts of rows of topic_matches."""
    return matches.select("topic_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term")).groupBy("topic_id", "term").agg(F.count("*").alias("verbatims"))


def topic_metrics(verbatims: DataFrame, rules: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Per topic: verbatims that match, distinct terms met, and share of the project's texts; 0 for topics without match.

    Where a topic is listed once, all that it needs meets in its project: texts are read once, and nothing is joined.
    """
    if matches is None and _plain(rules):
        shared, projects, twice = _at_once(rules.sparkSession, lambda: _vocabulary(rules), lambda: _ruled(_known(rules)), lambda: _ambiguous(rules, "topic_id"))
        if shared is not None and not twice:
            kinds = {f.name: f.dataType.simpleString() for f in rules.schema}
            schema = ", ".join(f"{c} {kinds[c]}" for c in ("topic_id", *_Metrics.more)) + ", volume_verbatims long, volume_mentions long, n long"
            rows = _grouped(_rows(verbatims, projects, shared, "full_text", keep_all=True))
            met = _swept(rows, _flat(rules, True, True, *_Metrics.more, shared=shared), shared, _Metrics, schema, {})
            return met.withColumn("pct_of_dataset", F.when(F.col("n") > 0, F.round(100.0 * F.col("volume_verbatims") / F.col("n"), 2)).otherwise(0.0)).drop("n")
        counts = _topic_counts(verbatims, rules, shared, projects)
    else:
        counts = topic_counts(verbatims, rules) if matches is None else _counted(matches)
    per_topic = counts.groupBy("topic_id").agg(F.sum(F.when(F.col("term").isNull(), F.col("verbatims"))).alias("volume_verbatims"), F.count("term").alias("volume_mentions"))
    sizes = verbatims.where(F.length("full_text") > 0).groupBy("project_id").agg(F.count("*").alias("n"))
    base = rules.select("topic_id", "run_id", "project_id", "topic_ord", "canonical_label").join(sizes, "project_id", "left").join(per_topic, "topic_id", "left")
    vv = F.coalesce("volume_verbatims", F.lit(0)).cast("long")
    return base.select(
        "topic_id", "run_id", "topic_ord", "canonical_label",
        vv.alias("volume_verbatims"), F.coalesce("volume_mentions", F.lit(0)).cast("long").alias("volume_mentions"), F.when(F.coalesce("n", F.lit(0)) > 0, F.round(100.0 * vv / F.col("n"), 2)).otherwise(0.0).alias("pct_of_dataset"),
    )


def keyword_counts(counts: DataFrame) -> DataFrame:
    """Per topic and term: verbatims that contain it; of topic_counts."""
    return counts.where(F.col("term").isNotNull())


def keyword_sheet(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per keyword of each topic with its count, and one per negative keyword; of topic_counts."""
    counts = keyword_counts(counts)
    kw = rules.select("topic_id", F.explode(F.transform("words", lambda k: k[0]) if "words" in rules.columns else F.transform("rules", lambda k: k["term"])).alias("term"))
    kw = kw.join(counts, ["topic_id", "term"], "left").select("topic_id", "term", F.lit("keyword").alias("kind"), F.coalesce("verbatims", F.lit(0)).cast("long").alias("verbatims"))
    neg = rules.select("topic_id", F.explode(F.array_distinct(F.coalesce("negatives", F.array().cast("array<string>")))).alias("term"))
    return kw.unionByName(neg.select("topic_id", "term", F.lit("negative").alias("kind"), F.lit(0).cast("long").alias("verbatims")))


def entities(dictionary: DataFrame) -> DataFrame:
    """The dictionary with one row per (type, label): the keywords of all its rows, without empty ones."""
    t = F.coalesce("entity_type", F.lit("unknown"))
    words = dictionary.select(t.alias("entity_type"), "label", F.explode_outer("keywords").alias("k"))
    return words.groupBy("entity_type", "label").agg(F.array_sort(F.collect_set(F.when(F.length("k") > 0, F.lower("k")))).alias("keywords"))


def entity_matches(verbatims: DataFrame, dictionary: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows (ord, entity_type, label) of the entities that a text contains, found by an automaton of their keywords.

    A dictionary of more than BROADCAST_RULES entities is sought in parts of that size, with a pass over the texts each.
    """
    spark, kind = verbatims.sparkSession, verbatims.schema["ord"].dataType.simpleString()
    entries = entities(dictionary)
    parts = max(1, -(-entries.count() // BROADCAST_RULES))
    v = verbatims.where(F.length(text) > 0).select("ord", F.lower(text).alias("low"))

    def one_pass(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r.entity_type, r.label, r.keywords) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            matcher = Matcher([("", k, [(w, w, ()) for w in words], (), ()) for k, (_, _, words) in enumerate(held)])
            for batch in batches:
                found = [(i, k) for i, low in enumerate(batch.column("low").to_pylist()) for k, _ in matcher.match("", low)]
                at, which = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(at, pa.int64())), pa.array([held[k][0] for k in which], pa.string()), pa.array([held[k][1] for k in which], pa.string())], ["ord", "entity_type", "label"])

        return v.mapInArrow(run, f"ord {kind}, entity_type string, label string")

    part = F.pmod(F.xxhash64("entity_type", "label"), F.lit(parts))
    out = None
    for k in range(parts):
        found = one_pass(entries.where(part == k).collect())
        out = found if out is None else out.unionByName(found)
    return out


def entity_counts(verbatims: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per entity: texts that contain it, 0 included."""
    n = entity_matches(verbatims, dictionary).groupBy("entity_type", "label").agg(F.count("*").alias("verbatims"))
    return entities(dictionary).select("entity_type", "label").join(n, ["entity_type", "label"], "left").withColumn("verbatims", F.coalesce("verbatims", F.lit(0)).cast("long"))


def enriched(verbatims: DataFrame, rules: DataFrame, dictionary: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Each verbatim with its topics' labels in topic order and its entities by type, joined by ` | `."""
    own = F.struct("topic_ord", "canonical_label")
    v = verbatims.select("ord", "project_id", F.lower("full_text").alias("low"))
    entries = entities(dictionary)
    shared, projects, hot, repeated, twice, met = _at_once(
        rules.sparkSession, lambda: _vocabulary(rules), lambda: _ruled(_known(rules)), lambda: _hot(verbatims), lambda: _repeated(verbatims), lambda: _ambiguous(rules, "topic_id"), lambda: entries.limit(BROADCAST_RULES + 1).collect()
    )
    labelled = rules.join(rules.groupBy("topic_id").agg(F.collect_list(own).alias("labels")), "topic_id") if twice else rules.withColumn("labels", F.array(own))
    flat = _flat(_known(labelled), True, True, "labels", shared=shared)
    columns = [f"entity_{t}" for t in types]
    if len(met) <= BROADCAST_RULES and not repeated:
        # A text's entities are all of its ord: they are found as it is read.
        v = v.withColumn("low", F.when(F.col("ord").isNotNull(), F.col("low")))
        named = verbatims.sparkSession.sparkContext.broadcast([tuple(r) for r in met])
        add = lambda rows, by: _signed(rows, by, True, named, types)
        swept = add(v if projects is None else v.join(projects, "project_id", "left_semi"), shared)
        rest = None if projects is None else add(v.join(projects, "project_id", "left_anti"), None).withColumn("topics", F.lit(""))
    else:
        found = entity_matches(verbatims, dictionary).groupBy("ord").pivot("entity_type", list(types)).agg(F.array_join(F.array_sort(F.collect_list("label")), " | "))
        found = found.select("ord", *[F.col(t).alias(c) for t, c in zip(types, columns)])
        swept, rest = (v if shared is None else _signed(v, shared, True)).join(found, "ord", "left"), None
    # Labels are added last: they are long, and are not shuffled.
    schema = StructType([StructField("rows", ArrayType(StructType([f for f in swept.schema if f.name not in ("project_id", "low")]))), StructField("topics", StringType())])
    out = _swept(swept, flat, shared, _Labels, schema, hot).select(F.inline("rows"), "topics")
    out = out if rest is None else out.unionByName(rest.select(*out.columns))
    return out.select("ord", "topics", *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def topic_summary(verbatims: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: texts, texts with a topic, texts without. Where an ord is one text's, texts are counted by signature."""
    shared, projects, repeated = _at_once(rules.sparkSession, lambda: _vocabulary(rules), lambda: _ruled(_known(rules)), lambda: _ambiguous(verbatims, "ord"))
    if shared is None or repeated:
        return summary(verbatims, _matched_texts(verbatims, rules, shared, projects, _hot(verbatims)))
    met = _swept(_grouped(_rows(verbatims, projects, shared, "full_text")), _flat(_known(rules), shared=shared), shared, _Texts, "with_match long", {})
    return _summary(verbatims, met.agg(F.lit(0).cast("long").alias("total"), F.coalesce(F.sum("with_match"), F.lit(0)).alias("with_match")))


def summary(verbatims: DataFrame, met: DataFrame) -> DataFrame:
    """One row: texts, texts with a topic (their ord, of matched_texts or topic_matches), texts without."""
    return _summary(verbatims, met.agg(F.lit(0).cast("long").alias("total"), F.count_distinct("ord").alias("with_match")))


def _summary(verbatims: DataFrame, met: DataFrame) -> DataFrame:
    total = verbatims.agg(F.count_if(F.length("full_text") > 0).alias("total"), F.lit(0).cast("long").alias("with_match"))
    both = total.unionByName(met).agg(F.sum("total").alias("total"), F.sum("with_match").alias("with_match"))
    return both.withColumn("without_match", F.col("total") - F.col("with_match"))


def ontology(run_topics: DataFrame) -> DataFrame:
    """The rules of topics, apart from the topics: one row each, nulls as empty lists, with the default negations."""
    none = F.array().cast("array<string>")
    return run_topics.select("topic_id", "run_id", *[F.coalesce(c, none).alias(c) for c in ("keywords", "regex_patterns", "negative_keywords")], default_negations().alias("negation_patterns"))


def topics_with_ontology(run_topics: DataFrame, rules: DataFrame, run_id: str | None = None) -> DataFrame:
    """Topics with their rules, by topic; those of one run, or of all. Topics without rules, and rules without topic, are left out."""
    t = run_topics if run_id is None else run_topics.where(F.col("run_id") == run_id)
    return t.select("topic_id", "run_id", "topic_ord", "canonical_label", "canonical_subtopic").join(rules.drop("run_id"), "topic_id")


def top_topics(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n topics of each run with most verbatims; ties in topic order."""
    w = Window.partitionBy("run_id").orderBy(F.desc("volume_verbatims"), "topic_ord", "topic_id")
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def validation(verbatims: DataFrame, rules: DataFrame, first: int = 100, examples: int = 5) -> DataFrame:
    """Per topic, over the first texts of its project: matches, their rate, and the first examples' ids. Keywords only."""
    w = Window.partitionBy("project_id").orderBy("ord")
    v = verbatims.where(F.length("full_text") > 0).select("ord", "project_id", "full_text").withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    sizes = v.groupBy("project_id").agg(F.count("*").alias("n"))
    hits = topic_matches(v, rules, regexes=False).groupBy("topic_id").agg(F.count("*").alias("m"), F.slice(F.array_sort(F.collect_list("ord")), 1, examples).alias("e"))  # at most `first`
    base = rules.select("topic_id", "project_id").join(sizes, "project_id").join(hits, "topic_id", "left")
    m = F.coalesce("m", F.lit(0)).cast("long")
    return base.select("topic_id", m.alias("matches"), F.round(m / F.col("n"), 3).alias("rate"), F.coalesce(F.array_join(F.transform("e", lambda x: x.cast("string")), ","), F.lit("")).alias("examples"))
