"""Theme extraction as a pluggable step, and the pipeline around it.

An analyzer turns the texts of a chunk into themes. A language model can be plugged in; the default is
deterministic and needs none: the most frequent words of the chunk. Its results are written before they
are used, so that a retried task never asks again for what is already there.
"""

from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import NEGATION_PATTERNS, SETTINGS, TOKEN_PRICES
from ..functions.text import CleaningOptions, clean
from ..operators import dedup, sampling, topics
from ..operators.merging import fallback_rules
from ..session import materialise

Analyzer = Callable[[list[str]], str]
RESULT = "project_id string, chunk_index long, status string, error string, tokens_used long, cost double, response string"
THEMES = "struct<summary:string,themes:array<struct<topic_label:string,subtopic_label:string,pain_points:array<string>,benefits:array<string>,usage_context:string,example_verbatims:array<string>>>>"


def frequent_words(texts: list[str], most: int = 5) -> str:
    """Themes of a chunk without a model: its most frequent words of five letters or more, as JSON."""
    count = Counter(w for t in texts for w in set(re.findall(r"[^\W\d_]{5,}", t.lower())))
    top = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:most]
    themes = [{"topic_label": w, "pain_points": [], "benefits": [], "example_verbatims": [t for t in texts if w in t.lower()][:2]} for w, _ in top]
    return json.dumps({"summary": f"{len(texts)} texts", "themes": themes}, ensure_ascii=False)


def token_count(text: str) -> int:
    """About four characters a token; counts of a model's own tokenizer may replace it."""
    return -(-len(text) // 4)


def token_cost(tokens_in: int, tokens_out: int, model: str = "default") -> float:
    a, b = TOKEN_PRICES.get(model, TOKEN_PRICES["default"])
    return round(tokens_in / 1000 * a + tokens_out / 1000 * b, 4)


def unfenced(response: str) -> str:
    """A response's JSON without the code fence that some models put around it."""
    m = re.search(r"```(?:json)?\s*(.*?)```", response, re.S)
    return m.group(1) if m else response


def back_off(k: int) -> None:
    """Waits 4 seconds before the second try, then twice as long each time, up to a minute."""
    time.sleep(min(60, 4 * 2**k))


def with_retries(analyzer: Analyzer, tries: int = SETTINGS.llm_max_retries, wait: Callable[[int], None] = back_off) -> Analyzer:
    """Tries again on connection errors only."""

    def call(texts: list[str]) -> str:
        for k in range(tries):
            try:
                return analyzer(texts)
            except (ConnectionError, TimeoutError):
                if k == tries - 1:
                    raise
                wait(k)
        raise AssertionError

    return call


def call_json(analyzer: Analyzer, texts: list[str]) -> dict:
    """An analyzer's response as JSON, without a fence; raises where it is none."""
    return json.loads(unfenced(with_retries(analyzer)(texts)))


def answers(analyzer: Analyzer) -> bool:
    """Whether an analyzer answers a tiny call."""
    try:
        analyzer(["ok"])
        return True
    except Exception:  # any failure is a no
        return False


def topic_lines(labels: list[tuple[str, str | None]]) -> str:
    """Topics as numbered lines `label > subtopic` of a prompt."""
    return "\n".join(f"{k}. {label} > {sub}" if sub else f"{k}. {label}" for k, (label, sub) in enumerate(labels, 1))


def rules_prompt(label: str, subtopic: str | None = None, description: str | None = None, examples: list[str] | None = None) -> list[str]:
    """What a model is told to write the rules of a topic: up to five examples, and a word for what is missing."""
    shown = "\n".join(f"- {x}" for x in (examples or [])[:5]) or "none given"
    return [f"Topic: {label}", f"Subtopic: {subtopic or 'N/A'}", f"Description: {description or 'none'}", f"Examples:\n{shown}", "Answer in JSON: keywords, regex_patterns, negative_keywords, negation_patterns."]


def generated_rules(run_topics: DataFrame, analyzer: Analyzer) -> DataFrame:
    """Rows (topic_id, keywords, regex_patterns, negative_keywords, negation_patterns, source): rules that an analyzer
    writes for each topic. Without negations it gets the default ones; where the call or its JSON fails, the
    topic gets the fallback's keywords, and source is `fallback`. Topics travel in Arrow batches, one call each."""
    fall = fallback_rules(run_topics).select("topic_id", F.filter(F.split("keywords", r" \| "), lambda w: w != "").alias("fallback"))
    rows = run_topics.select("topic_id", F.coalesce("canonical_label", F.lit("")).alias("label"), "canonical_subtopic").join(fall, "topic_id")
    names = ("keywords", "regex_patterns", "negative_keywords", "negation_patterns")

    def run(parts):
        for pdf in parts:
            out = []
            for t in pdf.itertuples():
                try:
                    got = call_json(analyzer, rules_prompt(t.label, t.canonical_subtopic))
                    rules = [[str(x) for x in got.get(c) or []] for c in names]
                    out.append((t.topic_id, *rules[:3], rules[3] or list(NEGATION_PATTERNS), "model"))
                except Exception:  # a topic without a model's rules still gets some
                    out.append((t.topic_id, list(t.fallback), [], [], list(NEGATION_PATTERNS), "fallback"))
            yield pd.DataFrame(out, columns=["topic_id", *names, "source"])

    return rows.mapInPandas(run, "topic_id string, " + ", ".join(f"{c} array<string>" for c in names) + ", source string")


def analyze_chunks(chunked: DataFrame, texts: DataFrame, analyzer: Analyzer = frequent_words, most: int = SETTINGS.prompt_chars) -> DataFrame:
    """Rows of RESULT, one per chunk (project_id, chunk_index): a response, or status `failed` with the error.

    A chunk has at most a few hundred texts, so a group always fits a task; texts beyond a prompt's size
    are cut from the first that doesn't fit.
    """
    rows = chunked.join(texts.select("ord", F.coalesce("full_text", F.lit("")).alias("text")), "ord")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held, size = [], 0
        for t in pdf.sort_values("pos").text:
            if size + len(t) > most:
                break
            held.append(t)
            size += len(t) + 1
        head = pdf.iloc[0]
        try:
            out = unfenced(with_retries(analyzer)(held))
            json.loads(out)
            tokens = sum(map(token_count, held))
            row = ("success", None, tokens + token_count(out), token_cost(tokens, token_count(out)), out)
        except Exception as e:  # a failed chunk is a result
            row = ("failed", str(e)[:500], 0, 0.0, None)
        return pd.DataFrame([(head.project_id, head.chunk_index, *row)], columns=["project_id", "chunk_index", "status", "error", "tokens_used", "cost", "response"])

    return rows.groupBy("project_id", "chunk_index").applyInPandas(run, RESULT)


def flatten_themes(results: DataFrame) -> DataFrame:
    """One row per theme of successful chunks, with defaults for missing parts; responses that don't parse give none."""
    parsed = results.where("status = 'success'").withColumn("r", F.from_json("response", THEMES, {"mode": "PERMISSIVE"}))
    t = parsed.select("project_id", "chunk_index", F.posexplode("r.themes").alias("pos", "t"))
    empty = F.array().cast("array<string>")
    return t.select(
        "project_id", "chunk_index", "pos", F.coalesce("t.topic_label", F.lit("")).alias("topic_label"), F.coalesce("t.subtopic_label", F.lit("")).alias("subtopic_label"),
        F.coalesce("t.pain_points", empty).alias("pain_points"), F.coalesce("t.benefits", empty).alias("benefits"), F.coalesce("t.usage_context", F.lit("")).alias("usage_context"),
        F.coalesce("t.example_verbatims", empty).alias("example_verbatims"),
    )


def outcome(results: DataFrame) -> DataFrame:
    """Per project: chunks that succeeded and failed, tokens, cost, and status: success, partial or failed."""
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    status = F.when(bad == 0, "success").when(ok > 0, "partial").otherwise("failed")
    return results.groupBy("project_id").agg(ok.alias("chunks_success"), bad.alias("chunks_failed"), F.sum("tokens_used").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), status.alias("status"))


def sentiment_split(themes: DataFrame) -> DataFrame:
    """Percent of pain points among a theme's points; null where there are none."""
    p, b = F.size("pain_points"), F.size("benefits")
    return themes.withColumn("pain_pct", F.when(p + b > 0, F.round(100.0 * p / (p + b), 1)))


@dataclass
class Pipeline:
    """Clean, deduplicate within each project, sample or chunk, analyze, merge themes, count. Fails fast; every stage is written."""

    analyzer: Analyzer = frequent_words
    options: CleaningOptions = field(default_factory=CleaningOptions)
    drop_duplicates: bool = True
    dedup_mode: str = "shingles"  # or `exact`: the reference's ratio
    mode: str = "full"

    def run(self, verbatims: DataFrame) -> dict[str, DataFrame]:
        v = verbatims.where(F.length("full_text") > 0).select("ord", "project_id", clean(F.col("full_text"), self.options).alias("full_text"))
        v = materialise(v, "cleaned")
        if self.drop_duplicates:
            v = materialise(v.join(dedup.keep_first(dedup.duplicate_classes(v, "ord", "full_text", mode=self.dedup_mode, group_col="project_id"), "ord"), "ord", "left_semi"), "kept")
        if self.mode == "rapid":
            v = v.join(sampling.random_sample(v, "ord", SETTINGS.sample_size_rapid), "ord", "left_semi")
        chunked = sampling.chunks(v, "ord", "project_id", SETTINGS.sample_size_rapid if self.mode == "rapid" else SETTINGS.chunk_size)
        results = materialise(analyze_chunks(chunked, v, self.analyzer), "chunk-results")
        themes = materialise(flatten_themes(results), "themes")
        rules = themes.groupBy("project_id", F.lower("topic_label").alias("canonical_label")).agg(F.min("chunk_index").alias("topic_ord"))
        rules = rules.where(F.length("canonical_label") > 0).select(
            F.sha2(F.concat_ws("|", "project_id", "canonical_label"), 256).alias("topic_id"), F.col("project_id").alias("run_id"), "project_id", F.col("topic_ord").cast("int").alias("topic_ord"), "canonical_label",
            F.lit("").alias("canonical_subtopic"), F.array("canonical_label").alias("keywords"),
        )
        rules = rules.withColumn("rules", topics.compiled_keywords(F.col("keywords"), topics.default_negations())).withColumn("negatives", F.array().cast("array<string>")).withColumn("regexes", topics.compiled_regexes(F.array().cast("array<string>")))
        matches = materialise(topics.topic_matches(v, rules), "topic-matches")
        return {"texts": v, "results": results, "outcome": outcome(results), "themes": themes, "rules": rules, "metrics": topics.topic_metrics(v, rules, matches)}


def alert_level(chunks: int) -> str:
    return "blocking" if chunks >= SETTINGS.blocking_chunks else "warning" if chunks >= SETTINGS.warning_chunks else "none"


def status_text(status: str, error: str | None = None) -> str:
    """A line for people on how a run stands."""
    lines = {"pending": "waiting", "processing": "running", "success": "done", "partial": "done, some chunks failed", "interrupted": "interrupted"}
    return f"failed: {error or 'unknown error'}" if status == "failed" else lines.get(status, status)


def run_metadata(**values: object) -> str:
    """A run's settings and figures as JSON; what JSON has no type for becomes text."""
    return json.dumps(values, default=str, ensure_ascii=False, sort_keys=True)
