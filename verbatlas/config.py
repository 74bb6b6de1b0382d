"""Settings and fixed values of the analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    max_verbatims: int = 30_000
    chunk_size: int = 200
    sample_size_rapid: int = 750
    llm_max_retries: int = 3
    llm_parallel_calls: int = 10
    dedup_threshold: float = 0.90
    fuzzy_merge_threshold: float = 0.92
    jaccard_merge_threshold: float = 0.75
    negation_window_chars: int = 30
    min_per_stratum: int = 30
    cap_per_stratum: int = 300
    sampling_seed: int = 42
    warning_chunks: int = 100
    blocking_chunks: int = 500
    output_tokens_per_chunk: int = 2_000
    seconds_per_chunk: int = 30
    prompt_chars: int = 50_000
    strata: tuple[str, ...] = field(default=("sentiment", "language", "page_type", "category"))


SETTINGS = Settings()

# They decide what is matched, mapped and accepted.
NEGATION_PATTERNS = ("pas de", "sans", "aucun", "aucune", "n'ai pas", "n'a pas", "ne pas", "ni", "jamais", "plus de")
VENDOR_MAPPINGS = {
    "brandwatch": {
        "Full Text": "full_text", "Date": "source_date", "Sentiment": "sentiment", "Language": "language",
        "Page Type": "page_type", "URL": "url", "Author": "author", "Query Id": "source_id",
    },
    "semantiweb": {
        "review_text": "full_text", "review_date": "source_date", "sentiment_label": "sentiment", "language": "language", "source": "page_type",
        "review_url": "url", "author_name": "author", "review_id": "source_id", "category": "category",
    },
}
VENDOR_MARKERS = {
    "brandwatch": ("Full Text", "Query Id", "Page Type", "Sentiment"),
    "semantiweb": ("review_text", "review_id", "sentiment_label"),
}
STANDARD_COLUMNS = ("full_text", "source_id", "source_date", "sentiment", "language", "page_type", "category", "author", "url")
MANUAL_TARGETS = ("brand", "product", "subcategory")
RUN_STATUSES = ("pending", "processing", "success", "partial", "failed", "interrupted")
RUN_MODES = ("rapid", "full")
SOURCE_TYPES = ("brandwatch", "semantiweb", "generic_csv")
MERGE_METHODS = ("pass1_algo", "pass2_llm", "manual", "single")
ENTITY_TYPES = ("pathology", "brand", "zone", "attribute")
TOKEN_PRICES = {"default": (0.01, 0.03)}  # US dollars for 1,000 tokens in, out
