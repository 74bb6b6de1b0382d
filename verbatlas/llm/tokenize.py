"""Byte-level BPE encoding and decoding of a whole corpus.

Merges are found exactly without simulating them: at every position the longest vocabulary token is
taken (all candidates of a piece come from one Aho-Corasick pass over its bytes); a token may follow
another only if BPE itself would leave that border alone, which is looked up in, and added to, a
pair-compatibility table; on a dead end the last token is replaced by its next shorter prefix. Text
positions already known to fail are never tried again, so the work is linear in the bytes.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Pre-tokenisation of the 50k byte-level vocabularies, as published with them.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept by each worker; a fuller cache is emptied, which costs time only.
CACHE_PIECES = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_ranks(path: str) -> list[bytes]:
    """Token bytes in rank order from a `base64 rank` file; ranks must be 0, 1, 2, …"""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive")
    return [t for _, t in pairs]


class PieceEncoder:
    """Exact BPE of single pieces (byte strings) by longest match with backtracking."""

    def __init__(self, tokens: list[bytes]):
        import ahocorasick

        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.finder.add_word(t.decode("latin-1"), i)
        self.finder.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._compatible: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes `token`; a token that no merge makes is its own halves."""
        if (found := self._halves.get(token)) is None:
            parts = [self.rank.get(bytes([b])) for b in self.tokens[token]]
            while len(parts) > 2:  # merge below the token's own rank, lowest first
                joined = [self.rank.get(self.tokens[a] + self.tokens[b], sys.maxsize) for a, b in zip(parts, parts[1:])]
                low = min(joined)
                if low >= token:
                    break
                k = joined.index(low)
                parts[k : k + 2] = [low]
            found = self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the joined bytes gives exactly these two tokens.

        Walks back both tokens' merges, latest first. Were there a pair across the border whose merge
        comes before the merge undone last, BPE would have taken it and destroyed the border.
        """
        key = (left, right)
        if (known := self._compatible.get(key)) is not None:
            return known
        limit, a, b, result = sys.maxsize, left, right, None
        while result is None:
            across = self.rank.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit:
                result = False
                break
            whole_a, whole_b = self.size[a] == 1 or self.halves(a)[1] == a, self.size[b] == 1 or self.halves(b)[0] == b
            if whole_a and whole_b:
                result = True
            elif whole_b or (not whole_a and a > b):
                limit, a = a, self.halves(a)[1]
            else:
                limit, b = b + 1, self.halves(b)[0]  # at equal rank the left pair merges first
        self._compatible[key] = result
        return result

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n = len(piece)
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.finder.iter(piece.decode("latin-1")):
            starting[end - self.size[token] + 1].append(token)  # shortest first
        open_at = [True] * (n + 1)
        out: list[int] = []
        place: list[int] = []  # index into starting[] of each token taken
        pos, tried = 0, len(starting[0]) - 1
        while pos < n:
            taken = False
            while tried >= 0:
                token = starting[pos][tried]
                if open_at[pos + self.size[token]] and (not out or self.compatible(out[-1], token)):
                    taken = True
                    break
                tried -= 1
            if taken:
                out.append(token)
                place.append(tried)
                pos += self.size[token]
                tried = len(starting[pos]) - 1 if pos < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                open_at[pos] = False
                pos -= self.size[out.pop()]
                tried = place.pop() - 1
        return out


def _unlike(ch: str) -> bool:
    """Whether Python's re puts a character into another class than the published pattern does."""
    c = unicodedata.category(ch)
    return (ch.isalnum() and not (c[0] == "L" or c == "Nd")) or (ch.isspace() and ch in "\x1c\x1d\x1e\x1f")


class TextEncoder:
    """Splits texts into pieces and encodes them; pieces repeat, so each is encoded once and kept."""

    def __init__(self, tokens: list[bytes]):
        import regex

        self.pieces = PieceEncoder(tokens)
        self.odd = frozenset(filter(_unlike, map(chr, range(0x20000))))
        plain = PIECES.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.fast, self.exact = re.compile(plain).findall, regex.compile(PIECES).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        words, known = (self.fast if self.odd.isdisjoint(text) else self.exact)(text), self.known
        try:
            return list(chain.from_iterable([known[w] for w in words]))
        except KeyError:
            if len(known) > CACHE_PIECES:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = tuple(self.pieces.encode(w.encode("utf-8", "surrogatepass")))
            return list(chain.from_iterable([known[w] for w in words]))


_encoders: dict[int, TextEncoder] = {}


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every text: rows (id_col, ids array<int>), without special tokens.

    Null and empty texts get an empty list; texts are encoded whole, whatever their length; repeated
    rows come out as often as they went in; an empty table gives no rows; other columns, also ones
    named `ids`, are not read. The vocabulary file is read on the driver and broadcast: its size does
    not depend on the corpus.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary or default_vocabulary()))
    name = shared.id if hasattr(shared, "id") else id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = TextEncoder(shared.value)
        encode = _encoders[name].encode
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                lists = [encode(t) if t else [] for t in part.column(1).to_pylist()]
                offsets = np.fromiter(accumulate(map(len, lists), initial=0), np.int32, len(lists) + 1)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    # A row of text becomes a wider row of ids; more and smaller tasks than the scan's splits even them out.
    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None) -> DataFrame:
    """Texts of token ids: rows (id_col, text). Null lists give null; ids outside the vocabulary fail the row's task.

    The vocabulary is one byte array with an offset table; each batch of lists is gathered at once.
    """
    spark = df.sparkSession
    tokens = load_ranks(vocabulary or default_vocabulary())
    shared = spark.sparkContext.broadcast((b"".join(tokens), np.cumsum([0, *map(len, tokens)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, offsets = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                if any(i is None or not 0 <= i < len(offsets) - 1 for i in ids):
                    raise ValueError("a token id is outside the vocabulary")
                texts.append(b"".join([blob[offsets[i] : offsets[i + 1]] for i in ids]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col).alias("_ids")).mapInArrow(run, f"`{id_col}` {kind}, text string")
