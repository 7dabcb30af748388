"""Encoding of texts with a public byte-level tokenizer.

A text is cut into pre-tokens by the tokenizer's pattern; each pre-token is merged from
its bytes by rank. The pairs that can merge wait in a rank queue: a bucket per rank holds
linked-list positions, and bitmaps in three levels over the ranks find the lowest filled
bucket by find-first-set, whatever the length of the pre-token. Entries whose pair has
changed meanwhile are stale and skipped. Short pre-tokens repeat, so each worker keeps
the ids of those it has met; that memory is bounded.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; they are never copied.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k"
# Fixed value: the pattern that cuts text before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers, and the longest of them in bytes.
MEMORY, MEMORY_BYTES = 200_000, 64
WORD_BITS = 64


class RankQueue:
    """Positions by rank; the lowest rank comes first, and its leftmost position."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * (ranks // WORD_BITS + 1)
        self.mid = [0] * (len(self.low) // WORD_BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        word, group = rank // WORD_BITS, rank // (WORD_BITS * WORD_BITS)
        self.low[word] |= 1 << (rank % WORD_BITS)
        self.mid[group] |= 1 << (word % WORD_BITS)
        self.top |= 1 << group

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group * WORD_BITS + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = word * WORD_BITS + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[word] &= self.low[word] - 1
            if not self.low[word]:
                self.mid[group] &= self.mid[group] - 1
                if not self.mid[group]:
                    self.top &= self.top - 1
        return rank, at


class ByteBpe:
    """A byte-level tokenizer from a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.cut = regex.compile(pattern)
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        n = len(raw)
        if n == 1:
            return (self.single[raw[0]],)
        ranks, queue = self.ranks, self.queue
        end = list(range(1, n + 1))  # where the part that starts at i ends
        before = list(range(-1, n - 1))  # where the part before i starts
        pair = [-1] * n  # the rank of the pair that starts at i
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            mid = end[i]
            stop = end[mid]
            pair[mid] = -1
            end[i] = stop
            pair[i] = -1
            if stop < n:
                before[stop] = i
                r = ranks.get(raw[i : end[stop]])
                if r is not None:
                    pair[i] = r
                    queue.push(r, i)
            left = before[i]
            if left >= 0:
                r = ranks.get(raw[left:stop])
                pair[left] = -1 if r is None else r
                if r is not None:
                    queue.push(r, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for an empty or null one."""
        out: list[int] = []
        known = self.known
        for m in self.cut.finditer(text or ""):
            token = m[0]
            ids = known.get(token)
            if ids is None:
                raw = token.encode("utf-8")
                ids = self.merge(raw)
                if len(raw) <= MEMORY_BYTES:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[token] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, once per worker."""
    return ByteBpe(path)


def vocabulary_file(name: str = BYTE_BPE, folder: str = TOKENIZER_DIR) -> str:
    """The rank file of a byte-level vocabulary."""
    return os.path.join(folder, f"{name}.tiktoken")


def encode_column(text: Column, path: str) -> Column:
    """``array<int>``: the ids of a text."""

    def run(texts: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


def length_column(text: Column, path: str) -> Column:
    """The number of ids of a text."""

    def run(texts: pd.Series) -> pd.Series:
        bpe = tokenizer(path)
        return pd.Series([len(bpe.encode(t)) for t in texts], dtype="int64")

    return F.pandas_udf(run, "bigint")(text)


def encode_texts(items: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` for every row. An empty and a null text have an empty list of ids.

    Strings that spell a special token are ordinary text. Repeated rows are encoded each;
    other columns are ignored.
    """
    return items.select(key, encode_column(F.col(text), path or vocabulary_file()).alias("ids"))
