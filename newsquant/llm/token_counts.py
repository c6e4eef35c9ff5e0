"""Token counts with a whole-token shortcut.

Once, on the driver, every vocabulary string is put through the merge rules;
those that come out as one token are proven shortcuts. Counting then cuts each
text into pre-tokens, counts the proven ones directly and runs the merges only
for the rest, whose counts a bounded table per Python worker remembers.

Defined results: null counts as empty (0 bytes, 0 tokens); special strings in
a text count as the one special token, as the library does by default; rows
that repeat are counted each; long pre-tokens merge in n log n steps.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsquant.llm.common import read, text_of
from newsquant.session import ship_package

#: How byte-level vocabularies cut a text before merging, and how they write bytes as letters (fixed values).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

LIMIT = 512
#: Pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, the others from 256 on."""
    other = iter(range(256, 512))
    return [chr(b) if b in _PLAIN else chr(next(other)) for b in range(256)]


class Merges:
    """Merge rules, special strings and the proven one-token strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        letters = byte_letters()
        self.letters = letters
        back = {c: b for b, c in enumerate(letters)}
        self.proven = []
        for word in spec["model"]["vocab"]:
            if word in self.special or self.count_letters(word) != 1:
                continue
            try:
                self.proven.append(bytes(back[c] for c in word).decode())
            except UnicodeDecodeError:  # part of a character, never a whole pre-token
                pass

    def count(self, piece: str) -> int:
        return self.count_letters("".join(self.letters[b] for b in piece.encode()))

    def count_letters(self, word: str) -> int:
        """Tokens of one pre-token: always the lowest-ranked adjacent pair first, leftmost on ties."""
        n = len(word)
        if n < 2:
            return n
        ranks, part = self.ranks, list(word)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i, j = heapq.heappop(heap)
            if part[i] is None or after[i] != j or ranks.get((part[i], part[j])) != r:
                continue
            part[i], part[j] = part[i] + part[j], None
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (s := ranks.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (s, i, k))
            h = before[i]
            if h >= 0 and (s := ranks.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (s, h, i))
        return left


class Counter(dict):
    """Tokens by pre-token: proven strings from the start, others merged when first met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.find = regex.compile(PIECES).findall
        self.update(dict.fromkeys(merges.proven, 1))

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.merges.proven, 1))
        n = self[piece] = self.merges.count(piece)
        return n

    def tokens(self, text: str) -> int:
        total, parts = 0, [text]
        for s in self.merges.special:
            total += text.count(s)
            parts = [q for p in parts for q in p.split(s)]
        get, find = self.__getitem__, self.find
        return total + sum(sum(map(get, find(p))) for p in parts)


def token_count(spark: SparkSession, path: str):
    """A function of a text column that gives its number of tokens; the rules are sent once, about 2 MB."""
    ship_package(spark)
    rules = spark.sparkContext.broadcast(Merges(path))

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(rules.value)
        for texts in batches:
            yield pd.Series([counter.tokens(t) for t in texts], dtype="int64")

    def of(text: Column) -> Column:
        return count(text)

    return of


def token_rows(spark: SparkSession, sf_dir: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents")
    tokens = token_count(spark, path)
    counted = docs.select(
        "doc_id", F.octet_length(text_of("text")).cast("bigint").alias("n_bytes"), tokens(text_of("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
