"""Token counts of a byte-level pair-merging vocabulary, without making identifiers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled

VOCABULARY = "byte_bpe_50k.json"
#: Entries that a worker's cache holds before it is emptied; the counts don't depend on it.
CACHE_ENTRIES = 600_000

# The vocabulary's own split pattern, with Unicode's White_Space as its space class.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space that doesn't start a new piece: another space or the end follows.
LOOSE_SPACE = regex.compile(r" (?=[\s\p{White_Space}]|$)")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class MergeCounter:
    """Counts tokens by pair merging: initial symbols minus merges."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        number: dict[str, int] = {}
        for symbol in byte_letters():
            number.setdefault(symbol, len(number))
        for x, y in pairs:
            number.setdefault(x + y, len(number))
        self.rank = {number[x] << 20 | number[y]: r for r, (x, y) in enumerate(pairs)}
        self.joined = [number[x + y] for x, y in pairs]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hint = special
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, int] = {}
        self.pieces = _Pieces(self)

    def word(self, word: str) -> int:
        """Tokens of one pre-token. The heap has rank and place of adjacent pairs, as one number; prev and next link the symbols left."""
        symbols: list[int] = list(word.encode())  # bytes are the first 256 symbols
        n = len(symbols)
        rank = self.rank.get
        if n == 2:
            return 2 if rank(symbols[0] << 20 | symbols[1]) is None else 1
        bits = n.bit_length()
        at = (1 << bits) - 1
        heap = [r << bits | i for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(x << 20 | y)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push, joined = heapq.heappop, heapq.heappush, self.joined
        nxt, prv, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            top = pop(heap)
            i, r = top & at, top >> bits
            j = nxt[i]
            if j < 0 or symbols[i] < 0 or rank(symbols[i] << 20 | symbols[j]) != r:
                continue  # one of the pair has merged otherwise meanwhile
            symbols[i], symbols[j] = both, _ = joined[r], -1
            merges += 1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (r := rank(both << 20 | symbols[k])) is not None:
                    push(heap, r << bits | i)
            if (h := prv[i]) >= 0 and (r := rank(symbols[h] << 20 | both)) is not None:
                push(heap, r << bits | h)
        return n - merges

    def exact(self, text: str) -> int:
        total, words = 0, self.words
        for w in self.split(text):
            if (n := words.get(w)) is None:
                n = self.word(w)
                if len(w) <= 64:
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    words[w] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Text without special strings. A space before a non-space always starts a pre-token, so texts are cut there."""
        if LOOSE_SPACE.search(text):
            return self.exact(text)
        first, *rest = text.split(" ")
        total = self.exact(first) + sum(map(self.pieces.__getitem__, rest))
        if len(self.pieces) >= CACHE_ENTRIES:
            self.pieces.clear()
        return total

    def text(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.hint):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


class _Pieces(dict):
    """Counts by what follows a space."""

    def __init__(self, counter: MergeCounter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        # Latin letters alone are one pre-token with the space
        n = self.counter.word(" " + piece) if piece.isalpha() and max(piece) < "\u0250" else self.counter.exact(" " + piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level pair-merging vocabulary that the driver can read
    (byte_bpe_50k.json if None); its bytes, of fixed size, go to the workers with the task.
    Texts are split as the vocabulary's own library does, special strings inside texts are one token each,
    nothing is truncated. Null texts count as empty: 0 bytes, 0 tokens. Rows keep their null ids and repeats;
    other columns are not read. An empty table gives an empty result.
    """
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = MergeCounter(spec.value)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    text = filled(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
