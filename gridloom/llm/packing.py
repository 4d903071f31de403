"""Packing documents into sequences: cutting-stock patterns from column generation, gaps filled with documents that may be cut."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import filled, small_batches, spread_cumsum, written
from gridloom.llm.token_counts import byte_letters

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
LENGTH = 4096
#: One document in so many is not packed by pattern but cut into the gaps that patterns leave.
FILLERS = 16
#: Words from which a worker's cache is emptied before the next text; the ids don't depend on it.
CACHE_WORDS = 200_000
# Latin letters, then marks other than the apostrophe; neither can be part of a special string.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def length_class(n: int) -> int:
    """The length rounded up to five significant bits: exact up to 32, at most a sixteenth more beyond."""
    shift = max(0, (n - 1).bit_length() - 5)
    return -(-n >> shift) << shift


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming, multiples of an item in powers of two."""
    best, last, pieces = np.zeros(room + 1), np.full(room + 1, -1), []
    for i in np.flatnonzero(values > 1e-12).tolist():
        k = 1
        while (w := k * int(sizes[i])) <= room:
            with_it = best[:-w] + k * values[i]
            better = with_it > best[w:] + 1e-12
            best[w:][better] = with_it[better]
            last[w:][better] = len(pieces)
            pieces.append((i, k, w))
            k *= 2
    pattern, at = np.zeros(len(sizes)), room
    while last[at] >= 0:
        i, k, w = pieces[last[at]]
        pattern[i] += k
        at -= w
    return float(pattern @ values), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns with the number of times each is used, so that all demand is met.

    The linear program (least number of sequences, demand met) starts from one pattern per length. Each round prices
    patterns with the duals by ``knapsack`` and brings the best into the basis, until none saves anything.
    Uses are rounded down; what is left is packed first-fit decreasing, in further patterns.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse, cost = np.diag(1 / np.diag(columns)), np.ones(m)
    for _ in range(rounds):
        y = cost @ inverse
        if y.min() < -1e-9:  # more than the demand may be packed
            column, price = np.zeros(m), 0.0
            column[y.argmin()] = -1
        else:
            value, column = knapsack(sizes, y, room)
            price = 1.0
            if value <= 1 + 1e-6:
                break
        x, d = inverse @ demand, inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        columns[:, r], cost[r] = column, price
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
    uses = np.floor(np.maximum(inverse @ demand, 0) + 1e-6).astype(np.int64)
    out = [(columns[:, j].astype(np.int64), int(n)) for j, n in enumerate(uses) if n and cost[j]]
    left = demand.astype(np.int64) - sum((p * n for p, n in out), np.zeros(m, dtype=np.int64))
    left = np.maximum(left, 0)
    order = np.argsort(-sizes)
    while left.any():
        pattern, free = np.zeros(m, dtype=np.int64), room
        for i in order.tolist():
            pattern[i] = min(left[i], free // sizes[i])
            free -= pattern[i] * sizes[i]
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, n))
        left -= n * pattern
    return out


class Known(dict):
    """Words with their ids; a new one is encoded where it is asked for, so texts needn't be searched for new words before."""

    def __init__(self, encode: Callable[[bytes], bytes]) -> None:
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.encode(word)
        return ids


class WordIds:
    """A document's ids as little-endian bytes. White space always ends a word of this vocabulary, so words are encoded once.

    Latin letters and the marks after them are pieces of their own for the vocabulary: letters go to the library's
    merging model directly, in the stand-in letters of their bytes; all other words go through the whole library.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.merge = self.library.model.tokenize
        letters = byte_letters()
        self.stand_in = {ord(c): "".join(letters[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}
        self.words = Known(self.word)
        self.runs: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if not (plain := PLAIN(text.lower())):
            return self.whole(text)
        run, marks = plain.groups()
        runs = self.runs
        if (ids := runs.get(run)) is None:
            ids = runs[run] = array("I", [t.id for t in self.merge(run.translate(self.stand_in))]).tobytes()
        if not marks:
            return ids
        if (tail := runs.get(marks)) is None:
            tail = runs[marks] = self.whole(marks)
        return ids + tail

    def ids(self, text: str) -> bytes:
        data = text.encode()
        words = (data if b"<|" in data else data.lower()).split()  # special strings have their case
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        if len(self.runs) > CACHE_WORDS:
            self.runs.clear()
        return b"".join(map(known.__getitem__, words)) + END_ID.to_bytes(4, "little")


def tokenized(docs: DataFrame, vocabulary: str | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h, filler, doc_tokens, full_crcs (of each whole sequence), tail (tokens after them), tail_crc, tail_ids (fillers only)."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("doc_tokens long, full_crcs array<long>, tail_crc long, tail_ids binary")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = WordIds(spec.value)
        for texts, fillers in batches:
            rows = []
            for text, filler in zip(texts, fillers, strict=True):
                ids = words.ids(text)
                whole = len(ids) // (4 * LENGTH) * 4 * LENGTH
                rows.append((len(ids) // 4, [zlib.crc32(ids[i : i + 4 * LENGTH]) for i in range(0, whole, 4 * LENGTH)], zlib.crc32(ids[whole:]), ids[whole:] if filler else None))
            yield pd.DataFrame(rows, columns=["doc_tokens", "full_crcs", "tail_crc", "tail_ids"])

    text = filled(text_col)
    h = F.xxhash64(F.col(id_col), F.octet_length(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), h.alias("h"), (F.pmod(h, F.lit(FILLERS)) == 0).alias("filler"), text.alias("text"))
    rows = rows.select("doc_id", "h", "filler", encoded("text", "filler").alias("e")).select("doc_id", "h", "filler", "e.*")
    return rows.withColumn("tail", F.col("doc_tokens") % LENGTH)


def class_of(n: Column) -> Column:
    """``length_class`` of a column."""
    shift = F.greatest(F.lit(0), F.length(F.bin(n - 1)) - 5)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(n <= 32, n).otherwise(F.ceil(n / unit).cast("long") * unit)


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Joins intervals [from_a, to_a) and [from_b, to_b) of up to LENGTH that overlap: both are dealt by the blocks they touch."""

    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(lo) / LENGTH), F.floor((F.col(hi) - 1) / LENGTH))))

    lo, hi = F.greatest("from_a", "from_b"), F.least("to_a", "to_b")
    return dealt(a, "from_a", "to_a").join(dealt(b, "from_b", "to_b"), "block").filter((lo < hi) & (F.col("block") == F.floor(lo / LENGTH))).withColumns({"lo": lo, "hi": hi})


def pack(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's by the ``vocabulary`` (word_bpe_49k.json if None) and one end id; null texts are empty: the end id
    alone. Whole sequences of LENGTH ids are cut from a document's start. What is left of it, its tail, is packed uncut:
    the histogram of rounded tail lengths (144 classes at most) gives a cutting-stock problem, whose patterns are
    assigned to the documents ranked inside their class. The tails of one document in FILLERS are laid end to end and cut
    into the gaps that patterns leave, and beyond these into whole sequences; the last ones are cut to powers of two,
    which need no padding. Ids may be null or repeat: every row is packed. Other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        rows = written(tokenized(docs, vocabulary, id_col, text_col), "tokens")
    whole = rows.filter(F.size("full_crcs") > 0)
    whole = spread_cumsum(whole, [], F.size("full_crcs"), "base", ["doc_id"], "h").select("doc_id", "doc_tokens", "base", F.posexplode("full_crcs").alias("k", "ids_crc32"))
    whole = whole.select("doc_id", (F.col("k") * LENGTH).cast("long").alias("start"), F.lit(LENGTH).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    tails = rows.filter("tail > 0").withColumns({"start": F.col("doc_tokens") - F.col("tail"), "class": class_of(F.col("tail"))})
    first, demand = rows.agg(F.coalesce(F.sum(F.size("full_crcs")), F.lit(0))).first()[0], tails.filter("not filler").groupBy("class").count().orderBy("class").collect()
    slots, sequences = [], 0
    used = dict.fromkeys([r["class"] for r in demand], 0)
    if demand:
        sizes = np.array([r["class"] for r in demand])
        for pattern, n in cutting_stock(sizes, np.array([r["count"] for r in demand], dtype=float), LENGTH):
            for size, a in zip(sizes.tolist(), pattern.tolist(), strict=True):
                if a:
                    slots.append((size, used[size], used[size] + a * n, a, first + sequences))
                    used[size] += a * n
            sequences += n
    # a few rows for each class and pattern: both are bounded by the number of classes
    slots = F.broadcast(spark.createDataFrame(slots, "of long, slot_from long, slot_to long, each long, seq long"))
    ranked = spread_cumsum(tails.filter("not filler").select("doc_id", "h", "doc_tokens", "start", "tail", "tail_crc", "class"), ["class"], None, "rank", ["doc_id"], "h")
    placed = ranked.join(slots, (F.col("class") == F.col("of")) & (F.col("rank") >= F.col("slot_from")) & (F.col("rank") < F.col("slot_to")))
    placed = placed.withColumn("sequence_id", F.col("seq") + F.floor((F.col("rank") - F.col("slot_from")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = written(placed.select("doc_id", "start", F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(F.sum("tail").over(before), F.lit(0)).alias("offset")), "placed")

    fill = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumns({"gap": F.lit(LENGTH) - F.col("used"), "h": F.xxhash64("sequence_id")}).filter("gap > 0")
    fillers = tails.filter("filler").select("doc_id", "h", "doc_tokens", "start", "tail", "tail_ids")
    gap, cut = fill.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0], fillers.agg(F.coalesce(F.sum("tail"), F.lit(0))).first()[0]
    fill = spread_cumsum(fill, [], F.col("gap"), "from_b", ["sequence_id"], "h").select("sequence_id", F.col("used").alias("at"), "from_b", (F.col("from_b") + F.col("gap")).alias("to_b"))
    over = max(0, cut - gap)
    new = first + sequences
    more = spark.range(over // LENGTH).select((F.lit(new) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("at"), (F.lit(gap) + F.col("id") * LENGTH).alias("from_b"), (F.lit(gap) + (F.col("id") + 1) * LENGTH).alias("to_b"))
    last, at, ends = over % LENGTH, gap + over // LENGTH * LENGTH, []
    for bit in reversed(range(LENGTH.bit_length())):
        if last >> bit & 1:
            ends.append((new + over // LENGTH + len(ends), 0, at, at + (1 << bit)))
            at += 1 << bit
    fill = fill.union(more).union(spark.createDataFrame(ends, "sequence_id long, at long, from_b long, to_b long"))
    fillers = spread_cumsum(fillers, [], F.col("tail"), "from_a", ["doc_id"], "h").withColumn("to_a", F.col("from_a") + F.col("tail"))
    own, n = F.col("lo") - F.col("from_a"), F.col("hi") - F.col("lo")
    filled_in = overlaps(fillers, fill).select(
        "doc_id",
        (F.col("start") + own).alias("start"),
        n.alias("length"),
        F.crc32(F.substring(F.col("tail_ids"), (own * 4 + 1).cast("int"), (n * 4).cast("int"))).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        (F.col("at") + F.col("lo") - F.col("from_b")).alias("offset"),
    )
    return whole.union(placed).union(filled_in)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
