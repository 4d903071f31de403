"""Language by prediction with partial matching: the language whose frozen byte context tree codes a text shortest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longest context in bytes.
ORDER = 3
#: Bound of the labelled sample that the trees are learnt from: documents of a language, and bytes of one document.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 16_384
UNDECIDED = "und"


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: int) -> DataFrame:
    """Up to SAMPLE_DOCS labelled documents of each language outside the held-out fold, chosen by a hash of the id."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % fold != 0) & (F.octet_length(text_col) <= SAMPLE_BYTES))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h"), F.xxhash64(text_col).alias("t"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # about twice the sample passes the threshold, so what is ranked exactly stays small
    near = rows.join(F.broadcast(counts), "lang").filter(F.pmod("h", F.lit(1 << 20)) * F.col("n") <= F.lit((2 * SAMPLE_DOCS + 100) << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    return near.withColumn("r", rank).filter(F.col("r") <= SAMPLE_DOCS).select("lang", "text")


def tree_counts(texts: list[str]) -> list[Counter]:
    """Per context length 0..ORDER: how often each context with its next byte occurs, as big-endian numbers."""
    out = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        codes = grams(t)
        for k in range(ORDER + 1):
            values, n = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_counts=True)
            out[k].update(dict(zip(values.tolist(), n.tolist(), strict=True)))
    return out


def grams(text: str) -> np.ndarray:
    """Every byte of the lower-cased text with the ORDER bytes before it (zeros before the start)."""
    b = np.frombuffer(b"\0" * ORDER + text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


class Table:
    """Exact lookup of 32-bit keys by vectors, -1 where absent: an open-addressed table that is probed until found or empty."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint32)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys))
        slot = self.slots(keys)
        while len(left):
            free = self.at[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.at[slot[won]] = left[won]
            self.keys[slot[won]] = keys[left[won]]
            rest = np.ones(len(left), dtype=bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        found = self.at[slot]
        miss = np.flatnonzero((self.keys[slot] != keys) & (found >= 0))
        found[miss] = -1
        at, keys = slot[miss], keys[miss]
        while len(miss):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.at[at]
            hit = (got >= 0) & (self.keys[at] == keys)
            found[miss[hit]] = got[hit]
            go = (got >= 0) & ~hit
            miss, at, keys = miss[go], at[go], keys[go]
        return found


class Trees:
    """Frozen code lengths in bits: costs of each context with a byte, and of leaving each context, by language."""

    def __init__(self, counts: dict[str, list[Counter]]) -> None:
        self.langs = sorted(counts)
        n = len(self.langs)
        self.bytes = np.full((256, n), 8.0)  # order -1: all bytes alike
        self.seen, self.left = [], []
        for k in range(ORDER + 1):
            keys = np.array(sorted(set().union(*(counts[x][k] for x in self.langs))), dtype=np.uint32)
            contexts = np.unique(keys >> np.uint32(8))
            own, out = np.zeros((len(keys), n)), np.zeros((len(contexts), n))
            ctx = np.searchsorted(contexts, keys >> np.uint32(8))
            shorter = self.cost(keys, k - 1)
            for j, x in enumerate(self.langs):
                c = np.array([counts[x][k].get(q, 0) for q in keys.tolist()], dtype=float)
                total = np.bincount(ctx, c, minlength=len(contexts))
                kinds = np.bincount(ctx, c > 0, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[:, j] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                    own[:, j] = np.where(c > 0, -np.log2(c / (total + kinds)[ctx]), out[ctx, j] + shorter[:, j])
            self.seen.append((Table(keys), own))
            self.left.append((Table(contexts), out))

    def cost(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Bits of each position (rows) in each language (columns), from contexts of ``order`` bytes downwards."""
        if order < 0:
            return self.bytes[codes & np.uint32(255)]
        keys = codes if order == 3 else codes & np.uint32((1 << 8 * (order + 1)) - 1)
        table, own = self.seen[order]
        at = table.find(keys)
        cost = own[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            contexts, out = self.left[order]
            where = contexts.find(keys[miss] >> np.uint32(8))
            cost[miss] = np.where((where >= 0)[:, None], out[where], 0) + self.cost(codes[miss], order - 1)
        return cost

    def bits(self, text: str) -> np.ndarray:
        codes = grams(text)
        return sum((self.cost(codes[i : i + 65536], ORDER).sum(axis=0) for i in range(0, len(codes), 65536)), np.zeros(len(self.langs)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNDECIDED, 0.0
        bits = self.bits(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5) -> Trees:
    """Trees from the bounded sample. Each language's tree is counted in its own task; the driver gets the frozen counts,
    whose number SAMPLE_DOCS and SAMPLE_BYTES bound for each language."""

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        lang = frame["lang"].iloc[0]
        trees = tree_counts(frame["text"].tolist())
        return pd.DataFrame([(lang, k, q, n) for k, tree in enumerate(trees) for q, n in tree.items()], columns=["lang", "k", "q", "n"])

    rows = sampled(docs, id_col, text_col, lang_col, fold).groupBy("lang").applyInPandas(counted, "lang string, k int, q long, n long").toPandas()
    counts: dict[str, list[Counter]] = {}
    for (lang, k), part in rows.groupby(["lang", "k"]):
        counts.setdefault(lang, [Counter() for _ in range(ORDER + 1)])[k] = Counter(dict(zip(part["q"].tolist(), part["n"].tolist(), strict=True)))
    return Trees(counts)


def identify(docs: DataFrame, trees: Trees, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``out`` of lang_pred and score (the share of the best language if each is weighed by 2**-bits); ``out`` must be
    no column of ``docs``, whose columns all stay."""
    frozen = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([frozen.value.predict(t) for t in texts], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    once = predict.asNondeterministic()  # else a filter on the prediction computes it twice
    return docs.select("*", once(F.col(text_col)).alias(out))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 5) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Trees are learnt from text and non-null language of rows whose crc32(id as text) mod ``fold`` is not 0
    (a null id counts as the empty text: held out). Texts that are null or have no letter are "und" with score 0;
    so are all texts where nothing could be learnt. Whole texts are scored, lower-cased, as UTF-8 bytes.
    Ties go to the language first in code point order. Rows repeat as given; other columns are not read.
    """
    trees = learn(docs, id_col, text_col, lang_col, fold)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % fold == 0).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, trees, "lang").select("doc_id", "held_out", "lang.lang_pred", "lang.score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; a fifth is held out of learning."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
