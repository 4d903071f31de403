"""Mixing sources to target weights: budgets fitted by bounded-knapsack dynamic programming over document lengths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import filled, spread_cumsum, written

WORD = r"[^\x20\x09-\x0D]+"


def target_sizes(sizes: Sequence[int], weights: Sequence[float], limit: float) -> list[float]:
    """Shares of the whole size by weight; what exceeds ``limit`` times a source's size is shared anew among the others."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > limit * sizes[i]}
        for i in above or open_:
            targets[i] = float(limit * sizes[i]) if above else left * weights[i] / total
        if not above:
            break
        left -= sum(targets[i] for i in above)
        open_ -= above
    return targets


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to the budget from below.

    First the same share of every length is taken; the rest of the budget is filled longest first down to less than
    twice the longest document; what then remains is a subset-sum problem over the documents left, solved exactly
    by dynamic programming. Its table has a few bytes for each word of the longest document, so it takes no more memory than that
    document's text does.
    """
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    taken = np.array([c * budget // total for c in counts.tolist()], dtype=np.int64)  # Python's whole numbers can't overflow
    rest = budget - int(lengths @ taken)
    order = np.argsort(-lengths)
    for i in order.tolist():  # keeps a longest document's worth for the dynamic program
        n = min(int(counts[i] - taken[i]), max(0, rest - int(lengths[order[0]])) // int(lengths[i]))
        taken[i] += n
        rest -= n * int(lengths[i])
    room = min(rest, int(lengths @ (counts - taken)))
    reached = np.zeros(room + 1, dtype=bool)
    reached[0] = True
    by = np.full(room + 1, -1, dtype=np.int32)
    pieces: list[tuple[int, int, int]] = []
    for i in order[::-1].tolist():  # short ones first: they reach the most sums soonest
        width, n, k = int(lengths[i]), min(int(counts[i] - taken[i]), rest // int(lengths[i])), 1
        while n > 0 and not reached[room]:  # k, 2 k, 4 k ... and what is left of the bound
            k = min(k, n)
            if (w := k * width) <= room:
                new = reached[:-w] & ~reached[w:]
                by[w:][new] = len(pieces)
                reached[w:] |= new
                pieces.append((i, k, w))
            n -= k
            k *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k, w = pieces[by[at]]
        taken[i] += k
        at -= w
    return taken


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), limit: int = 3, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, times (copies of it in the mix).

    Sources in code point order, null last, take ``weights`` in turn and share the size of all documents by them; no
    target exceeds ``limit`` times its source's size. A source takes whole copies of all its documents while they fit,
    and for the remaining budget a number of documents of each length, fitted by ``fit``; which ones, a seeded hash of the id
    decides. So a document is taken at most ``limit`` times. Null texts are empty and have size 0; sources without a word have
    target 0. The driver gets one row per source, and each source's histogram of lengths is fitted in its own task.
    Rows that repeat count anew; null ids are ranked like others; other columns are not read. ``row_col``,
    if given, names a column of unique keys that the result has too.
    """
    key = [row_col] if row_col else []
    rows = docs.select(*key, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(filled(text_col), F.lit(WORD)).cast("long").alias("size"))
    rows = written(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sources.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    targets = target_sizes([r.n for r in sources], [weights[i % len(weights)] for i in range(len(sources))], limit)
    plan = []
    for r, t in zip(sources, targets, strict=True):
        copies = min(limit, int(round(t)) // r.n) if r.n else 0
        plan.append((r.source, r.n, t, copies, int(round(t)) - copies * r.n if r.n else 0))
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "__source string, source_size long, target double, copies long, budget long"))
    here = F.col("source").eqNullSafe(F.col("__source"))

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        extra = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), int(frame["budget"].iloc[0]))
        return pd.DataFrame({"source": frame["source"], "size": frame["size"], "extra": extra})

    lengths = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).join(plan, here).select("source", "size", "n", "budget")
    extra = lengths.groupBy("source").applyInPandas(fitted, "source string, size long, extra long").select(F.col("source").alias("__s"), F.col("size").alias("__n"), "extra")
    ranked = spread_cumsum(rows, ["source", "size"], None, "rank", ["doc_id", *key], "h")
    ranked = ranked.join(extra, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__n")), "left")
    times = F.col("copies") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    return ranked.join(plan, here).select(*key, "doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all documents by source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
