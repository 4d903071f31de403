"""Exact duplicates: sorted digest runs merged eight at a time in the rounds of a binomial tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import filled, written

#: Rounds of merges, and binary logarithm of the runs that meet in one: a round takes that many levels of the binomial tree at once. A leaf's run is what one scan
#: partition holds, or what several do.
ROUNDS, WAYS = 2, 3
#: What must agree for two texts to be one: SHA-256, the length and a second, independent hash.
KEY = ("text_sha256", "__bytes", "__check")


def leaf_runs(rows: DataFrame, keep: str) -> DataFrame:
    """(__node, KEY, keep_id, group_size): each leaf's run, one row per digest, which Spark sorts out before it shuffles."""
    best = F.max if keep == "largest" else F.min
    return rows.groupBy(F.col("__leaf").alias("__node"), *KEY).agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """One round: the runs of all nodes below one meet there, sorted by digest, and become its run.

    A node's run is dealt over tasks by digest, so no task gets a whole run. In the sorted order equal digests are neighbours, at most one
    from each run: the first has the id to keep, and their sizes are added.
    """
    order = F.col("keep_id").desc_nulls_last() if keep == "largest" else F.col("keep_id").asc_nulls_last()
    runs = runs.withColumn("__node", F.shiftright("__node", WAYS)).repartition("__node", "text_sha256").sortWithinPartitions("__node", *KEY, order)
    equal = Window.partitionBy("__node", *KEY).orderBy(order)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("__node", *KEY, "keep_id", F.row_number().over(equal).alias("__place"), F.sum("group_size").over(whole).alias("group_size"))
    return runs.filter("__place = 1").drop("__place")


def exact_groups(rows: DataFrame, keep: str = "largest") -> DataFrame:
    """(__leaf, KEY, keep_id, group_size): for every leaf and digest of ``rows`` (doc_id, KEY, __leaf) what holds in the whole table.

    Runs are merged eight by eight, round by round, up to the root; every merge retains the verified id of each digest. The root's run is
    then handed down to the leaves, so rows find their group by leaf and digest and a text that holds a third of all rows
    is dealt over all leaves.
    """
    leaves = written(leaf_runs(rows, keep), "runs")
    root = leaves
    for _ in range(ROUNDS):
        root = merged(root, keep)
    return leaves.select(F.col("__node").alias("__leaf"), *KEY).join(root.drop("__node"), list(KEY))


def digests(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Rows for ``exact_groups``, and ``more`` columns of ``docs``, written."""
    text = filled(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
        F.octet_length(text).alias("__bytes"),
        F.xxhash64(text).alias("__check"),
        F.pmod(F.spark_partition_id(), F.lit(1 << ROUNDS * WAYS)).alias("__leaf"),
        *more,
    )
    return written(rows, "digests")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null counts as the empty text, so null and empty texts form one group.
    Of a group the row with the largest (or smallest) id stays; rows with a null id stay only
    if no row of the group has an id. Rows that repeat the kept id are all marked as kept.
    Other columns of ``docs`` are not read. An empty table gives an empty result. No digest collides by chance: two
    texts count as one only if SHA-256, length and XXH64 all agree, which is checked wherever rows or runs meet.
    """
    rows = digests(docs, id_col, text_col)
    groups = exact_groups(rows, keep)
    return rows.join(groups, ["__leaf", *KEY]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_col): of each group of identical texts exactly one row, the one of the least ``row_col`` of those that ``exact_dedup`` keeps."""
    rows = digests(docs, id_col, text_col, row_col)
    kept = rows.join(exact_groups(rows), ["__leaf", *KEY]).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return kept.groupBy(*KEY).agg(F.min(row_col).alias(row_col)).select(row_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
