"""Helpers shared by the text operators: scratch tables, documents, spread running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Number of hash slices that a hot key is dealt over when rows are ranked inside it.
SLICES = 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode a temporary one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, nothing is lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """While jobs run inside, Arrow batches to Python workers hold at most ``size``: a worker's memory doesn't follow the texts' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with more underscores that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filled(text_col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def id_order(id_col: str) -> Column:
    """A non-null long in place of the id, null first."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def document_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, sub, text) of ``docs``: (doc, sub) names a document, and only rows equal in id and text have the same.

    ``doc`` is the id in order, null first; ``sub`` tells the texts of one id apart by hash. While each id has one text, that is only
    needed for null ids, and 0 otherwise, which packs well; the order of documents of different ids is by ``doc`` either way.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), id_order(id_col).alias("doc"), filled(text_col).alias("text"))
    texts = rows.filter("doc_id is not null").groupBy("doc").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    plain = texts.filter("a != b").isEmpty()
    # null ids share the least long with an id of that value: a hash of 0 is the latter's only by chance
    sub = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")) if plain else F.xxhash64("text", "doc_id")
    return rows.select("doc_id", "doc", sub.alias("sub"), "text")


def spread_cumsum(df: DataFrame, keys: Sequence[str], weight: Column | None, out: str, order: Sequence[str], hashed: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (rows, if None) over the rows that come before within ``keys``.

    Rows are ordered by slice of the long column ``hashed``, then ``hashed``, then ``order``.
    Each slice is summed on its own and slices get the total of those before them,
    so a key that holds a third of all rows is spread over ``SLICES`` tasks.
    """
    w = F.lit(1) if weight is None else weight
    df = df.withColumns({"__slice": F.pmod(F.col(hashed), F.lit(SLICES)).cast("int"), "__w": w.cast("long")})
    sums = df.groupBy(*keys, "__slice").agg(F.sum("__w").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__s"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    on = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(hashed, *order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    return df.join(sums, on).withColumn(out, F.col("__in") + F.col("__before")).drop("__slice", "__w", "__s", "__before", "__in", *[f"__k{i}" for i in range(len(keys))])
