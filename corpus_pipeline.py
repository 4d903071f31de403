"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage takes any table with the columns of documents and leaves other columns as they are, whatever their names. Decisions are made on rows: ids may be
null or repeat, rows may be equal in every column, and an empty table stays empty. Null and empty texts and texts without a letter go with the first stage;
a later stage that gets them treats null as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, written
from gridloom.llm.exact_dedup import kept_rows
from gridloom.llm.language_id import UNDECIDED, identify, learn
from gridloom.llm.mixing import mix
from gridloom.llm.packing import pack
from gridloom.llm.simhash import repeated_rows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts and texts without a letter. lang becomes the predicted one. Repeated rows each stay; where
    no labelled text is there to learn from, no document has a language."""
    found = fresh(docs, "lang_found")
    rows = identify(docs, learn(docs), found).filter(F.col(found)["lang_pred"] != UNDECIDED)
    return rows.select(*[F.col(found)["lang_pred"].alias("lang") if c == "lang" else rows[c] for c in docs.columns])


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique key, written, and the key's name, which no column of ``docs`` has: ids may be null or repeat, so decisions are
    joined back by the key, which stays the same however often the table is read."""
    row = fresh(docs, "row_key")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of identical texts stays: the one of the largest id, of equal ones any; one without an id only where none of the group has one."""
    rows, row = keyed(docs)
    return rows.join(kept_rows(rows, row), row, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id stays, of equal ids one, without an id only where none has one; links are
    checked on whole texts (five words, 0.8)."""
    rows, row = keyed(docs)
    return rows.join(repeated_rows(rows, row), row, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes: a row comes as often as the mix takes it, three times at most. Rows without a source are a source of their own; rows
    of equal size rank by a hash of their id, so reruns agree."""
    rows, row = keyed(docs)
    times = fresh(rows, "times_taken")
    taken = mix(rows, row_col=row).filter("times > 0").select(row, F.col("times").alias(times))
    # the copies of a row are made without a column of their own
    mixed = rows.join(taken, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return mixed.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a document that the mix repeats is packed anew each time, and pieces of rows without an id have none."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Merged tokens, fingerprints and patterns are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
