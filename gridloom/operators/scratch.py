"""Tables written between the rounds of an iteration: plans stay short, and nothing is lost or computed anew with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where it may be unset, one that goes when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="rounds-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame, i: int = 0) -> DataFrame:
    """``df`` written and read back; ``i`` tells rounds apart by name."""
    path = f"{shared_folder(df.sparkSession)}/round-{i}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame, each: int = 5_000) -> DataFrame:
    """``df`` over as many tasks as give each about ``each`` rows: for work per row that is dear where the rows themselves are few bytes, so that a file is one task."""
    return df.repartition(max(1, -(-df.count() // each)))
