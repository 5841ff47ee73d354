"""What several text operators share: table reading, the shared folder, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts in one Arrow batch; with texts of a megabyte a batch stays within some hundred MB.
TEXT_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The session of a frame, with Arrow batches small enough for whole texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one
    machine (tests). A cluster without it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pitframe-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: its lineage ends there, and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frequent(counted: DataFrame, key: str, n: str) -> DataFrame:
    """Keys that hold more than 1 / (4 * partitions) of all rows: fewer than 4 * partitions, whatever the input."""
    parts = 4 * partitions(counted.sparkSession)
    total = counted.agg(F.sum(n).alias("_total"))
    return counted.crossJoin(F.broadcast(total)).filter((F.col(n) > 1) & (F.col(n) * parts > F.col("_total"))).select(F.col(key).alias("_frequent"))


def join_unique(rows: DataFrame, unique: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Inner join of rows with a frame that holds each key once; rows of the keys in ``keys`` (of bounded number, see
    ``frequent``) are dealt over all tasks, and what is joined to them is repeated in each."""
    parts = partitions(rows.sparkSession)
    few = F.broadcast(keys)
    dealt = rows.join(few, rows[key] == few["_frequent"], "left").withColumn("_part", F.when(F.col("_frequent").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(F.lit(0)).cast("int")).drop("_frequent")
    copies = unique.join(few, unique[key] == few["_frequent"], "left").withColumn("_part", F.explode(F.when(F.col("_frequent").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_frequent")
    return dealt.join(copies, [key, "_part"]).drop("_part")
