"""Session helpers of the analysis operators: the shared folder for checkpoints, and reading tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of side tables that are still there, in the order they were written.
_side: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see. Where it is unset, a folder of our own if all runs on this machine, as in tests; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="stratagraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: a side table that survives lost executors and cuts the plan. It stays until discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/side/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _side.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows that stand for n equal ones as rows that stand for most at the most, dealt evenly to tasks: few rows may stand for many. A fixed number of tasks, as what they make is far larger than what Spark would merge them by."""
    part, left = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {most}")), F.col("n") - F.col("_part") * most
    parts = rows.withColumn("_part", F.explode(part)).withColumn("n", F.least(F.lit(most).cast("bigint"), left))
    return parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *parts.columns).drop("_part")


def mark() -> int:
    """How many side tables there are; for discard()."""
    return len(_side)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the side tables written after a mark(), but for the last few. Results that still read them must have been written or collected."""
    jvm = spark.sparkContext._jvm
    gone = _side[max(0, since) : len(_side) - keep]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _side[max(0, since) : len(_side) - keep]


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
