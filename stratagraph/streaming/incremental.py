"""Analysis as files arrive: a stream of source files keeps the table of facts up to date, one version a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratagraph.operators import history
from stratagraph.sources import tree

FILES = "repo string, path string, language string, content string, version bigint"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Source files as a stream of Parquet files of FILES."""
    return spark.readStream.schema(FILES).parquet(folder)


def current(spark: SparkSession, state: str) -> DataFrame:
    """The latest facts of each path; batches that were written twice count once."""
    rows = spark.read.schema(tree.FACTS + ", version bigint, batch bigint").parquet(state)
    return history.latest(rows, ["repo", "path"], ["version", "batch"]).drop("version", "batch")


def start(files: DataFrame, state: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the facts of new and changed files to the state; a file whose hash is that of its last facts is not extracted again. A batch writes to a folder of its own number, so a repeat overwrites it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = history.with_hash(history.latest(batch, ["repo", "path"], ["version"]))
        if number:
            known = spark.read.schema("repo string, path string, sha256 string, version bigint, batch bigint").parquet(state).where(F.col("batch") < number)
            _, new = history.cache_split(new, history.latest(known, ["repo", "path"], ["version", "batch"]))
        found = tree.facts(new).join(new.select("repo", "path", "version"), ["repo", "path"])
        found.write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_trend(history_stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean overall score and number of snapshots per window of event time, for streams of history rows; later ones than the watermark are left out."""
    return history_stream.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.avg("result.score.overall").alias("overall"), F.count("*").alias("snapshots"))
