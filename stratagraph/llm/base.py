"""Session helpers that the operators share: the shared folder, side tables, and one-column input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.ship import ship
from stratagraph.tables import discard, kept, mark, shared_dir, written

__all__ = ["discard", "id_and_text", "id_type", "kept", "mark", "parquet", "sample_order", "shared_dir", "written"]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names; every other column, however named, stays out."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sample_order(*cols: str) -> Column:
    """A fixed pseudo-random order of rows, the same at every run and whatever the partitions."""
    return F.xxhash64(*[F.col(c).cast("string") for c in cols], F.lit("sample"))


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()
