"""Operator 8, sharding: contiguous shards of equal byte size, from global prefix sums.

Documents are ordered by id, then by size, then by their place in the input. They are range-partitioned in that order, so
that an id that many rows have is spread; each partition adds up its bytes in one pass; the partitions' totals, one row
each, give every partition its global start. A document belongs to the shard in whose byte range it starts, so shards are
runs of the order and differ from the target by less than one document. write() does the same with the whole rows.

Defined results: a null text has 0 bytes, a null id comes first, repeated ids or rows follow each other and each belongs
to the shard in which it starts. Documents of 0 bytes go with the next document's start byte. Columns besides id and text
are not read by assign(); write() passes all on, whatever their names (the folder column is ``shard``, with as many
underscores after it as it takes to be new). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagraph.llm import base
from stratagraph.ship import ship

TARGET_BYTES = 1 << 20


def _placed(rows: DataFrame, target_bytes: int) -> DataFrame:
    """rows (doc_id, n_bytes, more) with byte_start and shard."""
    ship(rows.sparkSession)
    rows = rows.withColumn("_r", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_bytes"), F.col("_r")]
    at = rows.columns.index("n_bytes")

    def add_up(batches):
        total = 0
        for b in batches:
            n = np.cumsum(b.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total + n - b.column(at).to_numpy())], [*b.schema.names, "before"])
            total += int(n[-1]) if len(n) else 0

    schema = T.StructType([*rows.schema.fields, T.StructField("before", T.LongType())])
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add_up, schema)
    ranged = base.written(ranged.withColumn("part", F.spark_partition_id()), "sizes")
    totals = ranged.groupBy("part").agg(F.sum("n_bytes").alias("part_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("part_start"), F.sum("part_bytes").over(Window.partitionBy()).alias("total"))
    shards = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / target_bytes))
    size = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / F.col("shards")))
    placed = ranged.join(starts, "part").withColumn("byte_start", F.col("part_start") + F.col("before")).withColumn("shards", shards).withColumn("size", size)
    return placed.withColumn("shard", F.least(F.expr("byte_start div size"), F.col("shards") - 1))


def _sized(docs: DataFrame, *more) -> DataFrame:
    return docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"), *more)


def assign(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, byte_start, shard): as many shards as the corpus has targets, at least one."""
    return _placed(_sized(docs), target_bytes).select("doc_id", "n_bytes", "byte_start", "shard")


def write(docs: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> str:
    """The documents themselves in the same shards, a folder each, in order; returns the folder column's name. The rows are shuffled once, by range, and written from their ranges."""
    name, taken = "shard", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    placed = _placed(_sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_row")), target_bytes)
    placed.sortWithinPartitions("shard", "byte_start").select("_row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name


def op8_prefix_sum_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(base.parquet(spark, sf_dir, "documents"))


ORACLE = f"""
WITH s AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, CAST(coalesce(sum(n_bytes) OVER (ORDER BY doc_id ASC NULLS FIRST, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start, sum(n_bytes) OVER () AS total FROM s),
t AS (SELECT *, greatest(1, CAST(ceil(total / {TARGET_BYTES}.0) AS BIGINT)) AS shards FROM p)
SELECT doc_id, n_bytes, byte_start, CAST(least(byte_start // greatest(1, CAST(ceil(total * 1.0 / shards) AS BIGINT)), shards - 1) AS BIGINT) AS shard FROM t
"""
