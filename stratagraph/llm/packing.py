"""Operator 1, best-fit packing: sum-of-squares packing of token sequences into bins of fixed capacity.

Each piece goes where the sum, over residual gaps, of the squared number of open bins with that gap becomes smallest;
ties go to the fullest bin, a new bin last. The rule is sequential, so pieces are dealt to packing groups of about
``group_tokens`` tokens each (their number follows the corpus) and every group is packed by itself, in the order of id
and piece. Rows of one id and length are counted first and told apart by a running number, so that an id that many rows
have is dealt to all groups. What a group wastes is its last open bins, a fixed number whatever the corpus.

Defined results: a document longer than the capacity is cut into full pieces, each a bin of its own, and a rest. Null and
empty texts have no tokens: one row with n_tokens 0 and no bin. A repeated row is packed once per occurrence. A null id
is an id like others. Columns besides id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import base, vocab

CAPACITY = 2048
GROUP_TOKENS = 1 << 26
COPIES = 1 << 16


def token_counts(docs: DataFrame, vocabulary: str = vocab.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens), one row per input row."""
    small = base.id_and_text(docs)
    vocab.ship(small.sparkSession, vocabulary)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vocab.batch_counts(b.column(1), vocabulary))], ["doc_id", "n_tokens"])

    return small.mapInArrow(count, f"doc_id {base.id_type(small)}, n_tokens bigint")


def place(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each size, in order."""
    twice = np.zeros(capacity + 1, np.int64)  # twice the number of open bins by level
    twice[capacity] = -1  # a bin that becomes full adds no square
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins, far = [], 0, np.int64(1) << 60
    for s in sizes:
        if s < capacity:
            here = twice[1 : capacity - s + 1]
            change = np.where(here > 0, twice[s + 1 :] - here + 2, far)
            k = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
            if k >= 0 and change[k] <= twice[s] + 1:
                h = k + 1
                b = open_bins[h].pop()
                twice[h] -= 2
            else:
                h, b, bins = 0, bins, bins + 1
            out.append((b, h))
            if h + s < capacity:
                open_bins[h + s].append(b)
                twice[h + s] += 2
        else:
            out.append((bins, 0))
            bins += 1
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, vocabulary: str = vocab.VOCABULARY) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, bin_id, bin_offset) for every piece of every document."""
    sized = base.written(token_counts(docs, vocabulary), "token-counts")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    upto = lambda n, of, kind="bigint": F.explode(F.sequence(F.lit(0).cast(kind), F.floor((n - 1) / of).cast(kind)))
    pieces = (
        sized.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n"))
        .select("doc_id", "n_tokens", "n", upto(F.col("n"), COPIES).alias("c"))  # in two steps, as one id may have a third of all rows
        .select("doc_id", "n_tokens", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(COPIES), F.col("n") - F.col("c") * COPIES) - 1)).alias("d"))
        .select("doc_id", "n_tokens", (F.col("c") * COPIES + F.col("d")).alias("copy"), upto(F.col("n_tokens"), capacity, "int").alias("piece"))
        .select("doc_id", "copy", "piece", (F.col("piece").cast("bigint") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece").cast("bigint") * capacity).alias("n_tokens"), F.col("n_tokens").alias("whole"))
        .withColumn("grp", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "piece", "whole", "copy"), F.lit(groups)))
    )
    kind = base.id_type(sized)

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("whole", "ascending"), ("copy", "ascending")])
        at = place(table.column("n_tokens").to_pylist(), capacity)
        first = table.column("grp")[0].as_py() << 32
        return table.drop_columns(["grp", "whole", "copy"]).append_column("bin_id", pa.array([first + b for b, _ in at], pa.int64())).append_column("bin_offset", pa.array([o for _, o in at], pa.int64()))

    packed = pieces.groupBy("grp").applyInArrow(group, f"doc_id {kind}, piece int, token_start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint")
    none = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("token_start"), "n_tokens", F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_offset"))
    return packed.unionByName(none)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(base.parquet(spark, sf_dir, "documents"))
