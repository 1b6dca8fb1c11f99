"""Operator 3, token-id output: raw id payloads in shards, each with a minimal perfect hash index over its keys.

A document's shard follows from the hash of its key, so access by key is: hash, shard, bucket seed, slot, fingerprint,
then one slice of the payload, whatever the size of the corpus. Ids are little-endian, two bytes wide if the vocabulary
has at most 65,536 ids, else four. Slots hold no keys but 32-bit fingerprints: an absent key is told from a present one
but for one case in 2**32. Payloads lie in the order of slots. A written index (write, Index) has its shards in order in
folders of ``FOLDER`` shards; a lookup names folder and shard as literals, so that it reads one row group of one file.

Defined results: a null or empty text has an entry of length 0. A null key is a key like others. A repeated row is
stored once; further texts under the same key are entries of their own, ordinals 0, 1, ... in the order of their hashes.
Each run of ``RUN`` ordinals of a key has a shard of its own, so a key that a third of all rows have fills no one shard.
Columns besides id and text are not read. An empty table gives no shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.llm import base, vocab
from stratagraph.llm.textbytes import mix

SHARD_BYTES = 4 << 20
RUN = 512
FOLDER = 1024
TASK_SHARDS = 64
U = np.uint64
SCHEMA = "shard bigint, n_shards bigint, n_keys bigint, n_tokens bigint, width int, seeds binary, fingerprints binary, offsets binary, payload binary"


def key_hash(key) -> int:
    """As Spark's xxhash64 of the key as a string; a null key has the seed itself."""
    return 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)


def entry_hash(h: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    return mix(h + (ordinal.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))


def shard_of(h: int, ordinal: int, n_shards: int) -> int:
    """The shard of a key's entry, as placed() has it."""
    run = ordinal // RUN
    h = h if not run else int(entry_hash(np.array([h], U), np.array([run]))[0])
    return (h - (1 << 64) if h >= 1 << 63 else h) % n_shards


def slots_of(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ (seeds.astype(U) * U(0xD6E8FEB86659FD93))) % U(n)).astype(np.int64)


def perfect(h: np.ndarray) -> np.ndarray:
    """Bucket seeds that send n distinct hashes to the slots 0..n-1 without a collision (hash and displace)."""
    n = len(h)
    m = max(1, -(-n // 4))
    bucket = ((h >> U(32)) % U(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(bucket[order], np.arange(m + 1))
    seeds, taken = np.zeros(m, np.uint32), np.zeros(n, bool)
    for b in np.argsort(-np.diff(first), kind="stable").tolist():
        own = h[order[first[b] : first[b + 1]]]
        if not len(own):
            break
        start = 0
        while True:
            tried = np.arange(start, start + 64)
            at = slots_of(own[None, :], tried[:, None], n)
            ok = ~taken[at].any(axis=1)
            if len(own) > 1 and ok.any():
                x = np.sort(at, axis=1)
                ok &= (x[:, 1:] != x[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                seeds[b] = tried[k]
                taken[at[k]] = True
                break
            start += 64
    return seeds


def shard_row(shard: int, n_shards: int, hashes: np.ndarray, ordinals: np.ndarray, payloads: list[bytes], width: int) -> dict:
    """One shard from its rows' key hashes, ordinals and payloads; equal entries are one."""
    e, keep = np.unique(entry_hash(hashes, ordinals), return_index=True)
    seeds = perfect(e)
    slot = slots_of(e, seeds[((e >> U(32)) % U(len(seeds))).astype(np.int64)], len(e))
    by_slot = np.empty(len(e), np.int64)
    by_slot[slot] = np.arange(len(e))
    ordered = [payloads[k] for k in keep[by_slot].tolist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in ordered])]).astype("<i8")
    return {
        "shard": shard, "n_shards": n_shards, "n_keys": len(e), "n_tokens": int(offsets[-1]) // width, "width": width, "seeds": seeds.astype("<u4").tobytes(),
        "fingerprints": (mix(e) & U(0xFFFFFFFF)).astype("<u4")[by_slot].tobytes(), "offsets": offsets.tobytes(), "payload": b"".join(ordered),
    }


class Shard:
    """Constant-time keyed access to one row of build()."""

    def __init__(self, row: Row | dict) -> None:
        row = row.asDict() if isinstance(row, Row) else row
        self.n, self.kind, self.payload = row["n_keys"], "<u2" if row["width"] == 2 else "<u4", row["payload"]
        self.seeds, self.fingerprints, self.offsets = np.frombuffer(row["seeds"], "<u4"), np.frombuffer(row["fingerprints"], "<u4"), np.frombuffer(row["offsets"], "<i8")

    def get(self, key, ordinal: int = 0) -> np.ndarray | None:
        e = entry_hash(np.array([key_hash(key)], U), np.array([ordinal]))
        slot = int(slots_of(e, self.seeds[((e >> U(32)) % U(len(self.seeds))).astype(np.int64)], self.n)[0])
        if self.fingerprints[slot] != int(mix(e)[0]) & 0xFFFFFFFF:
            return None
        return np.frombuffer(self.payload[self.offsets[slot] : self.offsets[slot + 1]], self.kind)


class Index:
    """A written index. The number of shards is read once; a lookup reads one shard, by literal filters."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.shards = spark.read.parquet(path)
        head = self.shards.select("n_shards").take(1)
        self.n_shards = head[0][0] if head else 0

    def shard(self, n: int) -> DataFrame:
        return self.shards.where((F.col("folder") == n // FOLDER) & (F.col("shard") == n))

    def get(self, key, ordinal: int = 0) -> np.ndarray | None:
        """The ids under a key, None if there are none."""
        if not self.n_shards:
            return None
        rows = self.shard(shard_of(key_hash(key), ordinal, self.n_shards)).take(1)
        return Shard(rows[0]).get(key, ordinal) if rows else None


def write(docs: DataFrame, path: str, **how) -> None:
    """build() as Parquet: shards in order, in folders of FOLDER shards, small row groups."""
    rows = build(docs, **how).withColumn("folder", F.expr(f"shard div {FOLDER}"))
    rows.sortWithinPartitions("folder", "shard").write.option("parquet.block.size", 8 << 20).partitionBy("folder").parquet(path)


def ordinals(keyed: DataFrame) -> DataFrame | None:
    """(key, th, ordinal) for the keys that have several texts, in the order of the texts' hashes; None if no key has. keyed: (key, th). Rows are ranged by (key, th), so a key of many texts is spread; what each partition says of its keys, a row for its first and last one, gives the others their start."""
    texts = keyed.groupBy("key", "th").agg(F.lit(1).alias("one"))
    several = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return None
    some = texts.join(several.select("key"), "key").select("key", "th")

    def rank(batches):
        last, n = None, 0
        for b in batches:
            key = b.column(0).to_numpy()
            new = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(new)
            own = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
            if len(key):
                if key[0] == last:
                    own[: start[1] if len(start) > 1 else len(key)] += n
                last, n = key[-1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], ["key", "th", "k"])

    ranked = some.repartitionByRange("key", "th").sortWithinPartitions("key", "th").mapInArrow(rank, "key bigint, th bigint, k bigint").withColumn("part", F.spark_partition_id())
    ranked = base.written(ranked, "ordinals")
    sizes = ranked.groupBy("key", "part").agg(F.count("*").alias("n"))
    over = sizes.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")  # keys that cross partitions: at most one a partition
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(over, "key").select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(starts, ["key", "part"], "left").select("key", "th", (F.col("k") + F.coalesce("start", F.lit(0))).alias("ordinal"))


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES, vocabulary: str = vocab.VOCABULARY) -> DataFrame:
    """One row per shard, of about shard_bytes bytes of text each: SCHEMA. A task makes the shards of one residue, TASK_SHARDS at most, one after the other."""
    small = base.id_and_text(docs)
    vocab.ship(small.sparkSession, vocabulary)
    total = small.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    tasks = min(n, max(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_SHARDS)))

    def encode(batches):
        width = 2 if vocab.encoding(vocabulary).n_vocab <= 1 << 16 else 4
        for b in batches:
            ids, off = vocab.batch_ids(b.column(2), vocabulary)
            raw = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
            values = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((off * width).astype("<i8").tobytes()), raw]).cast(pa.binary())
            key, ordinal = b.column(0).to_numpy(), b.column(1).to_numpy()
            h = np.where(ordinal < RUN, key.view(U), entry_hash(key.view(U), ordinal // RUN)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((h % n).astype(np.int32)), b.column(0), b.column(1), values, pa.array([width] * b.num_rows, pa.int32())], ["shard", "key", "ordinal", "ids", "width"])

    def shard(table: pa.Table) -> pa.Table:
        row = shard_row(table.column("shard")[0].as_py(), n, table.column("key").to_numpy().view(U), table.column("ordinal").to_numpy(), table.column("ids").to_pylist(), table.column("width")[0].as_py())
        kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 4
        return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    keyed = small.select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    several = ordinals(keyed.select("key", "th"))
    numbered = keyed.withColumn("ordinal", F.lit(0).cast("bigint")) if several is None else keyed.join(several, ["key", "th"], "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(0).cast("bigint")))
    rows = numbered.select("key", "ordinal", "text").mapInArrow(encode, "shard int, key bigint, ordinal bigint, ids binary, width int")
    return rows.repartitionById(tasks, "shard").groupBy("shard").applyInArrow(shard, SCHEMA)


def op3_token_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(base.parquet(spark, sf_dir, "documents"))
