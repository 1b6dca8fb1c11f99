"""Operator 5, near-duplicates: improved consistent weighted sampling of TF-IDF shingles, banded and verified.

A text is the weighted set of its runs of ``SHINGLE`` words; a weight is the count in the text times log(1 + N / df).
Document frequencies cover the whole corpus, in a hashed table of ``1 << DF_BITS`` counters: a counter is off by at most
the shingles that share it, on average (shingles per text) / (counters) of N at any corpus size. Each text gets
``BANDS * ROWS`` consistent weighted samples; texts with the same samples in a band are candidates; a candidate pair
counts if the weighted Jaccard similarity of the two sets, computed in full, is at least ``THRESHOLD``. Groups are the
connected components of the verified pairs.

Texts with the same words in the same order are one node throughout, so masses of exact copies never meet in a task.
Pairs are verified before anything is connected, in two steps. First each member of a bucket is compared with the
bucket's lowest node: a pair a member, joined with both texts and compared in Arrow batches, so that neither a hot bucket
nor a large component is ever in one task. What is near is connected. Then, in buckets that still hold several
components, every member outside the lowest node's component is compared with all members of other components, in blocks
of ``BLOCK`` bytes of text on either side: no candidate pair between components is left out. Pairs within a component
are not compared, they could not change it: a group of thousands costs its size, not its square.

Defined results: texts without a word (null, empty, punctuation only) are equal to nothing and stay. The lowest id of a
group stays (a null id before others, then the lowest text hash); of repeated rows one stays. n_links counts the verified
links of the row's text to others; copies of a text have the same links. Other columns are not read, by keep_one() passed
on as they are. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import base
from stratagraph.llm.textbytes import BASE, WINDOW, arrow_bytes, distinct_per_row, gram_hashes, mix, owner, windows, words

SHINGLE = 2
BANDS, ROWS = 10, 3
THRESHOLD = 0.6
DF_BITS = 21
BLOCK_BITS = 15
BLOCK = 1 << 21
U = np.uint64


def shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, their counts, the rows' first ones; and two hashes of each row's words in order."""
    _, _, h, first = words(data, off)
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    p = mix(place.astype(U))
    one, two = np.zeros(len(h) + 1, U), np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ p), out=one[1:])
    np.cumsum(mix(h * BASE + p), out=two[1:])
    content = [mix(x[first[1:]] - x[first[:-1]] + np.diff(first).astype(U)) for x in (one, two)]
    return *distinct_per_row(*gram_hashes(h, first, n)), *content


def gamma_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 2**16 even probabilities."""
    x = np.linspace(1e-7, 40, 2_000_001)
    p = 1 - (1 + x) * np.exp(-x)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), p, x).astype(np.float32)


_GAMMA = gamma_quantiles()
_INVERSE = (1 / _GAMMA).astype(np.float32)


def samples(g: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples of each row (rows without items: 0), as an array of rows by k."""
    rows = len(first) - 1
    out = np.zeros((rows, k), U)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    at, lw, low = first[some], np.log(weight).astype(np.float32), U(0xFFFF)
    for j in range(k):
        h = mix(g + U((2 * j + 1) * int(BASE) % (1 << 64)))
        a = (h & low).astype(np.int64)
        r = _GAMMA[a]
        beta = ((h >> U(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(lw * _INVERSE[a] + beta)
        value = _GAMMA[((h >> U(16)) & low).astype(np.int64)] * np.exp(-r * (t - beta + np.float32(1)))
        who = (h ^ (t.astype(np.int64).astype(U) * BASE)) >> U(32)
        out[some, j] = np.minimum.reduceat((value.view(np.uint32).astype(U) << U(32)) | who, at)
    return out


def document_frequencies(small: DataFrame, bits: int = DF_BITS) -> tuple[np.ndarray, int]:
    """The hashed table of document frequencies, and the number of texts with a word. Added up in two steps, so that no task gets more than about the root of the partitions' tables."""

    wide_bits = min(bits, BLOCK_BITS)

    def count(batches):
        table, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for _, _, data, off in windows(b.column(0)):
                g, _, first, _, _ = shingles(data, off)
                n += int((np.diff(first) > 0).sum())
                table += np.bincount((g >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        part = TaskContext.get().partitionId()
        if n:
            parts = table.astype(np.int32 if n < 1 << 31 else np.int64).reshape(-1, 1 << wide_bits)
            wide = [x.astype(np.int64).tobytes() for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(wide)), pa.int32()), pa.array([part] * len(wide), pa.int32()), pa.array([n] * len(wide), pa.int64()), pa.array(wide, pa.binary())], ["block", "part", "n", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts")], axis=0)
        cols = [table.column("block")[:1], table.column("part")[:1], pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["block", "part", "n", "counts"])

    schema = "block int, part int, n bigint, counts binary"
    partial = small.select("text").mapInArrow(count, schema)
    step = max(1, math.isqrt(max(1, small.rdd.getNumPartitions())))
    halfway = partial.groupBy("block", F.pmod("part", F.lit(step)).alias("_g")).applyInArrow(lambda t: add(t), schema)
    rows = halfway.groupBy("block").applyInArrow(lambda t: add(t), schema).collect()
    table = np.zeros((1 << (bits - wide_bits), 1 << wide_bits), np.int64)
    for r in rows:
        table[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return table.reshape(-1), rows[0]["n"] if rows else 0


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / np.maximum(df, 1)).astype(np.float32)


def weighted(data: np.ndarray, off: np.ndarray, idf: np.ndarray):
    """shingles() with weights in place of counts."""
    g, tf, first, one, two = shingles(data, off)
    return g, tf.astype(np.float32) * idf[(g >> U(65 - len(idf).bit_length())).astype(np.int64)], first, one, two


def signatures(small: DataFrame, idf, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, size, c1, c2, bands): per row the text's own hash and bytes, two hashes of its words, and one hash per band (null without words)."""

    def sign(batches):
        for b in batches:
            c1, c2, sig, some = [], [], [], []
            for _, _, data, off in windows(b.column(3)):
                g, w, first, one, two = weighted(data, off, idf.value)
                s = samples(g, w, first, bands * rows).reshape(-1, bands, rows)
                h = np.zeros(s.shape[:2], U)
                for k in range(rows):
                    h = mix(h * BASE + s[:, :, k])
                c1.append(one)
                c2.append(two)
                sig.append(h)
                some.append(np.diff(first) > 0)
            n = b.num_rows
            none = ~np.concatenate(some) if n else np.zeros(0, bool)
            flat = np.concatenate(sig).reshape(-1).view(np.int64) if n else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(flat), mask=pa.array(none))
            make = lambda x: pa.array(np.concatenate(x).view(np.int64) if n else np.zeros(0, np.int64), mask=none)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], make(c1), make(c2), lists], ["doc_id", "th", "size", "c1", "c2", "bands"])

    return small.select("doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").cast("bigint").alias("size"), "text").mapInArrow(sign, f"doc_id {base.id_type(small)}, th bigint, size bigint, c1 bigint, c2 bigint, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for edges (a, b): the lowest node that each node is connected with; lowest labels and pointer jumping, each round checkpointed."""
    both = base.kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = base.kept(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "node")
        lower = label.join(near, "node").select("node", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        jump = lower.select(F.col("node").alias("l"), F.col("l").alias("far"))
        new = base.kept(lower.join(jump, "l", "left").select("node", F.least("l", F.coalesce("far", "l")).alias("l"), "was"))
        if not new.where("l <> was").limit(1).count():
            return new.select("node", F.col("l").alias("comp"))
        label = new.select("node", "l")


def similarities(h: np.ndarray, w: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of one set with each of others; hashes ascend."""
    cat_h, cat_w = np.concatenate([x for x, _ in others]), np.concatenate([x for _, x in others])
    at = np.minimum(np.searchsorted(h, cat_h), len(h) - 1)
    common = np.where(h[at] == cat_h, np.minimum(w[at], cat_w), 0).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in others])[:-1]])
    inter = np.add.reduceat(common, first)
    return inter / (w.sum(dtype=np.float64) + np.add.reduceat(cat_w.astype(np.float64), first) - inter)


def pair_similarities(one: pa.Array, two: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in each row."""
    sizes = np.diff(arrow_bytes(one)[1]) + np.diff(arrow_bytes(two)[1])
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // WINDOW, prepend=0)) if len(sizes) else []
    out = [np.zeros(0)]
    for a, b in zip([0, *cut], [*cut, len(one)]):
        if a == b:
            continue
        g, w, row = [], [], []
        for column in (one, two):
            x, y, first, _, _ = weighted(*_local(column.slice(a, b - a)), idf)
            g.append(x)
            w.append(y.astype(np.float64))
            row.append(owner(first))
        g, w, row = np.concatenate(g), np.concatenate(w), np.concatenate(row)
        total = np.bincount(row, w, b - a)
        order = np.lexsort((g, row))
        g, w, row = g[order], w[order], row[order]
        same = np.flatnonzero((g[1:] == g[:-1]) & (row[1:] == row[:-1]))
        inter = np.bincount(row[same], np.minimum(w[same], w[same + 1]), b - a)
        out.append(inter / np.maximum(1e-12, total - inter))
    return np.concatenate(out)


def _local(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = arrow_bytes(column)
    return data[off[0] : off[-1]], off - off[0]


def cross(n: int, node: list[int], comp: list[int], apart: list[bool], bands: list[list[int]], band: int, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """The near pairs of one of the first n rows and one of the others, whose components differ and that share no band before the given one. Where both are apart from their bucket's lowest, the pair is met twice and compared once. What joins two components saves later comparisons between them."""
    up = {c: c for c in comp}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    found = []
    for x in range(n):
        todo = [y for y in range(n, len(node)) if comp[y] != comp[x] and not (apart[y] and node[y] < node[x]) and all(p != q for p, q in zip(bands[x][:band], bands[y][:band]))]
        for a in range(0, len(todo), 256):
            part = [y for y in todo[a : a + 256] if root(comp[y]) != root(comp[x])]
            if part:
                for k in np.flatnonzero(similarities(*sets[x], [sets[y] for y in part]) >= threshold).tolist():
                    found.append((x, part[k]))
                    p, q = sorted((root(comp[x]), root(comp[part[k]])))
                    up[q] = p
    return found


def near_stars(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """(a, b): members of buckets that are near the bucket's lowest node; one comparison a pair of nodes, however many buckets they share."""
    pairs = members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

    def verify(batches):
        for x in batches:
            yield x.filter(pa.array(pair_similarities(x.column(2), x.column(3), idf.value) >= threshold)).select(["a", "b"])

    return both.mapInArrow(verify, "a bigint, b bigint")


def near_rest(members: DataFrame, comp: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame | None:
    """(a, b): near pairs of different components that share a bucket; None if no bucket of three or more holds several components."""
    own = members.where("n > 2").join(comp, "node", "left").join(comp.select(F.col("node").alias("low"), F.col("comp").alias("top")), "low", "left")
    own = base.written(own.select("k", "v", "node", "size", F.coalesce("comp", "node").alias("comp"), F.coalesce("top", "low").alias("top")).withColumn("apart", F.expr("comp <> top")), "members")
    blocks = lambda x: F.greatest(F.lit(1).cast("bigint"), F.ceil(F.sum(x) / BLOCK))
    open_ones = own.groupBy("k", "v").agg(blocks(F.when(F.col("apart"), F.col("size"))).alias("n_some"), blocks("size").alias("n_all"), F.bool_or("apart").alias("any")).where("any").drop("any")
    if open_ones.isEmpty():
        return None
    rows = own.join(open_ones, ["k", "v"])
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    some = rows.where("apart").select("k", "v", block("n_some").alias("i"), each("n_all").alias("j"), "node", "comp", "apart", F.lit(True).alias("first"))
    every = rows.select("k", "v", each("n_some").alias("i"), block("n_all").alias("j"), "node", "comp", "apart", F.lit(False).alias("first"))
    full = some.unionByName(every).join(texts, "node")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "descending"), ("node", "ascending")]).combine_chunks()
        sets = []
        for _, _, data, off in windows(table.column("text").combine_chunks()):
            g, w, first, _, _ = weighted(data, off, idf.value)
            sets += [(g[a:b], w[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        node, comp, apart, bands = (table.column(c).to_pylist() for c in ("node", "comp", "apart", "bands"))
        found = cross(int(np.sum(table.column("first").to_numpy())), node, comp, apart, bands, table.column("k")[0].as_py(), sets, threshold)
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.int64()), "b": pa.array([node[y] for _, y in found], pa.int64())})

    return full.groupBy("k", "v", "i", "j").applyInArrow(verify, "a bigint, b bigint").distinct()


def clustered(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, df_bits: int = DF_BITS) -> tuple[DataFrame, DataFrame]:
    """groups() with a row number rid; and (rid, n_same) of the lowest of each set of rows with one id and text, if it has several."""
    small = base.id_and_text(docs)
    df, n = document_frequencies(small, df_bits)
    idf = small.sparkSession.sparkContext.broadcast(idf_table(df, n))
    sig = base.written(signatures(small, idf, bands, rows).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    worded = sig.where("c1 is not null")
    lowest = F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "th", "rid")
    nodes = base.written(worded.groupBy("c1", "c2").agg(F.min(lowest).alias("least"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("size").alias("size")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    bucket = nodes.select("node", "size", F.posexplode("bands").alias("k", "v"))
    sizes = bucket.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    members = base.written(bucket.join(sizes, ["k", "v"]), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "bands", F.col("least.doc_id").alias("d"), F.col("least.th").alias("t"))
    text = small.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = text.join(wanted.hint("shuffle_hash"), text["doc_id"].eqNullSafe(wanted["d"]) & (text["th"] == wanted["t"])).select("node", "bands", "text")
    same = worded.groupBy("doc_id", "th").agg(F.min("rid").alias("rid"), F.count("*").alias("n_same")).where("n_same > 1").select("rid", "n_same")
    texts = base.written(found if same.isEmpty() else found.groupBy("node").agg(F.first("bands").alias("bands"), F.first("text").alias("text")), "texts")
    near = base.written(near_stars(members, texts, idf, threshold), "near")
    comp = components(near)
    rest = near_rest(members, comp, texts, idf, threshold)
    if rest is not None:
        rest = base.written(rest, "rest")
        of = lambda c: F.coalesce(F.col(c), F.col(c[1:]))
        ends = rest.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("_a")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("_b")), "b", "left")
        joined = components(ends.select(of("_a").alias("a"), of("_b").alias("b")).where("a <> b"))
        comp = comp.union(joined.select("node", F.col("node").alias("comp"))).distinct()  # nodes that only the rest links are their own component so far
        comp = comp.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").groupBy("node").agg(F.min(F.coalesce("to", "comp")).alias("comp"))
        near = near.union(rest.select("a", "b"))
    links = near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = nodes.join(comp, "node").join(links, "node", "left")
    of_group = linked.groupBy("comp").agg(F.min("least").alias("least"), F.sum("n").alias("size"))
    linked = base.written(linked.drop("least", "n", "size").join(of_group, "comp").select("node", "least", "size", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")), "linked")
    whole = nodes.select("c1", "c2", "node", "least", "n").join(linked.select("node", F.col("least").alias("_l"), F.col("size").alias("_n"), "n_links"), "node", "left")
    whole = whole.select("c1", "c2", F.coalesce("_l", "least").alias("least"), F.coalesce("_n", "n").alias("group_size"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    grouped = worded.join(whole, ["c1", "c2"]).select("rid", "doc_id", "th", F.col("least.doc_id").alias("group_id"), "group_size", (F.col("rid") == F.col("least.rid")).alias("keep"), "n_links")
    alone = sig.where("c1 is null").select("rid", "doc_id", "th", F.col("doc_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"), F.lit(0).cast("bigint").alias("n_links"))
    return grouped.unionByName(alone), same


def groups(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, th, group_id, group_size, keep, n_links), one row per input row: the lowest id of the row's group, how many rows the group has, whether this row stays, and the text's verified links; th is xxhash64 of the text."""
    return clustered(docs, **how)[0].drop("rid")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without all but one of each group, with all their columns, which travel as one struct, so that their names are free."""
    found, same = clustered(docs, **how)
    stay = found.where("keep").join(same, "rid", "left").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.coalesce("n_same", F.lit(1).cast("bigint")).alias("n_same"))
    stay = base.written(stay.distinct(), "stay")
    rows = docs.select(docs["doc_id"].alias("_i"), F.xxhash64(docs["text"].cast("string")).alias("_h"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    out = rows.join(stay.hint("shuffle_hash"), rows["_i"].eqNullSafe(stay["_d"]) & (rows["_h"] == stay["_t"]))
    if stay.where("n_same > 1").isEmpty():
        return out.select("_row.*")
    once = out.where("n_same > 1").groupBy("_d", "_t").agg(F.first("_row").alias("_row"))
    return out.where("n_same = 1").select("_row").unionByName(once.select("_row")).select("_row.*")


def op5_weighted_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(base.parquet(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "keep", "n_links")
