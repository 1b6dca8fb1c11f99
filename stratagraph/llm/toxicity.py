"""Operator 9, toxicity: a lexicon induced from labelled seed terms by random walks over a word graph.

Labelled documents that are near copies of each other (equal bands of MinHash values of their word sets) form a family;
a document counts as one part of its family, so that a text copied a thousand times is one witness. Seeds are the words
whose counts in labelled toxic and clean families differ most clearly (likelihood ratio). Nodes are the seeds and all
words of the corpus, labelled or not, that have an edge to a toxic seed, stand near toxic seeds in ``MIN_CONTEXTS``
different contexts (equal contexts are copies) and may count: labels or the corpus say that they lean to toxic. A word
does if it is in at least ``MIN_SUPPORT`` toxic families and in more of them than of clean ones, or if at least
``MIN_NEAR`` of its occurrences are near a toxic seed and labels don't speak against it, and if in either case chance is
no likely reason (a likelihood ratio of ``LEAN_RATIO``). Edges join any two nodes and carry their positive pointwise mutual information,
less ``SHIFT``, within ``SPAN`` words, counted over the whole corpus. Two walks with restart, from the toxic and from the
clean seeds, give each node two masses; its polarity weight is their difference over their sum (a toxic seed keeps the
weight 1 that its labels give it). A document's score is the sum of the weights of its words that have at least
``MIN_WEIGHT``, less ``BACKGROUND`` times what labelled clean texts have per word; from ``THRESHOLD`` on it is toxic.

Seeds are chosen on at most ``MAX_LABELLED`` labelled documents (in a fixed pseudo-random order); nodes, counts and scores
cover all documents.

Defined results: null and empty texts score 0. Labels that are null, or of documents that are not there, count for
nothing; of several labels of a document the highest holds. Repeated rows score alike. Without toxic seeds nothing is
toxic. Columns besides id and text are not read, by reject() passed on. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.llm import base
from stratagraph.llm.textbytes import BASE, distinct_per_row, mix, row_sums, windows, words

MAX_LABELLED = 20_000
FAMILY_BANDS, FAMILY_ROWS = 6, 5
MIN_SUPPORT = 2.0
MAX_SHARE = 0.2
SEED_SUPPORT = 3.0
SEED_RATIO = 18.0
LEAN_RATIO = 10.8
SPAN = 12
MIN_JOINT = 3
MIN_CONTEXTS = 3
MIN_NEAR = 0.25
SHIFT = 2.0
WALK = 0.85
MIN_WEIGHT = 0.5
BACKGROUND = 3.0
THRESHOLD = 1.5
U = np.uint64
BITS = 22


@dataclass
class Lookup:
    """Numbers of known word hashes, with a bit table that passes most unknown ones by."""

    keys: np.ndarray  # ascending

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.keys >> U(64 - BITS)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if len(self.keys):
            at = np.flatnonzero(self.maybe[(h >> U(64 - BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[k] == h[at], k, -1)
        return out


def family_bands(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of bands of MinHash values of each row's words; rows without words: 0."""
    out = np.zeros((len(first) - 1, FAMILY_BANDS), U)
    some = np.flatnonzero(np.diff(first))
    for band in range(FAMILY_BANDS if len(some) else 0):
        for k in range(FAMILY_ROWS):
            low = np.minimum.reduceat(mix(h ^ U((band * FAMILY_ROWS + k + 1) * int(BASE) % (1 << 64))), first[some])
            out[some, band] = mix(out[some, band] * BASE + low)
    return out


def family_sizes(bands: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The size of each row's family: rows with words that share a band, directly or by way of others."""
    up = np.arange(len(bands))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for band in bands.T:
        seen: dict[int, int] = {}
        for i in np.flatnonzero(some).tolist():
            p, q = sorted((root(i), root(seen.setdefault(int(band[i]), i))))
            up[q] = p
    top = np.array([root(i) for i in range(len(up))], np.int64)
    return np.bincount(top, minlength=len(up))[top]


@dataclass
class Labelled:
    """The labelled sample as a side table (toxic, words, times, bands), a row a document; and each family's share, 1 over its size, by the first band."""

    rows: DataFrame
    bands: np.ndarray  # ascending
    share: np.ndarray
    n_bad: float
    n_good: float

    def sums(self) -> DataFrame:
        """(w, bad, good, g): in how many toxic and clean families each word is, and the signed likelihood ratio; added up in Arrow batches, then by word."""
        bands, share = self.bands, self.share

        def count(batches):
            for b in batches:
                toxic, parts = b.column(0).to_numpy(zero_copy_only=False) > 0, [np.frombuffer(x.as_buffer(), U) for x in b.column(1)]
                first = np.array([np.frombuffer(x.as_buffer(), U)[0] for x in b.column(2)], U)
                n = np.array([len(x) for x in parts], np.int64)
                own = np.where(n > 0, share[np.minimum(np.searchsorted(bands, first), max(0, len(share) - 1))], 0.0) if len(share) else np.zeros(len(n))
                w, at = np.unique(np.concatenate([np.zeros(0, U), *parts]), return_inverse=True)
                bad, good = (np.bincount(at, np.repeat(np.where(toxic == x, own, 0.0), n), minlength=len(w)) for x in (True, False))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(bad), pa.array(good)], ["w", "bad", "good"])

        total = self.rows.select("toxic", "words", "bands").mapInArrow(count, "w bigint, bad double, good double").groupBy("w").agg(F.round(F.sum("bad"), 9).alias("bad"), F.round(F.sum("good"), 9).alias("good"))
        return total.withColumn("g", lean(F.col("bad"), F.col("good"), self.n_bad, self.n_good))

    def background(self, keys: np.ndarray, weights: np.ndarray) -> float:
        """What clean documents, each with its family's share, have per word."""
        bands, share, spark = self.bands, self.share, self.rows.sparkSession
        shared = spark.sparkContext.broadcast((keys, weights))

        def count(batches):
            find, w = Lookup(shared.value[0]), np.append(shared.value[1], 0.0)
            for b in batches:
                hit = total = 0.0
                for words_of, times_of, band in zip(*b.columns):
                    h, n = np.frombuffer(words_of.as_buffer(), U), np.frombuffer(times_of.as_buffer(), "<i4")
                    if len(h):
                        own = share[np.searchsorted(bands, np.frombuffer(band.as_buffer(), U)[0])]
                        hit, total = hit + own * float((w[find(h)] * n).sum()), total + own * float(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array([hit]), pa.array([total])], ["hit", "total"])

        got = self.rows.where("toxic = 0").select("words", "times", "bands").mapInArrow(count, "hit double, total double").agg(F.sum("hit"), F.sum("total")).first()
        shared.destroy()
        return float(got[0] or 0.0) / max(1.0, float(got[1] or 0.0))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Labelled:
    """The labelled sample; its bound makes the labels fit for a broadcast and the bands, 48 bytes a document, for the driver. Words stay on the executors."""
    small = base.id_and_text(docs)
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = marks.orderBy(base.sample_order("doc_id"), "doc_id").limit(most)

    def count(batches):
        for b in batches:
            cols: list[list] = [[], [], []]
            for _, _, data, off in windows(b.column(0)):
                _, _, h, first = words(data, off)
                u, times, at = distinct_per_row(h, first)
                cols[0] += [u[p:q].tobytes() for p, q in zip(at[:-1], at[1:])]
                cols[1] += [times[p:q].astype("<i4").tobytes() for p, q in zip(at[:-1], at[1:])]
                cols[2] += [x.tobytes() for x in family_bands(u, at)]
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.binary()) for c in cols)], ["toxic", "words", "times", "bands"])

    rows = base.written(small.join(F.broadcast(some), "doc_id").select("text", "toxic").mapInArrow(count, "toxic int, words binary, times binary, bands binary"), "labelled")
    got = rows.select("toxic", "bands", (F.length("words") > 0).alias("some")).toArrow().combine_chunks()
    bands = np.array([np.frombuffer(x.as_buffer(), U) for x in got.column("bands")], U).reshape(-1, FAMILY_BANDS)
    share = 1 / np.maximum(1, family_sizes(bands, some_of := got.column("some").to_numpy()))
    toxic = got.column("toxic").to_numpy() > 0
    first, at = np.unique(bands[some_of, 0], return_index=True)  # equal first bands are one family
    return Labelled(rows, first, share[some_of][at], float(share[toxic].sum()), float(share[~toxic].sum()))


def lean(bad: Column, good: Column, n_bad: float, n_good: float) -> Column:
    """Signed likelihood ratio of a word's counts against the share of toxic families."""
    n, p0 = bad + good, n_bad / max(1e-9, n_bad + n_good)
    p = bad / F.greatest(n, F.lit(1e-9))
    part = lambda x, share, whole: F.when(x > 0, x * F.log(share / whole)).otherwise(0.0)
    g = 2 * (part(bad, p, p0 or 1.0) + part(good, 1 - p, (1 - p0) or 1.0))
    return F.when(p >= p0, g).otherwise(-g)


def near_seeds(docs: DataFrame, toxic: np.ndarray, clean: np.ndarray, said: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[int, int], float]:
    """All words, of whatever documents, that have an edge to a toxic seed and stand near toxic seeds in MIN_CONTEXTS different contexts, and lean to toxic: ascending hashes, and how often each occurs; how often each seed occurs; and the number of words. toxic, clean: the seeds' ascending hashes; said: what labels say, (w, rare, leans, against)."""
    small = base.id_and_text(docs)
    shared = docs.sparkSession.sparkContext.broadcast(toxic)

    def summed(parts):
        w, s, c, bits = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((s, w))
        w, s, c, bits = w[order], s[order], c[order], bits[order]
        new = np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1]))
        at = np.flatnonzero(new)
        return w[at], s[at], np.add.reduceat(c, at), np.bitwise_or.reduceat(bits, at)

    def count(batches):
        find, parts, held = Lookup(shared.value), [], 0
        for b in batches:
            for _, _, data, off in windows(b.column(0)):
                _, _, h, first = words(data, off)
                near = np.zeros(len(h), bool)
                if not len(h):
                    continue
                u, c = np.unique(h, return_counts=True)
                parts.append((u, np.full(len(u), -1), c, np.zeros(len(u), np.int64)))
                parts.append((np.zeros(1, U), np.full(1, -2), np.full(1, len(h)), np.zeros(1, np.int64)))
                s = find(h)
                at = np.flatnonzero(s >= 0)
                row = np.searchsorted(first, at, "right") - 1
                lo, hi = first[row], first[row + 1]
                total = np.concatenate([np.zeros(1, U), np.cumsum(h)])
                for d in [*range(-SPAN, 0), *range(1, SPAN + 1)]:
                    q = at + d
                    ok = (q >= lo) & (q < hi)
                    x, y = at[ok], q[ok]
                    if not len(x):
                        continue
                    # one of 64 bits for what stands from one word before the pair to one after it: copies share it
                    context = mix(total[np.minimum(np.maximum(x, y) + 2, hi[ok])] - total[np.maximum(np.minimum(x, y) - 1, lo[ok])])
                    parts.append((h[y], s[x], np.ones(len(x), np.int64), (U(1) << (context >> U(58))).view(np.int64)))
                    near[y] = True
                u, c = np.unique(h[near], return_counts=True)
                parts.append((u, np.full(len(u), -3), c, np.zeros(len(u), np.int64)))
                parts.append((np.zeros(1, U), np.full(1, -4), np.full(1, int(near.sum())), np.zeros(1, np.int64)))
                held += 2 * len(u) + len(at) * 2 * SPAN
                if held > 600_000:
                    parts, held = [summed(parts)], 0
                    if len(parts[0][0]) > 400_000:
                        yield from batch(parts[0])
                        parts = []
        if parts:
            yield from batch(summed(parts))

    def batch(x):
        for a in range(0, len(x[0]), 100_000):
            w, s, c, bits = (y[a : a + 100_000] for y in x)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(s, pa.int64()), pa.array(c, pa.int64()), pa.array(bits)], ["w", "s", "c", "bits"])

    rows = small.select("text").mapInArrow(count, "w bigint, s bigint, c bigint, bits bigint").repartition("w").groupBy("w", "s").agg(F.sum("c").alias("c"), F.expr("bit_or(bits)").alias("bits"))
    rows = rows.select("*", *(F.max(F.when(F.col("s") == k, F.col("c"))).over(Window.partitionBy("w")).alias(c) for k, c in ((-1, "own"), (-3, "near"))))
    hash_of = np.union1d(toxic, clean).view(np.int64).tolist()
    rows = base.written(rows.where(f"s in (-2, -4) or c >= {MIN_JOINT} or w in ({','.join(map(str, hash_of))})"), "seedwords")
    known = {r.w: r.c for r in rows.where(F.col("s") == -1).where(F.col("w").isin(hash_of)).collect()}
    n_words = (rows.where("s = -2").agg(F.sum("c")).first()[0]) or 1
    own = docs.sparkSession.createDataFrame([(k, float(known.get(x, 0))) for k, x in enumerate(toxic.view(np.int64).tolist())], "s bigint, own_seed double")
    edges = rows.where(f"s >= 0 and c >= {MIN_JOINT}").join(own, "s").where(F.log(F.col("c") * n_words / (F.col("own_seed") * (2 * SPAN) * F.col("own"))) > SHIFT)
    n_near = float(rows.where("s = -4").agg(F.sum("c")).first()[0] or 0)
    got = edges.groupBy("w").agg(F.expr("bit_count(bit_or(bits))").alias("n"), F.max(F.coalesce("near", F.lit(0))).alias("near"), F.max("own").alias("own")).where(F.col("n") >= MIN_CONTEXTS)
    by_corpus = (F.col("near") >= MIN_NEAR * F.col("own")) & (lean(F.col("near"), F.col("own") - F.col("near"), n_near, n_words - n_near) >= LEAN_RATIO)
    got = got.join(said, "w", "left").where(F.coalesce("rare", F.lit(True)) & (F.coalesce("leans", F.lit(False)) | (by_corpus & ~F.coalesce("against", F.lit(False))))).select("w", "own").toArrow()
    shared.destroy()
    w = got.column("w").to_numpy().view(U)
    order = np.argsort(w)
    return w[order], got.column("own").to_numpy()[order], known, float(n_words)


def cooccurrences(docs: DataFrame, nodes: np.ndarray, own: np.ndarray, n_words: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges over all texts: pairs of different nodes that stand within SPAN words MIN_JOINT times at least, and their positive ppmi. nodes: ascending hashes; own: how often each occurs."""
    small, v = base.id_and_text(docs), len(nodes)
    shared = docs.sparkSession.sparkContext.broadcast((nodes, own))

    def summed(joint):
        u = np.sort(np.concatenate(joint))
        at = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(np.diff(np.append(at, len(u))))], ["k", "c"])

    def count(batches):
        find, joint, held = Lookup(shared.value[0]), [], 0
        for b in batches:
            for _, _, data, off in windows(b.column(0)):
                _, _, h, first = words(data, off)
                node = find(h)
                at = np.flatnonzero(node >= 0)
                row = np.searchsorted(first, at, "right") - 1
                for k in range(1, SPAN + 1):
                    x = np.flatnonzero((at[k:] - at[:-k] <= SPAN) & (row[k:] == row[:-k]))
                    if not len(x):
                        break
                    i, j = node[at[x]], node[at[x + k]]
                    joint.append((np.minimum(i, j) * v + np.maximum(i, j))[i != j])
                    held += len(joint[-1])
                if held > 1_000_000:
                    yield summed(joint)
                    joint, held = [], 0
        if joint:
            yield summed(joint)

    def edges(batches):
        for b in batches:
            k, c = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            x = ppmi(k // v, k % v, c, shared.value[1], n_words)
            yield pa.RecordBatch.from_arrays([pa.array(k[x > 0]), pa.array(x[x > 0])], ["k", "x"])

    pairs = small.select("text").mapInArrow(count, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).where(f"c >= {MIN_JOINT}")
    rows = pairs.mapInArrow(edges, "k bigint, x double").toArrow()
    shared.destroy()
    k, x = rows.column("k").to_numpy(), rows.column("x").to_numpy()
    order = np.argsort(k)
    return k[order] // v, k[order] % v, x[order]


def ppmi(i: np.ndarray, j: np.ndarray, joint: np.ndarray, own: np.ndarray, n_words: float) -> np.ndarray:
    """Positive pointwise mutual information of pairs of nodes, less SHIFT."""
    return np.maximum(0.0, np.log(joint / (own[i] * (2 * SPAN) * (own[j] / max(1.0, n_words)))) - SHIFT)


def wander(i: np.ndarray, j: np.ndarray, x: np.ndarray, v: int, start: np.ndarray) -> np.ndarray:
    """Mass of each of v nodes in a random walk over the undirected edges (i, j) of weight x that goes back to the start nodes, run until it stands."""
    degree = np.bincount(i, x, v) + np.bincount(j, x, v)
    restart = np.zeros(v)
    restart[start] = 1 / max(1, len(start))
    p = restart.copy()
    for _ in range(200):
        out = np.divide(p, degree, out=np.zeros(v), where=degree > 0)
        y = np.bincount(j, x * out[i], v) + np.bincount(i, x * out[j], v)
        lost = 1 - y.sum()
        new = WALK * (y + lost * restart) + (1 - WALK) * restart
        if np.abs(new - p).sum() < 1e-9:
            return new
        p = new
    return p


def walk(m: np.ndarray, seeds: np.ndarray, start: np.ndarray) -> np.ndarray:
    """wander() over the edges of a matrix of seeds and nodes."""
    s, n = np.nonzero(m)
    return wander(seeds[s], n, m[s, n], m.shape[1], start)


@dataclass
class Lexicon:
    keys: np.ndarray  # ascending word hashes
    weights: np.ndarray
    background: float = 0.0  # taken off per word

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        _, _, h, first = words(data, off)
        return row_sums(np.append(self.weights, 0.0)[self.find(h)], first) - self.background * np.diff(first)

    def __post_init__(self) -> None:
        self.find = Lookup(self.keys)


def _words(rows: DataFrame) -> np.ndarray:
    """The column w of a frame as ascending hashes."""
    return np.sort(rows.select("w").toArrow().column(0).to_numpy().view(U))


def lexicon(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Lexicon:
    """Only words over the thresholds come to the driver: seeds, nodes (near_seeds) and their edges; all vocabularies stay tables."""
    some = labelled(docs, labels, most)
    sums = base.written(some.sums(), "wordsums")
    rare = F.col("bad") + F.col("good") <= MAX_SHARE * (some.n_bad + some.n_good)
    toxic = _words(sums.where(rare & (F.col("g") >= SEED_RATIO) & (F.col("bad") >= SEED_SUPPORT) & (F.col("bad") > F.col("good"))))
    if not len(toxic):
        return Lexicon(np.zeros(0, U), np.zeros(0))
    clean = np.setdiff1d(_words(sums.where("g < 0").orderBy("g", "w").limit(max(10, len(toxic)))), toxic)
    seeds = np.union1d(toxic, clean)
    said = sums.select("w", rare.alias("rare"), (rare & (F.col("bad") >= MIN_SUPPORT) & (F.col("bad") > F.col("good")) & (F.col("g") >= LEAN_RATIO)).alias("leans"), (F.col("good") >= F.col("bad")).alias("against"))
    near, near_own, seed_own, n_words = near_seeds(docs, toxic, clean, said)
    h = np.union1d(seeds, near)
    own = np.zeros(len(h))
    own[np.searchsorted(h, seeds)] = [seed_own.get(x, 1) for x in seeds.view(np.int64).tolist()]
    own[np.searchsorted(h, near)] = near_own
    i, j, x = cooccurrences(docs, h, own, n_words)
    is_toxic, is_clean = np.isin(h, toxic), np.isin(h, clean)
    bad, good = wander(i, j, x, len(h), np.flatnonzero(is_toxic)), wander(i, j, x, len(h), np.flatnonzero(is_clean))
    weight = np.where(is_toxic, 1.0, (bad - good) / (bad + good + 0.05 / len(h)))
    strong = (weight >= MIN_WEIGHT) & ~is_clean
    keys, weight = h[strong], weight[strong]
    return Lexicon(keys, weight, BACKGROUND * some.background(keys, weight))


def score_column(spark: SparkSession, own: Lexicon):
    """A column function: the toxicity score of a text."""
    shared = spark.sparkContext.broadcast(own)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for a, b, data, off in windows(text):
            out[a:b] = shared.value.score(data, off)
        return pa.array(np.round(out, 6) + 0.0)

    return score


def scores(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic), one row per input row."""
    small = base.id_and_text(docs)
    score = score_column(small.sparkSession, lexicon(docs, labels, most))
    return small.select("doc_id", score("text").alias("score")).withColumn("toxic", F.col("score") >= threshold)


def reject(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    score = score_column(docs.sparkSession, lexicon(docs, labels, most))
    return docs.where(score(docs["text"].cast("string")) < threshold)


def op9_induced_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(base.parquet(spark, sf_dir, "documents"), base.parquet(spark, sf_dir, "labels"))
