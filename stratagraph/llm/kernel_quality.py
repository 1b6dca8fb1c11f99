"""Operator 4, quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text gives the statistics in ``NAMES`` (one pass over whole texts, written as a narrow table that all later steps
read). They are brought to mean 0 and deviation 1 over all documents with a word, then to ``FEATURES`` cosines whose
inner products approximate a Gaussian kernel. Every partition of the labelled rows adds up its part of the normal
equations; the parts are summed in two steps, so no task gets more than about the root of their number. All labelled rows
count: four fifths fit the ridge regression, and on the other fifth the scores, counted in ``BINS`` bins, give a rising
step function of probabilities (pool adjacent violators).

Defined results: texts without a word (null, empty, blank) have score and probability 0. Labels that are null, or of
documents that are not there, count for nothing; of several labels of a document the lowest holds. Without labels of
both classes every text with a word has probability 1. Repeated rows score alike. Columns besides id and text are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import base
from stratagraph.llm.textbytes import distinct_per_row, mix, pieces, row_sums, runs, span_hashes, windows

NAMES = ["log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "exclaimed", "blank", "distinct", "repeated", "doubled", "line_bytes", "same_lines", "short"]
FEATURES = 192
WIDTH = 3.0
RIDGE = 1e-4
BINS = 512
LOW, HIGH = -0.5, 1.5
KEEP = 0.5
U = np.uint64

_UPPER, _LETTER, _DIGIT, _SYMBOL, _CRY, _BLANK = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = True
_CRY[[33, 63]] = True
_BLANK[[32, *range(9, 14)]] = True


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows by NAMES; rows without a word are nan."""
    n = np.diff(off)
    starts, ends, h, first = pieces(data, off)
    w = np.diff(first)
    count = lambda mask: row_sums(mask[data], off)
    share = lambda a, b: a / np.maximum(1, b)
    distinct = np.diff(distinct_per_row(h, first)[2]) if len(h) else np.zeros(len(n))
    pair, within = np.zeros(len(h), U), np.zeros(len(h), bool)
    if len(h) > 1:
        pair[:-1] = mix(h[:-1] * U(0x9E3779B97F4A7C15) ^ h[1:])
        within[:-1] = True
        within[first[1:][w > 0] - 1] = False
    firsts = np.concatenate([[0], np.cumsum(within)])[first]
    pairs = np.diff(firsts)
    distinct_pairs = np.diff(distinct_per_row(pair[within], firsts)[2]) if within.any() else np.zeros(len(n))
    doubled = np.zeros(len(h), bool)
    doubled[:-1] = (h[:-1] == h[1:]) & within[:-1] if len(h) else False
    a, b = runs(data != 10, off)
    line = np.searchsorted(a, off)
    lines = np.diff(line)
    same = lines - (np.diff(distinct_per_row(span_hashes(data, a, b), line)[2]) if len(a) else 0)
    out = np.stack([
        np.log1p(n), np.log1p(w), np.log1p(share(row_sums(ends - starts, first), w)), share(count(_UPPER), count(_LETTER)), share(count(_DIGIT), n), np.sqrt(share(count(_SYMBOL), n)), np.sqrt(share(count(_CRY), n)),
        share(count(_BLANK), n), share(distinct, w), 1 - share(distinct_pairs, pairs), np.sqrt(share(row_sums(doubled, first), w)), np.log1p(share(row_sums(b - a, line), lines)), share(same, lines), share(row_sums(ends - starts <= 2, first), w),
    ], axis=1)
    out[w == 0] = np.nan
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x), x null where the text has no word."""
    small = base.id_and_text(docs)

    def run(batches):
        for b in batches:
            x = np.concatenate([np.zeros((0, len(NAMES))), *[statistics(data, off) for _, _, data, off in windows(b.column(1))]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.reshape(-1)), mask=pa.array(np.isnan(x[:, 0]) if len(x) else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "x"])

    return small.mapInArrow(run, f"doc_id {base.id_type(small)}, x array<double>")


class Cosines:
    """The map from statistics to features; seeded, so it is the same everywhere."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n: int = FEATURES, width: float = WIDTH) -> None:
        rng = np.random.default_rng(20240501)
        self.mean, self.deviation, self.n = mean, np.where(deviation > 1e-9, deviation, 1.0), n
        self.w = rng.standard_normal((len(mean), n)) / width
        self.b = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.concatenate([math.sqrt(2 / self.n) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(NAMES)) if len(column) else np.zeros((0, len(NAMES)))


def normal_equations(rows: DataFrame, to: Cosines) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows (x, y), added up per partition, then in two steps."""
    d = to.n + 1
    shared = rows.sparkSession.sparkContext.broadcast(to)

    def part(batches):
        a = np.zeros((d, d + 1))
        for b in batches:
            z = shared.value(matrix(b.column(0)))
            a += z.T @ np.concatenate([z, b.column(1).to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([a.tobytes()], pa.binary())], ["part", "a"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("a")], axis=0)
        return pa.table([table.column("part").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], ["part", "a"])

    parts = rows.select("x", "y").mapInArrow(part, "part int, a binary")
    step = max(1, math.isqrt(max(1, rows.rdd.getNumPartitions())))
    halfway = parts.groupBy(F.pmod("part", F.lit(step)).alias("_g")).applyInArrow(lambda t: add(t), "part int, a binary")
    total = halfway.groupBy(F.lit(0).alias("_g")).applyInArrow(lambda t: add(t), "part int, a binary").first()
    a = np.frombuffer(total["a"]).reshape(d, d + 1) if total else np.zeros((d, d + 1))
    return a[:, :d], a[:, d]


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rising values nearest to the means y/n of the bins (weights n); empty bins take the value to their left, the first ones that to their right."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(n > 0).tolist():
        blocks.append([y[k], n[k], k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2]]
    out = np.ones(len(n))
    for k, (s, m, start) in enumerate(blocks):
        out[(int(start) if k else 0) :] = s / m
    return out


def bin_of(score):
    """The bin of a score, a column."""
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((score - LOW) * (BINS / (HIGH - LOW))))).cast("int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, p_good, good), one row per input row."""
    spark = docs.sparkSession
    stats = base.written(measured(docs), "statistics")
    some = stats.where("x is not null")
    row = some.agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(len(NAMES)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    value = lambda s: np.array([row[f"{s}{k}"] or 0.0 for k in range(len(NAMES))])
    to = Cosines(value("m"), value("s"))
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("q"))
    marked = base.written(some.join(marks, some["doc_id"] == marks["_id"]).select("doc_id", "x", F.when(F.col("q") > 0, 1.0).otherwise(0.0).alias("y"), (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(5)) == 0).alias("held")), "marked")
    classes = {r[0] for r in marked.select("y").distinct().collect()}
    beta = np.zeros(to.n + 1)
    if len(classes) == 2:
        a, c = normal_equations(marked.where("not held"), to)
        ridge = RIDGE * max(1.0, a[-1, -1]) * np.eye(to.n + 1)
        ridge[-1, -1] = 1e-9
        beta = np.linalg.solve(a + ridge, c)
    shared = spark.sparkContext.broadcast((to, beta))

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        to, beta = shared.value
        out = np.zeros(len(x))
        some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
        out[some] = to(matrix(x.take(pa.array(some)))) @ beta
        return pa.array(np.round(out, 6))

    curve = np.ones(BINS)
    if len(classes) == 2:
        held = marked.where("held") if marked.where("held").select("y").distinct().count() == 2 else marked
        bins = held.select(bin_of(score("x")).alias("k"), "y").groupBy("k").agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()
        y, n = np.zeros(BINS), np.zeros(BINS)
        for r in bins:
            y[r["k"]], n[r["k"]] = r["y"], r["n"]
        curve = isotonic(y, n)
    steps = F.array(*[F.lit(float(x)) for x in np.round(curve, 6)])
    scored = stats.select("doc_id", F.when(F.col("x").isNotNull(), score("x")).otherwise(0.0).alias("score"), F.col("x").isNotNull().alias("some"))
    return scored.select("doc_id", "score", F.when(F.col("some"), steps[bin_of(F.col("score"))]).otherwise(0.0).alias("p_good")).withColumn("good", F.col("p_good") >= KEEP)


def op4_fourier_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(base.parquet(spark, sf_dir, "documents"), base.parquet(spark, sf_dir, "labels"))
