"""Operator 2, quality rules: logistic regression on hashed word and character n-grams, calibrated, against fixed thresholds.

Features of a text, each as a share of its kind: runs of three bytes as they are written; words as they are written
(runs of anything but white space); pairs of neighbouring words, where a word after itself is one and the same feature
whatever the word. They are hashed to ``SIZE`` numbers. The regression is fitted on at most ``MAX_LABELLED`` labelled
documents (a fixed pseudo-random choice); on a quarter of these that it was not fitted on, a two-parameter logistic
calibration turns scores into probabilities. A document is rejected below ``REJECT``, good from ``GOOD`` on, fair between.

Scoring goes over whole texts in Arrow batches: a few table lookups per byte, nothing per row.

Defined results: null, empty and blank texts have probability 0 and are rejected. Labels that are null, or of documents
that are not there, count for nothing; of several labels of a document the lowest holds. Without labels of both
classes nothing but blank texts is rejected (probability 1). Repeated rows score alike. Columns besides id and text are
not read, by keep() passed on. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import base
from stratagraph.llm.logistic import Sparse, fit, platt, sigmoid
from stratagraph.llm.textbytes import arrow_bytes, mix, pieces, windows

MAX_LABELLED = 4_000
REJECT, GOOD = 0.5, 0.9
CHARS, WORDS, PAIRS = 1 << 17, 1 << 16, 1 << 16
SIZE = CHARS + WORDS + PAIRS
SCALE = 10.0
L2 = 1e-4
U = np.uint64


@dataclass
class Model:
    weight: np.ndarray  # of the features, with the scale
    bias: float
    a: float
    b: float
    known: bool = True


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each kind: the feature numbers of all its n-grams, and where each row's first and last ones are."""
    n = len(data)
    x = data.astype(np.uint32)
    gram = x.copy()
    gram[: n - 1] |= x[1:] << np.uint32(8)
    gram[: n - 2] |= x[2:] << np.uint32(16)
    gram *= np.uint32(0x9E3779B1)
    gram >>= np.uint32(15)
    starts, _, h, first = pieces(data, off)
    word = (mix(h) >> U(48)).astype(np.int64) + CHARS
    if len(h) > 1:
        pair = (mix(h[:-1] * U(0x9E3779B97F4A7C15) ^ h[1:]) >> U(48)).astype(np.int64)
        pair = np.where(h[:-1] == h[1:], PAIRS - 1, pair % (PAIRS - 1)) + CHARS + WORDS
    else:
        pair = np.zeros(0, np.int64)
    last_char, last_pair = np.maximum(off[1:] - 2, off[:-1]), np.maximum(first[1:] - 1, first[:-1])
    return [(gram, off[:-1], last_char), (word, first[:-1], first[1:]), (pair, first[:-1], last_pair)]


def sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[np.minimum(b, len(values))] - total[np.minimum(a, len(values))]


def raw_scores(data: np.ndarray, off: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sum of weighted shares; and whether it has a word."""
    out = np.zeros(len(off) - 1)
    for k, a, b in (kinds := features(data, off)):
        out += sums(weight[k], a, b) / np.maximum(1, b - a)
    return out, kinds[1][2] > kinds[1][1]


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents; the bound makes the labels fit for a broadcast."""
    small = base.id_and_text(docs)
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    some = marks.orderBy(base.sample_order("doc_id"), "doc_id").limit(most)
    return small.join(F.broadcast(some), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> tuple[Sparse, np.ndarray]:
    """The features and classes of the labelled sample, in a fixed order of rows."""

    def count(batches):
        for b in batches:
            index, value = [], []
            for _, _, data, off in windows(b.column(1)):
                rows: list[list[np.ndarray]] = [[] for _ in range(len(off) - 1)]
                for k, a, e in features(data, off):
                    for r in range(len(rows)):
                        if e[r] > a[r]:
                            u, c = np.unique(k[a[r] : e[r]], return_counts=True)
                            rows[r] += [u.astype("<i4"), (c * (SCALE / (e[r] - a[r]))).astype("<f4")]
                index += [b"".join(x.tobytes() for x in r[::2]) for r in rows]
                value += [b"".join(x.tobytes() for x in r[1::2]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["id", "y", "i", "v"])

    got = labelled(docs, labels, label, most).select("doc_id", "text", "y").mapInArrow(count, "id string, y int, i binary, v binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("i", "ascending")]).combine_chunks()
    (index, off), (value, _) = arrow_bytes(got.column("i")), arrow_bytes(got.column("v"))  # 4 bytes a feature in either
    y = (got.column("y").to_numpy() > 0).astype(np.float64)
    return Sparse(index[off[0] : off[-1]].view("<i4").copy(), value[off[0] : off[-1]].view("<f4").copy(), (off - off[0]) // 4, SIZE), y


def train(x: Sparse, y: np.ndarray, l2: float = L2) -> Model:
    if not (0 < y.sum() < len(y)):
        return Model(np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0, False)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = True  # too few labels to hold any out
        own = np.ones(len(y), bool)
    else:
        own = ~held
    w, bias = fit(x.rows(np.flatnonzero(own)), y[own, None], l2)
    a, b = platt(x.rows(np.flatnonzero(held)).times(w)[:, 0] + bias[0], y[held])
    return Model((w[:, 0] * SCALE).astype(np.float32), float(bias[0]), a, b)


def model(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    return train(*sample(docs, labels, most=most))


def probability_column(spark: SparkSession, own: Model):
    """A column function: the probability that a text is good."""
    shared = spark.sparkContext.broadcast(own)

    @F.arrow_udf("double")
    def probability(text: pa.Array) -> pa.Array:
        m, out = shared.value, np.zeros(len(text))
        for a, b, data, off in windows(text):
            s, some = raw_scores(data, off, m.weight)
            out[a:b] = np.where(some, sigmoid(m.a * (s + m.bias) + m.b) if m.known else 1.0, 0.0)
        return pa.array(np.round(out, 6))

    return probability


def verdict(p: Column) -> Column:
    return F.when(p < REJECT, "reject").when(p < GOOD, "fair").otherwise("good")


def judged(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, p_good, verdict), one row per input row."""
    small = base.id_and_text(docs)
    p = probability_column(small.sparkSession, model(docs, labels, most))
    return small.select("doc_id", p("text").alias("p_good")).withColumn("verdict", verdict(F.col("p_good")))


def keep(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    p = probability_column(docs.sparkSession, model(docs, labels, most))
    return docs.where(p(docs["text"].cast("string")) >= REJECT)


def op2_ngram_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(base.parquet(spark, sf_dir, "documents"), base.parquet(spark, sf_dir, "labels"))
