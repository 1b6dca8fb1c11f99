"""Operator 10, licence scan: a trained paragraph classifier on word n-grams, with an unknown class and a template check.

Paragraphs are the lines of a text and, within a line, its sentences. Features are the words and pairs of neighbouring
words of the licence passages, each as its share of the paragraph's; words that no passage has are one feature. The
classifier is a softmax regression over the families and an unknown class. It is trained on the passages, on seeded
variations of them (words left out, swapped or put in, pieces cut off) and, for the unknown class, on word sequences that
hold the passages' words in random order, from none to all of them; nothing of it depends on the corpus. On a quarter of
these rows that it was not fitted on, a temperature is fitted, so that its probabilities, that of unknown too, are
calibrated. A paragraph whose best family has at least ``MIN_PROBABILITY`` is compared with that family's passages: it is
confirmed if it holds ``MIN_SIMILARITY`` of the word pairs of one of them, or one holds as much of the paragraph (of at
least ``MIN_WORDS`` words), as in wrapped lines.

Every paragraph of every text is classified; those without any word of a passage have one and the same features, so that
their class is worked out once.

Defined results: null and empty texts have no paragraphs. A document with several licences gives a row for each, repeated
rows of documents and repeated paragraphs give theirs. Columns besides id and text are not read. An empty table gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import base
from stratagraph.llm.license_texts import TEMPLATES
from stratagraph.llm.logistic import Sparse, fit, softmax, temperature
from stratagraph.llm.textbytes import distinct_per_row, gram_hashes, mix, owner, row_sums, windows, words
from stratagraph.llm.toxicity import Lookup

VARIATIONS = 30
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
MIN_WORDS = 4
L2 = 1e-4
U = np.uint64
FAMILIES = list(TEMPLATES)
UNKNOWN = len(FAMILIES)


def paragraphs(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where paragraphs start, and the end; every row starts one."""
    n = len(data)
    if not n:
        return np.unique(off)
    cut = np.zeros(n + 1, bool)
    line = data == 10
    cut[1:] |= line
    stop = (data == 46) | (data == 33) | (data == 63)
    cut[2:] |= stop[:-1] & (data[1:] == 32)
    cut[off] = True
    return np.flatnonzero(cut)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the paragraphs' first words, pair hashes (of neighbours within a paragraph), the paragraphs' first pairs."""
    _, _, h, first = words(data, off)
    if len(h) < 2:
        return h, first, np.zeros(0, U), np.zeros_like(first)
    within = np.ones(len(h), bool)
    within[first[1:][np.diff(first) > 0] - 1] = False
    pair = mix(h[:-1] * U(0x9E3779B97F4A7C15) ^ h[1:])
    return h, first, pair[within[:-1]], np.concatenate([[0], np.cumsum(within)])[first]


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


@dataclass
class Templates:
    """The passages' features and pairs; built alike on driver and executors."""

    def __post_init__(self) -> None:
        self.texts = [t for f in FAMILIES for t in TEMPLATES[f]]
        self.family = np.array([k for k, f in enumerate(FAMILIES) for _ in TEMPLATES[f]])
        h, first, pair, firsts = grams(*of_texts(self.texts))
        self.words, self.pairs = Lookup(np.unique(h)), Lookup(np.unique(pair))
        self.n_words, self.n_pairs = len(self.words.keys), len(self.pairs.keys)
        self.size = self.n_words + self.n_pairs + 2
        p, _, at = distinct_per_row(pair, firsts)
        self.has = np.zeros((len(self.texts), self.n_pairs), bool)
        self.has[owner(at), np.searchsorted(self.pairs.keys, p)] = True
        self.total = self.has.sum(axis=1)

    def rows(self, data: np.ndarray, off: np.ndarray) -> Sparse:
        """The features of paragraphs."""
        h, first, pair, firsts = grams(data, off)
        w, p = self.words(h), self.pairs(pair)
        w = np.where(w >= 0, w, self.size - 2)
        p = np.where(p >= 0, p + self.n_words, self.size - 1)
        row = np.concatenate([owner(first), owner(firsts)])
        index = np.concatenate([w, p])
        value = 1 / np.maximum(1, np.concatenate([np.diff(first)[owner(first)], np.diff(firsts)[owner(firsts)]]))
        order = np.argsort(row, kind="stable")
        return Sparse(index[order], value[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(off) - 1))]), self.size)

    def similarity(self, data: np.ndarray, off: np.ndarray, family: np.ndarray) -> np.ndarray:
        """The share of common word pairs of each paragraph and the nearest passage of the family given for it."""
        _, first, pair, firsts = grams(data, off)
        u, _, at = distinct_per_row(pair, firsts)
        row, k = owner(at), self.pairs(u)
        mine = np.zeros((len(off) - 1, self.n_pairs), bool)
        mine[row[k >= 0], k[k >= 0]] = True
        common = mine.astype(np.float32) @ self.has.T.astype(np.float32)
        n = np.diff(at)[:, None]
        held = np.where((np.diff(first) >= MIN_WORDS)[:, None], common / np.maximum(1, n), 0)
        best = np.maximum(common / np.maximum(1, self.total), held)
        return np.where(self.family[None, :] == family[:, None], best, 0).max(axis=1, initial=0)


def varied(seed: int = 11, chosen: dict[str, list[str]] | None = None) -> tuple[list[str], list[int]]:
    """Training paragraphs: the passages, variations of them, and their words in random order, among others, as unknown ones."""
    rng = np.random.default_rng(seed)
    chosen = chosen or TEMPLATES
    pool = sorted({w for f in FAMILIES for t in chosen.get(f, []) for w in t.split()})
    filler = ["x" + "".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    texts, y = [], []
    for k, f in enumerate(FAMILIES):
        for t in chosen.get(f, []):
            w = t.split()
            for v in range(VARIATIONS):
                x = list(w)
                if v:
                    if len(x) > 12 and rng.random() < 0.4:
                        a = int(rng.integers(0, len(x) - 8))
                        x = x[a : a + int(rng.integers(8, len(x) - a + 1))]
                    x = [z for z in x if rng.random() > 0.05] or list(w)
                    for _ in range(int(rng.integers(0, 4))):
                        x.insert(int(rng.integers(0, 2)) * len(x), str(rng.choice(filler)))
                texts.append(" ".join(x))
                y.append(k)
    often = [w for f in FAMILIES for t in chosen.get(f, []) for w in t.split()]
    others = []
    for k in range(2 * len(texts)):
        known = rng.choice([0.0, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0])
        own = (pool, often)[k % 2]
        others.append([str(rng.choice(own if rng.random() < known else filler)) for _ in range(int(rng.integers(1, 30)))])
    for w in pool:  # a single word says little
        for n in (0, 0, 0, 0, 1, 3, 8):
            x = [str(z) for z in rng.choice(filler, n)]
            x.insert(int(rng.integers(0, n + 1)), w)
            others.append(x)
    texts += [" ".join(x) for x in others]
    y += [UNKNOWN] * len(others)
    return texts, y


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    factor: float

    def __post_init__(self) -> None:
        """strangers: of paragraphs of 0, 1 and more words that no passage has, those that would still be classed as a licence."""
        p = self.probabilities(Templates().rows(*of_texts(["", "xqzw", "xqzw xqzv"])))
        self.strangers = np.flatnonzero(p[:, :UNKNOWN].max(axis=1) >= MIN_PROBABILITY)

    def probabilities(self, x: Sparse) -> np.ndarray:
        return softmax(self.factor * (x.times(self.weights) + self.bias))


def train(chosen: dict[str, list[str]] | None = None) -> Model:
    t = Templates()
    texts, y = varied(chosen=chosen)
    x, y = t.rows(*of_texts(texts)), np.array(y)
    hot = np.eye(UNKNOWN + 1)[y]
    held = np.random.default_rng(5).random(len(y)) < 0.25
    w, b = fit(x.rows(np.flatnonzero(~held)), hot[~held], L2)
    return Model(w, b, temperature(x.rows(np.flatnonzero(held)).times(w) + b, hot[held]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) for each paragraph that is classed as a licence; paragraph numbers count from 0 in a text."""
    small = base.id_and_text(docs)
    shared = small.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        t, m = Templates(), shared.value
        for b in batches:
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
            for r0, _, data, off in windows(b.column(1)):
                at = paragraphs(data, off)
                if len(at) < 2:
                    continue
                h, firsts, _, _ = grams(data, at)
                known = row_sums(t.words(h) >= 0, firsts) > 0
                some = np.flatnonzero(known | np.isin(np.minimum(2, np.diff(firsts)), m.strangers))
                if not len(some):
                    continue
                n = at[some + 1] - at[some]
                own = np.concatenate([[0], np.cumsum(n)])
                part = data[np.repeat(at[some] - own[:-1], n) + np.arange(own[-1])]
                p = m.probabilities(t.rows(part, own))
                family = p[:, :UNKNOWN].argmax(axis=1)
                best = p[np.arange(len(p)), family]
                good = np.flatnonzero(best >= MIN_PROBABILITY)
                if not len(good):
                    continue
                n = own[good + 1] - own[good]
                sub = np.concatenate([[0], np.cumsum(n)])
                near = t.similarity(part[np.repeat(own[good] - sub[:-1], n) + np.arange(sub[-1])], sub, family[good])
                row = np.searchsorted(off, at[some[good]], "right") - 1
                for c, v in zip(cols, [r0 + row, some[good] - np.searchsorted(at, off[row]), family[good], best[good], near]):
                    c.append(v)
            rows, number, family, best, near = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(number), pa.array([FAMILIES[k] for k in family.tolist()], pa.string()), pa.array(np.round(best, 6)), pa.array(np.round(near.astype(np.float64), 6)), pa.array(near >= MIN_SIMILARITY)], ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    return small.mapInArrow(run, f"doc_id {base.id_type(small)}, paragraph bigint, family string, probability double, similarity double, confirmed boolean")


def op10_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(base.parquet(spark, sf_dir, "documents"))
