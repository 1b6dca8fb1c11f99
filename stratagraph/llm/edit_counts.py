"""Operator 6, token counts: edit-aware counting over a segment tree of pre-token runs per document.

The leaves of a document's tree are runs of ``LEAF`` pre-token units (white space and the word after it, the smallest
spans whose ids do not depend on their neighbours); each holds its bytes and tokens, each inner node the sums below it.
build() keeps trees in a table, leaf bytes and token sums; recount() takes them from there. An edit descends the byte
sums to the leaves that it touches; these (and a neighbour where the edit reaches the bound between them) are encoded
again, all regions of a batch together, and the sums on the way to the root updated. The rest of the text is not encoded
again.

Defined results: null and empty texts have one leaf of 0 tokens. Edits are byte ranges of the text before any of them,
given in order and disjoint. Repeated rows are counted each. Columns besides id and text are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import base, vocab
from stratagraph.llm.textbytes import arrow_bytes, windows

LEAF = 64
NUMBER = re.compile(rb"\+?\d[\d ().-]{7,}\d")
MAIL = re.compile(rb"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+")


def heap(values: np.ndarray) -> np.ndarray:
    """Sums in heap order: the root at 1, leaves from the middle on."""
    size = 1 << max(0, int(len(values) - 1).bit_length())
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(values)] = values
    while size > 1:
        size >>= 1
        out[size : 2 * size] = out[2 * size : 4 * size : 2] + out[2 * size + 1 : 4 * size : 2]
    return out


class Tree:
    """One document's byte and token sums."""

    def __init__(self, n_bytes: np.ndarray, n_tokens: np.ndarray) -> None:
        self.bytes, self.tokens = n_bytes, n_tokens

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a byte, and where the leaf starts."""
        k, start, half = 1, 0, len(self.bytes) // 2
        while k < half:
            k *= 2
            if at - start >= self.bytes[k]:
                start += int(self.bytes[k])
                k += 1
        return k, start

    def set(self, leaf: int, n_bytes: int, n_tokens: int) -> None:
        b, t = n_bytes - int(self.bytes[leaf]), n_tokens - int(self.tokens[leaf])
        while leaf:
            self.bytes[leaf] += b
            self.tokens[leaf] += t
            leaf //= 2

    def regions(self, text: bytes, edits: list[tuple[int, int, bytes]]) -> tuple[bytes, list[tuple[int, int, int, int]]]:
        """The text after the edits; and what they touch: first and last leaf, and the bytes of the new text that take their place."""
        n, parts, last, shift, out = len(text), [], 0, 0, []
        for start, end, new in edits:
            a, a0 = self.find(min(start, max(0, n - 1)))
            if start == a0 and a0:
                a, a0 = self.find(a0 - 1)
            b, b0 = self.find(min(max(start, end - 1), max(0, n - 1)))
            stop = b0 + int(self.bytes[b])
            while stop - end <= 3 and stop < n:  # what follows may no longer begin a unit
                b, b0 = self.find(stop)
                stop = b0 + int(self.bytes[b])
            grown = len(new) - (end - start)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2], max(stop, out[-1][3] - shift) + shift + grown)
            else:
                out.append((a, b, a0 + shift, stop + shift + grown))
            shift += grown
            parts += [text[last:start], new]
            last = end
        return b"".join([*parts, text[last:]]), out

    def put(self, regions: list[tuple[int, int, int, int]], tokens: list[int]) -> None:
        """Counts of the regions' new bytes; the first leaf of each takes them, the others become empty."""
        for (a, b, start, stop), n in zip(regions, tokens):
            for k in range(a + 1, b + 1):
                self.set(k, 0, 0)
            self.set(a, stop - start, n)


def heaps(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """heap() of each row's values, one after the other, without the unused place 0; and the rows' offsets. Rows of one size are one matrix."""
    n = np.diff(first)
    size = 1 << np.ceil(np.log2(np.maximum(1, n))).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(2 * size - 1)])
    out = np.zeros(off[-1], np.int64)
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        m = np.zeros((len(rows), 2 * s), np.int64)
        own = np.repeat(np.arange(len(rows)), n[rows])
        k = np.arange(len(own)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        m[own, s + k] = values[first[rows][own] + k]
        while s > 1:
            s >>= 1
            m[:, s : 2 * s] = m[:, 2 * s : 4 * s : 2] + m[:, 2 * s + 1 : 4 * s : 2]
        out[(off[rows][:, None] + np.arange(m.shape[1] - 1)).reshape(-1)] = m[:, 1:].reshape(-1)
    return out, off


def batch_trees(column: pa.Array, vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the units; the bytes and tokens of the leaves; and the rows' first leaves."""
    units, n_bytes, n_tokens, n_leaves, table = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], vocab.units(vocabulary)
    for _, _, data, off in windows(column):
        starts = vocab.unit_starts(data, off)
        rows = table.find(data, starts, np.append(starts[1:], len(data))) if len(starts) else np.zeros(0, np.int64)
        tokens = np.concatenate([[0], np.cumsum(table.n[rows])])  # after find(), which may extend the table
        first = np.searchsorted(starts, off)
        count = np.diff(first)
        leaves = np.maximum(1, -(-count // LEAF))
        row = np.repeat(np.arange(len(count)), leaves)
        k = np.arange(len(row)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        a = first[row] + k * LEAF
        b = np.minimum(a + LEAF, first[row + 1])
        bounds = np.append(starts, len(data))
        units.append(count)
        n_bytes.append(bounds[b] - bounds[a])
        n_tokens.append(tokens[b] - tokens[a])
        n_leaves.append(leaves)
    return np.concatenate(units), np.concatenate(n_bytes), np.concatenate(n_tokens), np.concatenate([[0], np.cumsum(np.concatenate(n_leaves))])


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def tree_of(leaf_bytes: np.ndarray, tree_tokens: np.ndarray) -> Tree:
    """A tree from the columns in which build() keeps it."""
    return Tree(heap(leaf_bytes), np.concatenate([[0], tree_tokens]))


def scrub_edits(text: bytes) -> list[tuple[int, int, bytes]]:
    """The edits of a privacy scrub: mail addresses and long numbers give way to tags."""
    found = []
    if b"@" in text:
        found += [(m.start(), m.end(), b"<mail>") for m in MAIL.finditer(text)]
    found += [(m.start(), m.end(), b"<number>") for m in NUMBER.finditer(text)]
    found.sort()
    return [e for k, e in enumerate(found) if not k or e[0] >= max(x[1] for x in found[:k])]


def build(docs: DataFrame, vocabulary: str = vocab.VOCABULARY) -> DataFrame:
    """(doc_id, text, n_units, n_tokens, leaf_bytes, tree_tokens): each row's tree, leaves in order, token sums in heap order from the root. Write it; recount() reads it."""
    small = base.id_and_text(docs)
    vocab.ship(small.sparkSession, vocabulary)

    def run(batches):
        for b in batches:
            units, n_bytes, n_tokens, first = batch_trees(b.column(1), vocabulary)
            sums, off = heaps(n_tokens, first)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(units), pa.array(sums[off[:-1]]), _lists(n_bytes, first), _lists(sums, off)], ["doc_id", "text", "n_units", "n_tokens", "leaf_bytes", "tree_tokens"])

    return small.mapInArrow(run, f"doc_id {base.id_type(small)}, text string, n_units bigint, n_tokens bigint, leaf_bytes array<bigint>, tree_tokens array<bigint>")


def may_scrub(column: pa.Array) -> np.ndarray:
    """Rows in which scrub_edits() may find something: one search over the whole column, so that rows without are not looked at one by one."""
    data, off = arrow_bytes(column)
    raw, hit = data[off[0] : off[-1]].tobytes(), np.zeros(len(column) + 1, bool)
    at = off - off[0]
    for m in NUMBER.finditer(raw):
        hit[np.searchsorted(at, m.start(), "right") - 1 : np.searchsorted(at, m.end() - 1, "right")] = True
    hit[np.searchsorted(at, np.flatnonzero(data[off[0] : off[-1]] == 64), "right") - 1] = True
    return hit[: len(column)]


def recount(trees: DataFrame, edits=scrub_edits, candidates=may_scrub, vocabulary: str = vocab.VOCABULARY, updated: bool = False) -> DataFrame:
    """(doc_id, text, n_units, n_tokens, leaf_bytes, tree_tokens, n_edits, n_tokens_after, reencoded_bytes) for rows of build(): their state as it was, and the count after the edits, for which only the regions that they touch are encoded. edits: of a text's bytes, or the name of a column of array<struct<start, end, new>>; candidates: which rows of a column of texts may have edits; updated: the text and its state are those after the edits, to be kept."""
    given = isinstance(edits, str)
    vocab.ship(trees.sparkSession, vocabulary)
    columns = ["doc_id", "text", "n_units", "n_tokens", "leaf_bytes", "tree_tokens"]

    def run(batches):
        for b in batches:
            after, n_edits, again = b.column(3).to_numpy().copy(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            todo, texts, kept = [], [], list(b.columns[:6])
            some = np.flatnonzero(b.column(6).is_valid()) if given else np.flatnonzero(candidates(b.column(1))) if candidates else range(b.num_rows)
            for r in map(int, some):
                text = b.column(1)[r].as_buffer()
                raw = text.to_pybytes() if text is not None else b""
                own = [(e["start"], e["end"], (e["new"] or "").encode()) for e in b.column(6)[r].as_py()] if given else edits(raw)
                if own:
                    tree = tree_of(*(b.column(c)[r].values.to_numpy() for c in (4, 5)))
                    new, regions = tree.regions(raw, own)
                    todo.append((r, tree, regions, new))
                    texts += [new[x:y] for _, _, x, y in regions]
                    n_edits[r], again[r] = len(own), sum(y - x for _, _, x, y in regions)
            counts = vocab.batch_counts(pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()), vocabulary).tolist()
            for r, tree, regions, _ in todo:
                tree.put(regions, counts[: len(regions)])
                del counts[: len(regions)]
                after[r] = tree.total
            if updated:
                cols = [c.to_pylist() for c in kept[1:6]]
                for r, tree, _, new in todo:
                    half = len(tree.bytes) // 2
                    units = len(vocab.unit_starts(np.frombuffer(new, np.uint8), np.array([0, len(new)]))) if new else 0
                    for c, v in zip(cols, [new.decode("utf-8", "replace"), units, tree.total, tree.bytes[half : half + len(cols[3][r])].tolist(), tree.tokens[1:].tolist()]):
                        c[r] = v
                kept[1:6] = [pa.array(c, k.type) for c, k in zip(cols, kept[1:6])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_edits), pa.array(after), pa.array(again)], [*columns, "n_edits", "n_tokens_after", "reencoded_bytes"])

    schema = f"doc_id {base.id_type(trees)}, text string, n_units bigint, n_tokens bigint, leaf_bytes array<bigint>, tree_tokens array<bigint>, n_edits bigint, n_tokens_after bigint, reencoded_bytes bigint"
    return trees.select(*columns, *[edits] * given).mapInArrow(run, schema)


def counts(docs: DataFrame, edits=scrub_edits, candidates=may_scrub, vocabulary: str = vocab.VOCABULARY) -> DataFrame:
    """(doc_id, n_units, n_tokens, leaf_bytes, tree_tokens, n_edits, n_tokens_after, reencoded_bytes): per row, the count and the tree of the text as it is, and the count after the edits, from trees that were written and read again."""
    return recount(base.written(build(docs, vocabulary), "trees"), edits, candidates, vocabulary).drop("text")


def op6_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(base.parquet(spark, sf_dir, "documents"))
