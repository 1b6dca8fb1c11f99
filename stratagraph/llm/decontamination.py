"""Operator 7, benchmark decontamination: Wu-Manber search for test strings in all texts at once.

Texts and benchmark items are brought to the same form: letters folded, every run of characters that are no letters,
digits or marks one space, a space at either end; characters of scripts without spaces are words of their own. The test
strings are all runs of ``ngram`` words of every item (the whole item where it is shorter), so an item is found in part,
and only at word bounds. The shift table says, by the hash of a block of ``BLOCK`` bytes, how far a search may jump; where
it says 0, the bucket of the suffix hash holds the test strings to compare byte by byte. Many places of a batch search at
the same time: long texts are entered every ``LANE`` bytes, with each entry responsible for the matches that end in its
stretch.

Test strings are kept as places in the items' text, about 50 bytes each, not as strings. The driver holds and sends the
items' ids and texts, ``MOST_BYTES`` of text at most; each Python worker makes its tables of them once. A larger benchmark
is searched in parts of that size, one after the other.

Defined results: null and empty texts and items without a word match nothing; repeated items keep their own ids, rows
with the same item_id (null too) are one item; ids may have any type; repeated documents are found each. Columns besides
id and text are not read. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import base
from stratagraph.llm.textbytes import SPACELESS, WORD, arrow_bytes, lettered, mix, runs, span_hashes, windows

NGRAM = 10
BLOCK = 6
LANE = 1024
TABLE_BITS = 20
MOST_BYTES = 32 << 20
U = np.uint64


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of each row, each with a space at either end, and the rows' offsets."""
    low, off = lettered(data, off)
    low = np.where(WORD[low], low, 32).astype(np.uint8)
    n = len(low)
    keep = np.ones(n, bool)
    if n:
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
        first = off[:-1][np.diff(off) > 0]
        keep[first] = low[first] != 32  # the space at the start comes below
        last = off[1:][np.diff(off) > 0] - 1
        end = low[last] == 32
        keep[last[end]] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    rows = len(off) - 1
    out_off = total[off] + 2 * np.arange(rows + 1)
    out = np.full(out_off[-1], 32, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(off))
    if n:
        at = total[:-1][keep] + 2 * row[keep] + 1
        out[at] = low[keep]
    return out, out_off


class Patterns:
    """Shift table, suffix buckets and the test strings with the items they come from.

    A test string is a place in ``text``, the items' normal forms one after the other; equal ones (by a 64-bit hash of
    their bytes) are one. items and total go by the items' numbers.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, number: np.ndarray, ngram: int = NGRAM) -> None:
        """data, off: the items' texts; number: which item each is of, from 0."""
        self.text, rows = normal(data, off)
        starts, ends = runs(self.text != 32, rows)
        first = np.searchsorted(starts, rows)
        count = np.diff(first)
        n = np.where(count > 0, np.maximum(1, count - ngram + 1), 0)
        row = np.repeat(np.arange(len(count)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        a = starts[first[row] + k] - 1 if len(row) else np.zeros(0, np.int64)
        e = ends[first[row] + np.minimum(k + ngram, count[row]) - 1] + 1 if len(row) else np.zeros(0, np.int64)
        h, at, same = np.unique(span_hashes(self.text, a, e), return_index=True, return_inverse=True) if len(row) else (np.zeros(0, U), *[np.zeros(0, np.int64)] * 2)
        pairs = np.unique(np.stack([same, number[row]]), axis=1) if len(row) else np.zeros((2, 0), np.int64)  # (string, item)
        self.starts, self.ends = a[at], e[at]
        self.item_first, self.item_of = np.searchsorted(pairs[0], np.arange(len(h) + 1)), pairs[1]
        self.total = np.bincount(pairs[1], minlength=int(number.max(initial=-1)) + 1)
        self.m = m = int((self.ends - self.starts).min(initial=1 << 30)) if len(h) else 0
        self.block = b = min(BLOCK, m)
        self.shift = np.full(1 << TABLE_BITS, max(0, m - b + 1), np.int32)
        for d in range(m - b + 1) if len(h) else []:
            key = self.keys(self.text, self.starts + d + b)
            np.minimum.at(self.shift, key, m - b - d)
        key = self.keys(self.text, self.starts + m) if len(h) else np.zeros(0, np.int64)
        self.by_key = np.argsort(key, kind="stable")
        self.bucket = np.searchsorted(key[self.by_key], np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)
        self.raw = self.text.tobytes()

    def string(self, s: int) -> bytes:
        return self.raw[self.starts[s] : self.ends[s]]

    def keys(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the block that ends before each place."""
        h = np.zeros(len(ends), U)
        for k in range(self.block):
            h = (h << U(8)) | data[ends - self.block + k].astype(U) if k < 8 else mix(h) ^ data[ends - self.block + k]
        return (mix(h) >> U(64 - TABLE_BITS)).astype(np.int64)

    def search(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """(row, test string) of every occurrence in normal rows."""
        found: list[tuple[int, int]] = []
        if not len(self.starts) or not len(data):
            return found
        # an entry at e answers for places whose first m bytes end in [e, stop)
        spans = np.diff(off) - self.m + 1
        n = np.maximum(0, -(-spans // LANE))
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = off[row] + self.m + k * LANE
        stop = np.minimum(at + LANE, off[row + 1] + 1)
        raw = None
        while len(at):
            key = self.keys(data, at)
            jump = self.shift[key]
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                raw = raw or data.tobytes()
                for e, r, b in zip(at[zero].tolist(), row[zero].tolist(), key[zero].tolist()):
                    a, end = e - self.m, int(off[r + 1])
                    for s in self.by_key[self.bucket[b] : self.bucket[b + 1]].tolist():
                        x = self.raw[self.starts[s] : self.ends[s]]
                        if a + len(x) <= end and raw.startswith(x, a):
                            found.append((r, s))
            at = at + np.maximum(jump, 1)
            more = at < stop
            at, row, stop = at[more], row[more], stop[more]
        return found


@dataclass
class Part:
    """Some items of the benchmark: ids by number, and their texts."""

    ids: pa.Array
    number: np.ndarray
    data: np.ndarray
    off: np.ndarray
    ngram: int


def parts(benchmark: DataFrame, ngram: int = NGRAM, item_col: str = "item_id", most_bytes: int = MOST_BYTES) -> Iterator[Part]:
    """The benchmark in parts of whole items, of about most_bytes of text each, one at a time; one empty part if there is nothing to find."""
    small = base.id_and_text(benchmark, item_col).where("text <> ''")
    sizes = small.groupBy(F.xxhash64(F.col("doc_id").cast("string")).alias("h")).agg(F.sum(F.octet_length("text")).alias("n"))
    n = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // most_bytes))
    for k in range(n):
        got = small.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(n)) == k).orderBy(F.col("doc_id").asc_nulls_first(), "text").toArrow().combine_chunks()
        ids = got.column("doc_id")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        try:
            ids = ids.dictionary_encode("encode")
            ids, number = ids.dictionary, ids.indices.to_numpy().astype(np.int64)
        except pa.ArrowNotImplementedError:  # nested ids, in order
            values = ids.to_pylist()
            new = np.array([not k or values[k] != values[k - 1] for k in range(len(values))], bool)
            ids, number = ids.take(pa.array(np.flatnonzero(new))), np.cumsum(new) - 1
        data, off = arrow_bytes(got.column("text"))
        yield Part(ids, number, data[off[0] : off[-1]], off - off[0], ngram)


_made: dict[int, tuple[Part, Patterns]] = {}


def patterns_of(shared) -> Patterns:
    """This worker's tables of a broadcast part; those of the last part are kept."""
    key = id(shared.value)
    if key not in _made:
        _made.clear()
        p = shared.value
        _made[key] = p, Patterns(p.data, p.off, p.number, p.ngram)
    return _made[key][1]


def _found(small: DataFrame, shared, kind: str) -> DataFrame:
    def find(batches):
        p, ids = patterns_of(shared), shared.value.ids
        for b in batches:
            rows, strings = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, _, data, off in windows(b.column(1)):
                hits = np.array(p.search(*normal(data, off)), np.int64).reshape(-1, 2)
                rows.append(first + hits[:, 0])
                strings.append(hits[:, 1])
            pair = np.stack([np.concatenate(rows), np.concatenate(strings)])
            if pair.shape[1]:
                pair = np.unique(pair, axis=1)  # a string counts once a text
            n = np.diff(p.item_first)[pair[1]]
            item = p.item_of[np.repeat(p.item_first[pair[1]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            hit, count = np.unique(np.stack([np.repeat(pair[0], n), item]), axis=1, return_counts=True) if len(item) else (pair, np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit[0])), ids.take(pa.array(hit[1])), pa.array(count), pa.array(count / np.maximum(1, p.total[hit[1]]) if len(p.total) else np.zeros(0))], ["doc_id", "item_id", "n_grams", "share"])

    return small.mapInArrow(find, f"doc_id {base.id_type(small)}, item_id {kind}, n_grams bigint, share double")


def matches(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, item_col: str = "item_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, n_grams, share): for each document and item in it, how many of the item's test strings it has and their share. Of several parts each is searched and written before the next is made."""
    small, kind, out, before = base.id_and_text(docs), benchmark.schema[item_col].dataType.simpleString(), [], None
    for part in parts(benchmark, ngram, item_col, most_bytes):
        if before:
            out.append(base.written(_found(small, before, kind), "matches"))
            before.destroy()
        before = docs.sparkSession.sparkContext.broadcast(part)
    return reduce(DataFrame.unionByName, [*out, _found(small, before, kind)])


def clean(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents that hold no test string of any item, with all their columns; null and empty texts stay. Of several parts each is searched and what it leaves written before the next is made."""
    before = None

    def left(rows: DataFrame, shared) -> DataFrame:
        @F.arrow_udf("boolean")
        def leaks(text: pa.Array) -> pa.Array:
            p, out = patterns_of(shared), np.zeros(len(text), bool)
            for first, _, data, off in windows(text):
                out[[first + r for r, _ in p.search(*normal(data, off))]] = True
            return pa.array(out)

        return rows.where(~leaks(rows["text"].cast("string")))

    base.id_and_text(docs)  # sends the package
    for part in parts(benchmark, ngram, most_bytes=most_bytes):
        if before:
            docs = base.written(left(docs, before), "clean")
            before.destroy()
        before = docs.sparkSession.sparkContext.broadcast(part)
    return left(docs, before)


def op7_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(base.parquet(spark, sf_dir, "documents"), base.parquet(spark, sf_dir, "benchmark"))


_ALONE = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SPACELESS)
_FORM = f"' ' || trim(regexp_replace(regexp_replace(translate(lower(text), chr(0), ' '), '([{_ALONE}])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')) || ' '"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_FORM} AS form FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, string_split(trim({_FORM}), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, ' ' || array_to_string(list_slice(w, a, a + {NGRAM} - 1), ' ') || ' ' AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {NGRAM} + 1) + 1)) AS a FROM b WHERE w[1] <> '')),
t AS (SELECT item_id, count(*) AS total FROM g GROUP BY item_id),
h AS (SELECT row_no, doc_id, item_id, count(*) AS n_grams FROM d, g WHERE contains(form, gram) GROUP BY row_no, doc_id, item_id)
SELECT doc_id, item_id, n_grams, CAST(n_grams AS DOUBLE) / total AS share FROM h JOIN t USING (item_id)
"""
