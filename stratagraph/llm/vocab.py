"""Token ids of whole batches, from a tiktoken rank file.

Byte-level BPE with the usual pre-token pattern never joins a non-space and the white space after it, so a text is cut
there into units (" word", "\\nWord,") whose ids do not depend on their neighbours. Units recur; each distinct one is
encoded once and its ids are kept in a per-worker table (emptied when full: the table saves time, it never changes ids).
New units are encoded as one text where no two of them can join there: those that end in white space go by themselves.
Units are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from stratagraph.llm.textbytes import arrow_bytes, span_hashes, windows

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TABLE_UNITS = 1_000_000


_sent: set[tuple[str, str]] = set()


def ship(spark: SparkSession, path: str = VOCABULARY) -> None:
    """Sends the vocabulary file to the executors, once per SparkContext; only the driver needs it at its path."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)


def _at(path: str) -> str:
    """The file on this machine: the one that was sent, else the path itself."""
    own = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(path)) if SparkFiles._is_running_on_worker else path
    return own if os.path.exists(own) else path


@lru_cache(2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    ranks = {}
    with open(_at(path), "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin: at each row's start, and at white space that follows anything that is surely not white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    at = np.flatnonzero(cut)
    at = at[(data[at - 1] >= 0x80) & (at >= 2)] if len(at) else at
    if len(at):
        # the last character before is not ASCII: cut only where it can't be one of Unicode's white spaces
        one, two, three = data[at - 1], data[at - 2], data[np.maximum(at - 3, 0)]
        cut[at[(two == 0xC2) & ((one == 0x85) | (one == 0xA0))]] = False
        cut[at[((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))]] = False
    cut[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(cut)


def ends_blank(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the spans that end there have one of Unicode's white spaces as their last character."""
    one, two, three = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
    wide = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
    wide |= (one == 0x80) & (((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80)))
    return (one == 32) | ((one >= 9) & (one <= 13)) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | wide


class Units:
    """The table of one worker: hash of a unit -> its ids."""

    def __init__(self, path: str) -> None:
        self.encode = encoding(path)
        self.bytes_of = np.array([len(self.encode.decode_single_token_bytes(k)) for k in range(self.encode.n_vocab)], np.int64)
        self.empty()

    def empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.flat: np.ndarray = np.zeros(0, np.uint32)

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw, encode = data.tobytes(), self.encode
        # units from a white space to anything else can be encoded side by side; one that ends in white space would take the next one's in
        joint = ((data[starts] == 32) | ((data[starts] >= 9) & (data[starts] <= 13))) & ~ends_blank(data, ends)
        if joint.any():
            side = b"".join([raw[a:b] for a, b in zip(starts[joint].tolist(), ends[joint].tolist())])
            try:
                together = encode.encode_to_numpy(side.decode("utf-8"), disallowed_special=())
            except UnicodeDecodeError:  # what stands in for wrong bytes has another length
                joint[:] = False
        flat, n = [np.zeros(0, np.uint32)], np.zeros(len(starts), np.int64)
        order = np.concatenate([np.flatnonzero(~joint), np.flatnonzero(joint)])
        for k in order[: len(order) - int(joint.sum())].tolist():
            ids = encode.encode_to_numpy(raw[starts[k] : ends[k]].decode("utf-8", "replace"), disallowed_special=())
            flat.append(ids)
            n[k] = len(ids)
        k = order[len(order) - int(joint.sum()) :]
        if len(k):
            done = np.searchsorted(np.cumsum(self.bytes_of[together]), np.cumsum(ends[k] - starts[k]))
            n[k] = np.diff(done + 1, prepend=0)
            flat.append(together)
        flat = np.concatenate(flat)
        where = np.cumsum(n[order]) - n[order]
        at = np.empty(len(n), np.int64)
        at[order] = len(self.flat) + where
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at = np.concatenate([self.at, at])[order]
        self.n = np.concatenate([self.n, n])[order]
        self.flat = np.concatenate([self.flat, flat])

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's row of each unit; unseen units are learnt first."""
        u, first, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        for _ in range(2):
            k = np.searchsorted(self.keys, u)
            known = self.keys[np.minimum(k, len(self.keys) - 1)] == u if len(self.keys) else np.zeros(len(u), bool)
            if known.all():
                return k[inverse]
            if len(self.keys) + int((~known).sum()) > TABLE_UNITS:
                self.empty()
                known[:] = False
            new = first[~known]
            self.learn(data, starts[new], ends[new], u[~known])
        return np.searchsorted(self.keys, u)[inverse]


@lru_cache(2)
def units(path: str) -> Units:
    return Units(path)


def batch_counts(column: pa.Array, path: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text; 0 for null and empty ones."""
    out, table = np.zeros(len(column), np.int64), units(path)
    for a, b, data, off in windows(column):
        starts = unit_starts(data, off)
        if not len(starts):
            continue
        rows = table.find(data, starts, np.append(starts[1:], len(data)))
        n = np.concatenate([[0], np.cumsum(table.n[rows])])[np.searchsorted(starts, off)]
        out[a:b] = np.diff(n)
    return out


def batch_ids(column: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the texts' offsets in them."""
    flat, lengths, table = [np.zeros(0, np.uint32)], np.zeros(len(column), np.int64), units(path)
    for a, b, data, off in windows(column):
        starts = unit_starts(data, off)
        if not len(starts):
            continue
        rows = table.find(data, starts, np.append(starts[1:], len(data)))
        n = table.n[rows]
        total = np.concatenate([[0], np.cumsum(n)])
        flat.append(table.flat[np.repeat(table.at[rows] - total[:-1], n) + np.arange(total[-1])])
        lengths[a:b] = np.diff(total[np.searchsorted(starts, off)])
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(lengths)])
