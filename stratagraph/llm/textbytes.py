"""Whole Arrow batches of text as one byte array: windows of rows, words, hashes and n-grams without a loop over rows.

Text is seen as UTF-8. Letters fold to lower case; a word is a run of letters, digits and marks, and a character of a
script without spaces is a word. ASCII and Latin-1 letters take a few table lookups a byte; rows with other characters go
through Python's tables one by one. A null text counts as an empty one. A window holds whole rows
and about ``size`` bytes; a longer row is a window of its own, so no text is cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
WINDOW = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, WINDOW * 5 // 4)
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(m, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def windows(column: pa.Array, size: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, local offsets of the rows and of the end) for runs of whole rows."""
    data, off = arrow_bytes(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def folded(data: np.ndarray) -> np.ndarray:
    low = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    if len(at):
        x = low[at]
        low[at] = np.where((x >= 0x80) & (x <= 0x9E) & (x != 0x97), x + 0x20, x)
    return low


class _Forms(dict):
    """What stands for a character: its lower case, a space if it is no letter, digit or mark, spaces around one of a script without spaces. ASCII stays."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code < 128:
            out = c
        elif unicodedata.category(c)[0] not in "LNM":
            out = " "
        else:
            out = f" {c} " if any(a <= code <= b for a, b in SPACELESS) else c.lower()
        self[code] = out
        return out


#: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
SPACELESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_FORMS = _Forms()


def lettered(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """folded(), with other rows than those of ASCII and Latin-1 letters brought to the same form, in which bytes from 0x80 on are word characters; and the rows' offsets in it."""
    wide = (data >= 0xC4) | (data == 0xC2)
    wide[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    at = np.flatnonzero(wide)
    low = folded(data)
    if not len(at):
        return low, off
    sizes, parts, last = np.diff(off), [], 0
    for r in np.unique(np.searchsorted(off, at, "right") - 1).tolist():
        form = data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace").translate(_FORMS).encode()
        parts += [low[last : off[r]], LOWER[np.frombuffer(form, np.uint8)]]
        sizes[r], last = len(form), off[r + 1]
    return np.concatenate([*parts, low[last:]]), np.concatenate([[0], np.cumsum(sizes)])


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at the rows' starts."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(mask[1:], mask[:-1], out=edge[1:n])
    edge[off] = True
    at = np.flatnonzero(edge)
    starts = mask[at[:-1]]
    return at[:-1][starts], at[1:][starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    p, q = powers(len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U))


def words(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: start, end, hash; and of each row and the end: its first word's number."""
    low, off = lettered(data, off) if fold else (data, off)
    starts, ends = runs(WORD[low], off)
    return starts, ends, span_hashes(low, starts, ends), np.searchsorted(starts, off)


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), for runs of anything but ASCII white space, as they are written."""
    starts, ends = runs(~((data == 32) | ((data >= 9) & (data <= 13))), off)
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, off)


def owner(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value per row, 0 for rows without items."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def gram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row (of all words of a row that has from 1 to n - 1), and the rows' first ones."""
    count = np.diff(first)
    out = h.copy() if n == 1 else None
    if n == 1:
        return out, first
    g = np.zeros(len(h), U)
    for k in range(n):
        if k < len(h):
            g[: len(h) - k] += mix(h[k:] + U(k + 1)) * BASE
    last = np.repeat(first[1:], count)
    whole = np.arange(len(h)) + n <= last
    short = np.flatnonzero((count > 0) & (count < n))
    for r in short:
        g[first[r]] = np.bitwise_xor.reduce(mix(h[first[r] : first[r + 1]] + np.arange(1, count[r] + 1).astype(U)))
        whole[first[r]] = True
    firsts = np.concatenate([[0], np.cumsum(whole)])[first]
    return mix(g[whole]), firsts


def distinct_per_row(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in each row, ascending, how often each occurs, and the rows' first ones."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    row = owner(first)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.empty(len(h), bool)
    new[0] = True
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(row[at], np.arange(len(first)))
