"""Words of whole Arrow batches as numpy arrays: spans, 64-bit hashes and shingles, without a Python object per word.

Word hashes are 64-bit polynomial hashes over random byte values, mixed at the end. Equal words have equal hashes; two
different words share one with a chance of about 1e-18.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of the words of space-separated text: all but space and \t \n \v \f \r.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters, digits and every byte of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20

BYTE_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 4096), BASE, U64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=U64)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text at most, whole rows always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_buffer(batch.column(text))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words: maximal runs of ``table`` bytes inside a row."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 2, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:-1])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each non-empty, disjoint, ordered span."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    take = place + np.repeat(starts, lens)
    return mix(np.add.reduceat(values[data[take]] * powers(int(lens.max()))[place], at))


def hash_text(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes; an empty row's is 0."""
    out = np.zeros(len(offsets) - 1, U64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    out[full] = hash_spans(data, offsets[:-1][full], offsets[1:][full])
    return out


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of all runs of ``k`` words inside a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * BASE + words[j : j + n]
    whole = rows[:n] == rows[k - 1 :]
    return mix(h[whole]), rows[:n][whole]
