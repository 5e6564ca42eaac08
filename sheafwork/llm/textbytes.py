"""Vectorised work on many texts at once: one flat byte array and the place where each text starts.

Everything here is plain numpy over the rows of one Arrow batch; the partitioning and shuffling
of those rows is Spark's.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
#: Word separators: space, and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flatten(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and n + 1 offsets.  None counts as an empty text."""
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def flat_column(column) -> tuple[np.ndarray, np.ndarray]:
    """The same as flatten() for an Arrow column of strings or binaries, without a Python object per row."""
    import pyarrow as pa

    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most_bytes: int = 1 << 16, most_rows: int = 1024):
    """Row ranges (from, to) of about so many bytes at most, for work that stays in the CPU's caches."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = min(max(b, a + 1), a + most_rows, n)
        yield a, b
        a = b


def segment_hash(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the segments, none of them empty, that make up ``flat`` one after the other."""
    if not len(lengths):
        return np.zeros(0, _U)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(flat), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), lengths)
    terms = _powers(int(lengths.max()))[place]
    terms *= flat.astype(_U) + _U(1)
    return mix(np.add.reduceat(terms, first) ^ mix(lengths.astype(_U)))


_POWERS = np.ones(1, _U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n, _MULT | _U(1), _U)]))
    return _POWERS


def words(flat: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: (start, length, hash, number of words of each text)."""
    if not len(flat):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    body = _LOWER[flat] if lower else flat
    inside = ~_IS_SPACE[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(flat))]  # a text's end also ends a word
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return start, end - start, segment_hash(body[inside], end - start), counts


def shingles(word_hash: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text, with repeats, and how many each text has.

    A text with fewer words than ``size`` has its whole sequence as one shingle, one without words none.
    """
    n = len(counts)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not len(word_hash):
        return np.zeros(0, _U), many
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(n), many)
    at = np.repeat(first, many) + (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    width = np.minimum(counts, size)[owner]
    h = np.zeros(len(at), _U)
    for j in range(size):
        on = width > j
        term = mix(word_hash[np.minimum(at + j, len(word_hash) - 1)] + _U((j + 1) * int(_MULT) % 2**64))
        h = np.where(on, h * _MULT + term, h)
    return mix(h ^ width.astype(_U)), many


def kgram_hash(flat: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes in a row, by doubling; one per place where k bytes are left."""
    if len(flat) < k:
        return np.zeros(0, _U)
    have, h, done, out = 1, (flat.astype(_U) + _U(1)) * _MULT, 0, None
    rest = k
    while rest:
        if rest & 1:
            part = h[done : len(flat) - have + 1]
            out = part.copy() if out is None else out[: len(part)] * _powers(have + 1)[have] + part
            done += have
        rest >>= 1
        if rest:
            h = h[: len(h) - have] * _powers(have + 1)[have] + h[have:]
            have *= 2
    return mix(out[: len(flat) - k + 1])
