"""Vectorised text kernels: words and their 64-bit hashes straight from Arrow buffers.

A *word* is a maximal run of ASCII letters, digits or non-ASCII characters of the lower-cased text; everything else
separates. Null and empty texts have no words. Bytes are looked at in windows of fixed size with a carried state, so that
scratch memory is the same for every text; what grows with a text is the result, 16 bytes a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[0-9a-z\x80-\U0010ffff]+"
SLICE_BYTES = 1 << 20
WINDOW_BYTES = 1 << 19

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)

_WORD = np.zeros(256, dtype=bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_WORD[128:] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    # Arrays of a slice come from the heap, which give_back() trims; larger ones go back to the system when freed.
    _LIBC.mallopt(-3, 32 << 20)
except (OSError, AttributeError):  # another C library
    _LIBC = None


def give_back() -> None:
    """Return unused memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, for one window."""

    tables: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.tables is None:
            made = []
            with np.errstate(over="ignore"):
                for base in (_B, _BI):
                    a = np.full(WINDOW_BYTES + 1, base, U64)
                    a[0] = 1
                    made.append(np.cumprod(a, dtype=U64))
            cls.tables = made[0], made[1]
        return cls.tables


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Words:
    """Words of a slice of texts. ``first[i]:first[i+1]`` are the words of text i; start and end are byte offsets in it."""

    __slots__ = ("hash", "first", "start", "end")

    def __init__(self, hash_: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.hash, self.first, self.start, self.end = hash_, first, start, end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an array of texts; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    base = int(offsets[0])
    raw = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None and offsets[-1] > base else np.zeros(0, np.uint8)
    return raw, offsets - base


class _Open:
    """Hash of a word that began in an earlier window: the sum so far and its length."""

    sum, size = 0, 0

    def add(self, part: int, size: int) -> None:
        self.sum = (self.sum + part * pow(_B, self.size, 1 << 64)) & ((1 << 64) - 1)
        self.size += size


def _join(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    out = np.concatenate(parts) if len(parts) != 1 else parts[0]
    parts.clear()
    return out.astype(dtype, copy=False)


def words(texts: pa.Array, hashes: bool = True, lower: bool | None = None) -> Words:
    """The words of each text. Without hashes the offsets are those in the text as it is, not in lower case, unless asked for."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw, offsets = buffers(pc.utf8_lower(texts) if (hashes if lower is None else lower) else texts)
    n = len(raw)
    wide = np.int32 if n < 1 << 31 else np.int64
    starts, ends, hashed = [np.zeros(0, wide)], [np.zeros(0, wide)], [np.zeros(0, U64)]
    carry, open_ = False, _Open()
    with np.errstate(over="ignore"):
        for a in range(0, n, WINDOW_BYTES):
            part = raw[a : a + WINDOW_BYTES]
            m = len(part)
            w = _WORD[part]
            last = np.empty(m, bool)
            last[0], last[1:] = carry, w[:-1]
            on = w & last
            cuts = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + m)] - a
            on[cuts] = False
            s, e = np.flatnonzero(w & ~on), np.flatnonzero(last & ~on)
            if hashes:
                up, down = _Powers.get()
                c = np.empty(m + 1, U64)
                c[0] = 0
                np.cumsum(_TABLE[part] * up[:m], out=c[1:])
                h = np.empty(len(e), U64)
                k = int(carry and len(e) > 0)
                if k:
                    open_.add(int(c[e[0]]), 0)
                    h[0] = open_.sum
                h[k:] = (c[e[k:]] - c[s[: len(e) - k]]) * down[s[: len(e) - k]]
                hashed.append(mix(h))
                if w[-1]:
                    if carry and not len(e):
                        open_.add(int(c[m]), m)
                    else:
                        open_ = _Open()
                        open_.add(int((c[m : m + 1] - c[s[-1:]])[0] * down[s[-1]]), m - int(s[-1]))
            starts.append((s + a).astype(wide))
            ends.append((e + a).astype(wide))
            carry = bool(w[-1])
        if carry:
            ends.append(np.array([n], wide))
            if hashes:
                hashed.append(mix(np.array([open_.sum], U64)))
    h = _join(hashed, U64)
    start, end = _join(starts, wide), _join(ends, wide)
    first = np.searchsorted(start, offsets.astype(wide)).astype(np.int64)
    own = np.repeat(offsets[:-1].astype(wide), np.diff(first))
    start -= own
    end -= own
    return Words(h, first, start.astype(np.int32, copy=False), end.astype(np.int32, copy=False))


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words with a space before all but the first of each text, as bytes: (bytes, start and end of each word, first word of each text)."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    raw, offsets = buffers(lowered)
    w = words(lowered, hashes=False)
    spaced = w.start > 0
    gaps = (w.start + np.repeat(offsets[:-1], w.counts) - 1)[spaced]
    keep, out = _WORD[raw], raw.copy()
    keep[gaps], out[gaps] = True, 32
    size = (w.end - w.start).astype(np.int64)
    end = np.cumsum(size + spaced)
    return out[keep], end - size, end, w.first


_STEP = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base & ((1 << 64) - 1), U64)
    a[:1] = 1
    return np.cumprod(a, dtype=U64)


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of n words, in order; it ignores where texts end (see valid_grams)."""
    if len(h) < n:
        return np.zeros(0, U64)
    base = (_B + 2 * salt) & ((1 << 64) - 1) | 1
    out = np.empty(len(h) - n + 1, U64)
    with np.errstate(over="ignore"):
        if n > 8:
            up, down = _powers(base, min(len(out), _STEP) + n), _powers(pow(base, -1, 1 << 64), min(len(out), _STEP))
        for at in range(0, len(out), _STEP):
            m = min(_STEP, len(out) - at)
            if n <= 8:
                g = h[at : at + m].copy()
                for j in range(1, n):
                    g = g * U64(base) + h[at + j : at + j + m]
                out[at : at + m] = mix(g)
            else:
                c = np.zeros(m + n, U64)
                np.cumsum(h[at : at + m + n - 1] * up[: m + n - 1], out=c[1:])
                out[at : at + m] = mix((c[n : n + m] - c[:m]) * down[:m])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the words start..end of each range (start < end), over one array of word hashes."""
    out = np.empty(len(start), U64)
    if (np.diff(start) < 0).any():
        order = np.argsort(start, kind="stable")
        out[order] = range_hash(h, start[order], end[order], salt)
        return out
    base = (_B + 2 * salt) & ((1 << 64) - 1) | 1
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = int(np.searchsorted(start, start[at] + _STEP, "left"))
            lo, hi = int(start[at]), int(end[at:to].max())
            c = np.zeros(hi - lo + 1, U64)
            np.cumsum(h[lo:hi] * _powers(base, hi - lo), out=c[1:])
            a, z = start[at:to] - lo, end[at:to] - lo
            out[at:to] = mix((c[z] - c[a]) * _powers(pow(base, -1, 1 << 64), int(a[-1]) + 1)[a] + (z - a).astype(U64))
            at = to
    return out


def valid_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first words of all n-grams that lie in one text, and the text of each."""
    doc = w.doc
    if len(doc) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    return ok, doc[ok]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``limit`` bytes of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(sizes):
        done = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def int64(a: np.ndarray) -> pa.Array:
    """An array of uint64 as signed integers with the same bits."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))
