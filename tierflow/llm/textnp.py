"""Array helpers that run inside Spark tasks.

A *chunk* is a run of whole documents whose UTF-8 bytes lie end to end in one
``uint8`` array, with ``off[i]:off[i + 1]`` the bytes of document ``i``. A
chunk stops at ``CHUNK_BYTES``; a longer document is a chunk of its own, so
memory follows the longest document and never a batch of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK_BYTES = 1 << 20
BLOCK = 1 << 14
U = np.uint64
GAMMA = U(0x9E3779B97F4A7C15)
#: Polynomial hashes are modulo this prime; 0 and 1 are two independent families.
P = U((1 << 61) - 1)
BASES = (0x1A7C9B3D5E8F2461, 0x0D3B9F517C2E684B)

#: ASCII white space, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = (x & P) + (x >> U(61))
    np.subtract(x, P, out=x, where=x >= P)
    return x


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, for a and b below P; no partial sum leaves 64 bits."""
    if len(a) > BLOCK and len(a) == len(b):  # parts that stay in the processor's cache
        return np.concatenate([times(a[i:i + BLOCK], b[i:i + BLOCK]) for i in range(0, len(a), BLOCK)])
    low = U(0xFFFFFFFF)
    ah, al, bh, bl = a >> U(32), a & low, b >> U(32), b & low
    mid, lo = ah * bl + al * bh, al * bl
    x = ah * bh << U(3)  # 2 ** 64 is 8
    x += (mid >> U(29)) + ((mid & U((1 << 29) - 1)) << U(32))
    x += (lo & P) + (lo >> U(61))
    return reduced(x)


_BYTE = [mix(np.arange(1, 257, dtype=U) + U(k << 20)) % P for k in (0, 1)]
_POW: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, family: int = 0, inverse: bool = False) -> np.ndarray:
    """The base (or its inverse) to the power i, i < n, modulo P; kept between calls."""
    p = _POW.get((family, inverse))
    if p is None or len(p) < n:
        base, want = pow(BASES[family], -1 if inverse else 1, int(P)), max(n, CHUNK_BYTES + 4096)
        p = np.ones(1, U)
        while len(p) < want:
            more = p[: want - len(p)]
            p = np.concatenate([p, times(more, np.full(1, pow(base, len(p), int(P)), U))])
        _POW[family, inverse] = p
    return p[:n]


def prefix_hash(symbols: np.ndarray, family: int = 0) -> np.ndarray:
    """Q with Q[i] the polynomial hash of the first i symbols (64-bit each)."""
    out = np.zeros(len(symbols) + 1, U)
    pw, last = powers(len(symbols), family), U(0)
    for i in range(0, len(symbols), BLOCK):
        t = times(reduced(symbols[i:i + BLOCK]), pw[i:i + BLOCK])
        high = reduced(np.cumsum(t >> U(31)))  # sums of 30 and 31 bits don't overflow
        t = reduced(((high << U(31)) & P) + (high >> U(30)) + np.cumsum(t & U((1 << 31) - 1)) + last)
        out[i + 1:i + 1 + len(t)] = t
        last = t[-1]
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of symbols start:end, the same wherever they stand."""
    return times(reduced(p[end] + P - p[start]), powers(len(p), family, True)[start])


def byte_symbols(buf: np.ndarray, family: int = 0) -> np.ndarray:
    return _BYTE[family][buf]


def chunks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a column of texts;
    a null text has no bytes."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    arr = text.cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, arr.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def unpacked(frames: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same of a column of Zstandard frames (null: no bytes)."""
    unpack, lo, texts, size = zstandard.ZstdDecompressor(), 0, [], 0
    for i, z in enumerate(frames):
        z = z.as_py()
        texts.append(unpack.decompress(z) if z else b"")
        size += len(texts[-1])
        if size >= CHUNK_BYTES or i + 1 == len(frames):
            off = np.append(0, np.cumsum([len(x) for x in texts]))
            yield lo, i + 1, np.frombuffer(b"".join(texts), np.uint8), off
            lo, texts, size = i + 1, [], 0


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte ``start`` and ``end`` of
    each, ``doc`` it stands in, and ``first[i]:first[i + 1]`` those of document i."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        word = ~SPACE[buf]
        cut = np.zeros(len(buf) + 1, bool)  # a document starts here
        cut[off[:-1]] = True
        before = np.zeros(len(buf), bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.zeros(len(buf), bool)
        after[:-1] = word[1:] & ~cut[1:-1]
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.buf = buf

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        p = prefix_hash(byte_symbols(self.buf, family), family)
        return mix(span_hash(p, self.start, self.end, family) + ((self.end - self.start).astype(U) << U(40)))


    def codes(self) -> np.ndarray:
        """A number for each word, the same for equal words only."""
        return span_codes(self.buf, self.start, self.end, self.hashes())


def span_codes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """A number for each span of bytes, the same for equal ones only: spans of one
    hash are compared byte by byte, and numbered plainly should any differ."""
    if hashes is None:
        hashes = mix(span_hash(prefix_hash(byte_symbols(buf)), start, end) + ((end - start).astype(U) << U(40)))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    if same_bytes(buf, start, end, first[code]).all():
        return code
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(buf[s:e].tobytes(), len(seen)) for s, e in zip(start.tolist(), end.tolist())])


def same_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether span i holds the same bytes as span other[i]."""
    size = end - start
    ok = size == size[other]
    for lo in range(0, len(start), 1 << 14):  # spans of a document at most, a block at a time
        at = np.flatnonzero(ok[lo:lo + (1 << 14)] & (other[lo:lo + (1 << 14)] != np.arange(lo, min(lo + (1 << 14), len(start))))) + lo
        i = ranges(np.zeros(len(at), np.int64), size[at])
        who = np.repeat(at, size[at])
        ok[who[buf[start[who] + i] != buf[start[other[who]] + i]]] = False
    return ok


def gram_codes(code: np.ndarray, k: int) -> np.ndarray:
    """A number for the k codes from each position (len - k + 1 of them), the same for equal ones only."""
    out = code[: len(code) - k + 1].astype(np.int64)
    for j in range(1, k):
        out = np.unique(out * (int(code.max()) + 1) + code[j: len(code) - k + 1 + j], return_inverse=True)[1]
    return out


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each position (len - k + 1 of them)."""
    if len(symbols) < k:
        return np.zeros(0, U)
    p = prefix_hash(symbols)
    at = np.arange(len(symbols) - k + 1)
    return mix(span_hash(p, at, at + k))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    shift = np.repeat(first - (np.cumsum(count) - count), count)
    return np.arange(total) + shift


def anchors(symbols: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Content-defined anchors of all windows of ``window`` symbols.

    A window's anchor is the start of its least-hashed k-gram, the leftmost of
    equal ones, so equal windows have equal anchors at equal distances. Runs of
    windows with one anchor come back as (doc, lo, hi, anchor, gram hash): the
    windows that start at lo..hi, positions counted in the chunk.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U))
    n = len(symbols)
    if n < window:
        return none
    gram = gram_hashes(symbols, k)
    best = (gram & ~U(0xFFFFFFFF)) | np.arange(len(gram), dtype=U)  # leftmost wins a tie
    width, want = 1, window - k + 1
    while width < want:
        step = min(width, want - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    count = np.maximum(np.diff(first) - window + 1, 0)
    at = ranges(first[:-1], count)
    if not len(at):
        return none
    doc = np.repeat(np.arange(len(count)), count)
    anchor = (best[at] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return doc[head], at[head], at[tail], anchor[head], gram[anchor[head]]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans; touching ones are joined."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    head = np.flatnonzero(new)
    return start[head], end[np.append(head[1:], len(start)) - 1]
