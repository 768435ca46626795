"""Substring de-duplication by a hash-compared suffix sort.

Suffixes start at content-defined anchors (see ``repeats``) and run to both
sides of them. Two suffixes are compared by their longest common extension,
which a binary search over prefix polynomial hashes finds in a logarithmic
number of steps; a merge sort by this comparison orders the suffixes of each
gram. Adjacent extensions are then compared byte by byte, so a hash collision
is found, and its batch sorted again without hashes. In the two orders (to the
right, and to the left) suffixes that share d bytes are neighbours, so windows
at one distance from the anchor are equal where both neighbourhoods agree.

Cases: a null text is empty and keeps nothing; a text shorter than the window
is never cut; repeated rows are copies of each other, so both are cut; an empty
table gives an empty result; other columns of the input are not read.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm import repeats as R
from tierflow.llm import textnp as T
from tierflow.llm.common import table

WINDOW, GRAM = 200, 32


def _symbols(buf: np.ndarray, off: np.ndarray, family: int):
    return T.byte_symbols(buf, family), *_places(buf, off)


def _places(buf: np.ndarray, off: np.ndarray):
    at = np.arange(len(buf) + 1)
    return off, at[:-1], at[1:]


class Suffixes:
    """Byte strings buf[start:start + n] with O(log n) comparison."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, n: np.ndarray):
        self.buf, self.start, self.n = np.append(buf, np.uint8(0)), start, n
        self.p = T.prefix_hash(T.byte_symbols(buf))
        self.pw = T.powers(len(self.p))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes a and b, by hashes."""
        x, y = self.start[a], self.start[b]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.n[a], self.n[b])
        x, y = np.minimum(x, y), np.maximum(x, y)
        px, py, shift = T.P - self.p[x], T.P - self.p[y], self.pw[y - x]  # x's hash, moved to y
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = T.times(T.reduced(self.p[x + mid] + px), shift) == T.reduced(self.p[y + mid] + py)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: suffix a sorts before b, equals it, or sorts after it."""
        l, na, nb = self.common(a, b), self.n[a], self.n[b]
        x = np.where(l < na, self.buf[self.start[a] + np.minimum(l, na)].astype(np.int16), -1)
        y = np.where(l < nb, self.buf[self.start[b] + np.minimum(l, nb)].astype(np.int16), -1)
        return np.sign(x - y)

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, lcp): suffixes by (group, content), group ascending on entry,
        and each one's common extension with the one before it, -1 at the head
        of a group. All groups are merged at once, runs of 1, 2, 4 ... suffixes."""
        total = len(group)
        order = np.arange(total)
        if not total:
            return order, order.copy()
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(head, total))
        base = np.repeat(head, sizes)
        stop = base + np.repeat(sizes, sizes)
        local = np.arange(total) - base
        width = 1
        while width < sizes.max():
            run = local // width
            other = base + (run ^ 1) * width
            at = np.flatnonzero(other < stop)
            lo, left = other[at], run[at] % 2 == 0
            hi = np.minimum(lo + width, stop[at])
            first, mine = lo.copy(), order[at]
            open_ = np.flatnonzero(lo < hi)
            while len(open_):  # how many of the other run come first
                mid = (lo[open_] + hi[open_]) >> 1
                c = self.before(order[mid], mine[open_])
                goes = np.where(left[open_], c < 0, c <= 0)
                lo[open_] = np.where(goes, mid + 1, lo[open_])
                hi[open_] = np.where(goes, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            to = np.arange(total)
            to[at] = base[at] + run[at] // 2 * 2 * width + local[at] % width + (lo - first)
            merged = np.empty(total, np.int64)
            merged[to] = order
            order, width = merged, width * 2
        lcp = np.full(total, -1, np.int64)
        inner = np.ones(total, bool)
        inner[head] = False
        at = np.flatnonzero(inner)
        lcp[at] = self.common(order[at - 1], order[at])
        if self.verified(order[at - 1], order[at], lcp[at]):
            return order, lcp
        return self.sort_plainly(group)

    def verified(self, a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> bool:
        """Whether a and b share exactly lcp bytes and a doesn't sort after b."""
        for s in range(0, len(a), 4096):
            x, y, l = self.start[a[s:s + 4096]], self.start[b[s:s + 4096]], lcp[s:s + 4096]
            i, at = T.ranges(np.zeros(len(l), np.int64), l), np.repeat(np.arange(len(l)), l)
            if (self.buf[x[at] + i] != self.buf[y[at] + i]).any():
                return False
            na, nb = self.n[a[s:s + 4096]], self.n[b[s:s + 4096]]
            on = (l < na) & (l < nb)
            if (self.buf[(x + l)[on]] >= self.buf[(y + l)[on]]).any() or (~on & (na > nb)).any():
                return False
        return True

    def sort_plainly(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for a batch with a collision."""
        raw = [self.buf[s:s + n].tobytes() for s, n in zip(self.start.tolist(), self.n.tolist())]
        order = np.array(sorted(range(len(raw)), key=lambda i: (group[i], raw[i])), np.int64)
        lcp = np.full(len(raw), -1, np.int64)
        for i in range(1, len(raw)):
            a, b = order[i - 1], order[i]
            if group[a] == group[b]:
                x, y = raw[a], raw[b]
                m = min(len(x), len(y))
                differ = np.flatnonzero(np.frombuffer(x, np.uint8, m) != np.frombuffer(y, np.uint8, m))
                lcp[i] = differ[0] if len(differ) else m
        return order, lcp


def _judge(window: int, b: R.Batch):
    """Windows that another content of the gram has too."""
    total, n = len(b.group), len(b.buf)
    anchor, right = b.first + b.left, b.n - b.left
    by_right, lcp_right = Suffixes(b.buf, anchor, right).sort(b.group)
    by_left, lcp_left = Suffixes(b.buf[::-1], n - anchor, b.left).sort(b.group)
    right_class, left_class = np.empty(total, np.int64), np.empty(total, np.int64)
    who, at = [], []
    for back in range(int(b.left.max(initial=0)) + 1):  # the window begins so far before the anchor
        fit = np.flatnonzero((b.left >= back) & (right >= window - back))
        if len(fit) < 2:
            continue
        right_class[by_right] = np.cumsum(lcp_right < window - back)
        left_class[by_left] = np.cumsum(lcp_left < back)
        key = right_class[fit] * (total + 1) + left_class[fit]
        o = np.argsort(key, kind="stable")
        same = key[o[1:]] == key[o[:-1]]
        hit = fit[o[np.append(same, False) | np.append(False, same)]]
        who.append(hit)
        at.append(b.left[hit] - back)
    if not who:
        none = np.zeros(0, np.int64)
        return none, none, none
    who, at = np.concatenate(who), np.concatenate(at)
    return who, at, at


BYTES = R.Kind(WINDOW, GRAM, _symbols, _places, _judge, first_stays=False)


def _apply(text: bytes, start: np.ndarray, end: np.ndarray):
    if not len(start):
        return text, []
    kept, at = [], 0
    spans = list(zip(start.tolist(), end.tolist()))
    for s, e in spans:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept), [{"start": s, "end": e} for s, e in spans]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: R.Kind = BYTES) -> DataFrame:
    """doc_id, kept (the bytes that stay) and spans (maximal removed runs of
    bytes): every byte of a window that also starts elsewhere goes."""
    return R.cut_out(docs, doc_id, text, kind, _apply, "kept binary, spans array<struct<start:long,end:long>>")


def op7_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
                      removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
