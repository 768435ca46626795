"""The two substring operators against brute force over all windows."""
import collections

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA
from tierflow.llm import repeats, suffix_sort, suffix_tree
from tierflow.llm import textnp as T


def cut_bytes(rows, window=200):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i:i + window] for i in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if count[b[p:p + window]] > 1:
                gone[p:p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, kept, runs))
    return out


def cut_words(rows, window=20):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    for i, w in split:
        for p in range(len(w) - window + 1):
            key, at = tuple(w[p:p + window]), (order(i), p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (order(i), p):
                gone.update(range(p, p + window))
        out.append((i, b" ".join(x for p, x in enumerate(w) if p not in gone), len(w)))
    return out


def as_sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_bytes(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = suffix_sort.remove_repeats(docs).collect()
    want = as_sorted(cut_bytes([(r[0], r[1]) for r in odd]))
    assert as_sorted([(r.doc_id, bytes(r.kept), len(r.spans)) for r in got]) == want


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_words(spark, docs, odd, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = suffix_tree.remove_repeats(docs).collect()
    want = as_sorted(cut_words([(r[0], r[1]) for r in odd]))
    assert as_sorted([(r.doc_id, bytes(r.kept), r.n_words) for r in got]) == want


def test_empty_tables(nothing):
    assert suffix_sort.remove_repeats(nothing).count() == 0
    assert suffix_tree.remove_repeats(nothing).count() == 0


def test_suffix_order_and_collisions(monkeypatch):
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 300)
    n = np.minimum(rng.integers(0, 90, 300), 4000 - start)
    group = np.sort(rng.integers(0, 20, 300))
    s = suffix_sort.Suffixes(buf, start, n)
    order, lcp = s.sort(group)
    plain, plain_lcp = s.sort_plainly(group)
    raw = lambda o: [(group[i], bytes(buf[start[i]:start[i] + n[i]])) for i in o]
    assert raw(order) == raw(plain) == sorted(raw(range(300)))
    assert (lcp == plain_lcp).all()
    # hashes that always collide: bytes are compared, and the batch sorted plainly
    s.p = np.zeros_like(s.p)
    order, lcp = s.sort(group)
    assert raw(order) == raw(plain) and (lcp == plain_lcp).all()


def test_anchors_cover_every_window_alike():
    rng = np.random.default_rng(2)
    sym = T.mix(rng.integers(0, 3, 500).astype(np.uint64))
    first = np.array([0, 100, 110, 500])
    doc, lo, hi, anchor, _ = T.anchors(sym, first, 30, 5)
    seen = sorted(p for a, b in zip(lo, hi) for p in range(a, b + 1))
    assert seen == [*range(0, 71), *range(110, 471)]
    dist = {p: a - p for s, e, a in zip(lo, hi, anchor) for p in range(s, e + 1)}
    by = collections.defaultdict(set)
    for p, d in dist.items():
        by[sym[p:p + 30].tobytes()].add(d)
    assert all(len(x) == 1 for x in by.values())


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def test_structured_texts_do_not_collide(spark):
    """The Thue-Morse words and their complement, which collide modulo powers of two, are told apart."""
    bits = thue_morse(2048)
    one, other = ["ab" if b else "cd" for b in bits], ["cd" if b else "ab" for b in bits]
    rng = np.random.default_rng(4)
    lead = [" ".join(f"w{rng.integers(1000)}" for _ in range(30)) for _ in range(4)]
    rows = [(1, " ".join([lead[0], *one, lead[1]])), (2, " ".join([lead[2], *other, lead[3]]))]
    rows += [(3, "".join(one)), (4, "".join(other))]
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA)
    got = suffix_tree.remove_repeats(d).collect()
    assert as_sorted([(r.doc_id, bytes(r.kept), r.n_words) for r in got]) == as_sorted(cut_words(rows))
    got = suffix_sort.remove_repeats(d).collect()
    assert as_sorted([(r.doc_id, bytes(r.kept), len(r.spans)) for r in got]) == as_sorted(cut_bytes(rows))


def test_rows_without_id_and_repeated_rows(spark):
    """Thousands of rows without id, repeated ids with other texts, a row that makes up a third."""
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passage = word(60)
    rows = [(None, f"{word(int(rng.integers(1, 40)))} {passage if i % 50 == 0 else ''}") for i in range(5000)]
    rows += [(7, word(30) + " " + passage), (7, passage + " " + word(30)), (7, passage)] + [(9, passage + word(90))] * 2500
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA).repartition(5)
    got = suffix_tree.remove_repeats(d).collect()
    assert as_sorted([(r.doc_id, bytes(r.kept), r.n_words) for r in got]) == as_sorted(cut_words(rows))
    got = suffix_sort.remove_repeats(d).collect()
    assert as_sorted([(r.doc_id, bytes(r.kept), len(r.spans)) for r in got]) == as_sorted(cut_bytes(rows))


def test_hashes_modulo_a_prime():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, int(T.P), 500, dtype=np.uint64) for _ in range(2))
    a[:2], b[:2] = int(T.P) - 1, int(T.P) - 1
    assert T.times(a, b).tolist() == [int(x) * int(y) % int(T.P) for x, y in zip(a, b)]
    s = rng.integers(0, 1 << 63, T.BLOCK + 50, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for f in (0, 1):
        p, at, want = T.prefix_hash(s, f), 0, [0]
        for i, x in enumerate(s.tolist()):
            at = (at + x * pow(T.BASES[f], i, int(T.P))) % int(T.P)
            want.append(at)
        assert p.tolist() == want
        assert T.span_hash(p, np.array([0, 9]), np.array([5, 30]), f).tolist()[1] == sum(
            x * pow(T.BASES[f], i, int(T.P)) for i, x in enumerate(s[9:30].tolist())) % int(T.P)


def test_codes_where_hashes_collide():
    buf = np.frombuffer(b"aa bb aa cc bb  a", np.uint8)
    w = T.Words(buf, np.array([0, len(buf)]))
    assert T.span_codes(buf, w.start, w.end, np.zeros(len(w), np.uint64)).tolist() == [0, 1, 0, 2, 1, 3]
    assert len(set(w.codes().tolist())) == 4
