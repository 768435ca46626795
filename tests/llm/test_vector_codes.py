"""Vector codes against a full search, and over odd rows."""
import math
import random

import numpy as np

from tierflow.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, v string, error string, of int, code int"


def brute(rows, parts, entries, rounds):
    """(kept rows' vec_id, code, error, label_error), codebooks; rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), 0)
    k = size // parts
    fit = [v for _, v, _ in kept if len(v) == size and size]
    books = [[v[p * k:(p + 1) * k] for v in fit[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            to = [(nearest(p, v[p * k:(p + 1) * k])[1], v[p * k:(p + 1) * k]) for v in fit]
            for e in range(len(books[p])):
                mine = [x for j, x in to if j == e]
                if mine:
                    new[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = []
    for i, v, label in kept:
        best = [nearest(p, v[p * k:(p + 1) * k]) for p in range(parts)] if size and len(v) == size else None
        out.append((i, label, best and "".join(f"{j:02x}" for _, j in best), best and sum(d for d, _ in best)))
    per = {}
    for _, label, _, e in out:
        per[label] = per.get(label, 0) + e if e is not None and per.get(label) is not None else (e if per.get(label) is None else per[label])
    return [(i, c, e, per[label]) for i, label, c, e in out], books


def rows_of(n, seed, size=8):
    rng = random.Random(seed)
    out = [(i, [rng.choice([-0.5, -0.01, 0.0, 0.004, 0.25, 1.0, rng.gauss(0, 1)]) for _ in range(size)], rng.choice([None, 1, 1, 2]))
           for i in range(n)]
    out += [(n, None, 1), (n + 1, [1.0, None] * (size // 2), 1), (n + 2, [float("nan")] * size, 2), (n + 3, [float("inf")] * size, 2),
            (n + 4, [], 1), (n + 5, [0.5] * (size + 1), 2), (None, [0.1] * size, None), (3, [0.2] * size, 5), out[5], out[5]]
    return out


def test_codes_equal_a_full_search(spark):
    for entries, parts in ((16, 4), (64, 2), (400, 8)):
        rows = rows_of(150, entries)
        d = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(4)
        got, books = V.compressed(d, parts=parts, entries=entries)
        want, want_books = brute(rows, parts, entries, 2)
        assert books.tolist() == want_books
        assert sorted(map(str, ((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()))) == sorted(map(str, want))


def test_search_and_ties():
    rng = np.random.default_rng(1)
    for _ in range(30):
        entries = rng.integers(-3, 4, (rng.integers(1, 40), 3))
        x = rng.integers(-5, 6, (200, 3))
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        who, best = V.search(x, entries)
        assert (who == d.argmin(1)).all() and (best == d.min(1)).all()


def test_huge_components_and_empty_tables(spark):
    rows = [(i, [s * 3e38] * 16, 1) for i, s in enumerate((1.0, -1.0, 0.0, 0.5))]
    d = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    got, _ = V.compressed(d)
    assert [r.error for r in got.collect()] == [0] * 4
    none, books = V.compressed(d.limit(0))
    assert none.count() == 0 and books.size == 0 and none.columns == ["vec_id", "label", "code", "error", "label_error"]
