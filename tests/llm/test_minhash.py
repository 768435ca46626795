"""ProbMinHash classes against all pairs, estimates against exact similarity."""
import itertools
import random

import numpy as np

from tests.llm.conftest import SCHEMA, prose
from tierflow.llm import minhash as M
from tierflow.llm.common import Scratch
from tierflow.llm.components import components


def weighted(text):
    b = np.frombuffer((text or "").encode(), np.uint8)
    return M.shingles(b, np.array([0, len(b)]))[1:]


def brute_classes(rows):
    """class id of each distinct node: ids, or (None, text)."""
    nodes = {}
    for i, t in rows:
        nodes.setdefault(i if i is not None else (None, t), []).append(weighted(t))
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if any(M.probability_jaccard(x, y) >= 0.8 for x in nodes[a] for y in nodes[b]):
            up[find(a)] = find(b)
    out = {}
    for x in nodes:
        ids = [y for y in nodes if find(y) == find(x) and not isinstance(y, tuple)]
        out[x] = min(ids) if ids else None
    return out


def test_classes(spark, docs, odd):
    got = M.near_duplicates(docs).collect()
    want = brute_classes([(r[0], r[1]) for r in odd])
    assert len(got) == len(odd)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.class_id) for r in got), key=key) == sorted(
        ((r[0], want[r[0] if r[0] is not None else (None, r[1])]) for r in odd), key=key)


def test_a_hub_that_is_like_nobody(spark):
    """Links inside a bucket survive when its first text is similar to none."""
    rng = random.Random(3)
    a = prose(rng, 300).split()
    rows = [(1000 + i, " ".join(a[:30 * (i % 10)] + ["new", str(i % 10)] + a[30 * (i % 10):])) for i in range(40)]
    rows += [(i, " ".join(a[:170]) + " " + prose(rng, 130)) for i in range(5)]
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(d, bands=60, rows=2).collect()}
    want = brute_classes(rows)
    assert got == want


def test_one_of_each_keeps_columns(spark, docs, odd):
    kept = M.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_classes([(r[0], r[1]) for r in odd])
    classes = {(v if v is not None else k) for k, v in want.items()}
    assert kept.count() == len(classes)


def test_empty(nothing):
    assert M.near_duplicates(nothing).count() == 0
    assert M.one_of_each(nothing).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(4):
        n = 60
        ex, ey = np.arange(n), np.arange(n // 3, n + n // 3)
        wx, wy = rng.integers(1, 9, n), rng.integers(1, 9, n)
        exact = M.probability_jaccard((ex, wx), (ey, wy))
        direct = sum(1 / sum(max(dict(zip(ex, wx)).get(e, 0) / x, dict(zip(ey, wy)).get(e, 0) / y) for e in {*ex, *ey})
                     for e0, x in zip(ex, wx) for e1, y in zip(ey, wy) if e0 == e1)
        assert abs(exact - direct) < 1e-9
        doc = np.repeat([0, 1], n)
        sig = M.prob_minhash(doc, M.T.mix(np.concatenate([ex, ey]).astype(np.uint64) + np.uint64(1)), np.concatenate([wx, wy]), 2, 4000)
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(25)]
    up = {i: i for i in range(150)}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.comp for r in got} == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_pairs_just_above_the_threshold(spark):
    """Pairs of few shingles, and of few heavy ones, of similarity 0.80 to 0.85."""
    rng = random.Random(11)
    rows, near = [], []
    for i in range(0, 400, 2):
        few = prose(rng, 8)  # 4 shingles, and the same with a fifth
        rows += [(i, few), (i + 1, few + " " + prose(rng, 1))]
    for i in range(400, 600, 2):
        lead, tail = prose(rng, 6), prose(rng, 1)
        heavy = " ".join([lead] * 20)  # 6 heavy shingles; then some light ones
        rows += [(i, heavy), (i + 1, f"{heavy} {' '.join([tail] * rng.randint(21, 29))}")]
    for i in range(0, 600, 2):
        if 0.8 <= M.probability_jaccard(weighted(rows[i][1]), weighted(rows[i + 1][1])) <= 0.85:
            near.append(i)
    assert sum(i < 400 for i in near) > 100 and sum(i >= 400 for i in near) > 30
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.class_id for r in M.near_duplicates(d).collect()}
    assert [i for i in near if got[i + 1] != i] == []
    assert got == brute_classes(rows)


def test_copies_of_one_text(spark):
    """A group of copies with few to many edits: classes are those of all pairs, and most pairs are barred unread."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(0, 14)):
            w[at] = f"{rng.choice('klmnop')}{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[5][1] + " more"), (None, prose(rng, 70)), (3, prose(rng, 60)), (700, rows[-1][1])]
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA).repartition(3)
    want = brute_classes(rows)
    got = M.near_duplicates(d).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == {k: v for k, v in want.items() if not isinstance(k, tuple)}
    assert sorted(str(r.class_id) for r in got if r.doc_id is None) == sorted(str(v) for k, v in want.items() if isinstance(k, tuple))


def test_structured_texts_stay_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    rows = [(f, " ".join(["ab", "cd"][b ^ f] for b in bits) + f" end{f}" * 300) for f in (0, 1)]
    rows += [(2 + f, "".join(["ab", "cd"][b ^ f] for b in bits)) for f in (0, 1)]
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA)
    assert {r.doc_id: r.class_id for r in M.near_duplicates(d).collect()} == brute_classes(rows)


def test_rarest_shingles_meet():
    """Every similar pair shares a key whose weight from there on suffices."""
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        n = int(rng.integers(5, 60))
        x = rng.choice(80, n, replace=False)
        y = np.union1d(rng.permutation(x)[: n - int(rng.integers(0, 4))], rng.choice(80, int(rng.integers(0, 4))))
        heavy = rng.random() < 0.5
        wx, wy = (rng.integers(1, 5 if heavy else 2, len(s)) for s in (x, y))
        x, y = np.sort(x), np.sort(y)
        count = rng.integers(2, 9, 80)
        if M.probability_jaccard((x, wx), (y, wy)) < 0.8:
            continue
        (i, rx), (j, ry) = M.rarest(wx, count[x], x, 0.8), M.rarest(wy, count[y], y, 0.8)
        common = {int(x[a]): r for a, r in zip(i, rx)}
        best = [min(common[int(y[b])], r) for b, r in zip(j, ry) if int(y[b]) in common]
        unit = (wx == 1).all() and (wy == 1).all()
        assert best and (not unit or max(best) >= 0.8 / 1.8 * (len(x) + len(y)) - 1e-6)
        met += 1
    assert met > 60
