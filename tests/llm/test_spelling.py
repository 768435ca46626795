"""Spelling variants against all pairs of words."""
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import SCHEMA
from tierflow.llm import spelling as S


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[p + 1:] == (b[p + 1:] if len(a) == len(b) else b[p:])


def brute(rows):
    count = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            at = h % len(r)
            count[r[:at] + r[at + 1:] if h % 97 == 0 else r] += 1
    v = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    links = {w: [] for w in v}
    for a, b in itertools.combinations(v, 2):
        if near(a, b):
            links[a].append(b)
            links[b].append(a)
    best = {w: min(x, key=lambda y: (-v[y], y)) for w, x in links.items() if x}
    form = {w: b for w, b in best.items() if v[b] >= 2 * v[w]}
    out = []
    for w, n in v.items():
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, n, len(links[w]), v[form[w]] if w in form else None))
    return sorted(out)


def variants_of(rng, word, letters="abcé"):
    at, c = rng.randrange(len(word)), rng.choice(letters)
    return rng.choice([word[:at] + word[at + 1:], word[:at] + c + word[at:], word[:at] + c + word[at + 1:]])


def table_of(seed=3):
    """Words of few letters, chains of variants, long runs and a hot group that
    differs in a single place."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    for _ in range(150):
        pool.append(variants_of(rng, rng.choice(pool)) or "abcab")
    pool += ["a" * n for n in range(4, 12)] + ["zz" + chr(97 + i) + "zzz" for i in range(26)]
    pool += ["q" * 900, "q" * 899, "q" * 400 + "x" + "q" * 499, "Straße", "strasse", "STRASSE", "straÞe"]
    return [(i if i % 9 else None, " ".join(rng.choices(pool, [1 + i % 7 * (i % 5) for i in range(len(pool))], k=60)) + rng.choice([" 1x2", "...", "", "-"])) for i in range(90)]


@pytest.mark.parametrize("limit", [S.GROUP, 2])
def test_variants(spark, limit):
    rows = table_of() + [(1, None), (2, "")]
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in S.variants(d, limit=limit).collect())
    want = brute(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) >= 30 and any(r[1] not in (None, r[2]) for r in want)


def test_odd_rows(spark, docs, odd, nothing):
    got = sorted(tuple(r) for r in S.variants(docs).collect())
    assert got == brute([(r[0], r[1]) for r in odd])
    out = S.variants(nothing)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


@pytest.mark.parametrize("tile", [3, 192])
def test_every_pair_once(tile, monkeypatch):
    """Pairs in one group, found in blocks or in one tile."""
    monkeypatch.setattr(S, "TILE", tile)
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in (5, 6) for _ in range(200)})
    t = pa.table({"word": words, "n": list(range(len(words))), "long": pa.array([6] * len(words), pa.int32()),
                  "path": [""] * len(words), "k": pa.array(np.zeros(len(words), np.int64))})
    got = [tuple(sorted((words[i], words[j]))) for i, j in zip(*S.near_pairs(t))]
    want = [tuple(sorted(x)) for x in itertools.combinations(words, 2) if near(*x) and 6 in map(len, x)]
    assert sorted(got) == sorted(want)
