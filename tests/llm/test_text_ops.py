"""Quality, licences, token counts, decontamination, secrets and mixing against
plain Python over the odd table."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from tierflow.llm import decontaminate, licenses, mixing, quality, secrets, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(rows):
    return sorted(rows, key=str)


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, dup, len(covered)


def failed(text):
    n, _, _, _, _, rep = counts(text)
    return n < 50 or 100 * rep > 50 * n


def test_quality_counts(docs, odd):
    got = quality.judge(docs.select("doc_id", "source", "text"), ["doc_id"]).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id((r.doc_id, *(r[c] for c in cols)) for r in got) == by_id((r[0], *counts(r[1]), failed(r[1])) for r in odd)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_rejects_a_bad_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "few words"
    rows = [(i, good, None, f"h{i % 4}", 1, *[None] * 7) for i in range(200)]
    rows += [(1000 + i, bad if i % 50 else good, None, "spam", 1, *[None] * 7) for i in range(200)]
    d = spark.createDataFrame(rows, SCHEMA)
    kept = quality.passing(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == set(range(200))
    v = {r.host: r for r in quality.host_verdicts(quality.measure(d.select("source", "text"))).collect()}
    assert not v["spam"].host_ok and v["h1"].host_ok
    assert 0.9 < v["spam"].rate_base < v["spam"].fail_base / v["spam"].n_docs  # shrunk to the mean


def test_quality_passing_carries_odd_rows(docs, odd):
    want = by_id(tuple(r) for r in odd if not failed(r[1]))
    assert by_id(tuple(r) for r in quality.passing(docs).collect()) == want


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_licenses(docs, odd):
    got = licenses.scan(docs).collect()
    want = []
    for r in odd:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        want.append((r[0], len(w), sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())))
    assert by_id((r.doc_id, r.n_words, sorted((p.start, p.label) for p in r.places if p.base)) for r in got) == by_id(want)
    labels = {p.label for r in got for p in r.places if not p.base}
    assert {"cc-by-sa", "apache-2.0", "mit"} <= labels
    assert all(0 < p.share <= 1 for r in got for p in r.places)


def greedy(word, begin, go_on):
    at = n = 0
    while at < len(word):
        pieces = begin if at == 0 else go_on
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_tokens(docs, odd):
    begin, go_on = map(set, tokens.load_vocabulary())
    want = []
    for r in odd:
        n = [greedy(w, begin, go_on) for w in (r[1] or "").encode().split()]
        want.append((r[0], len(n), sum(x or 1 for x in n), n.count(None)))
    assert by_id(map(tuple, tokens.count_tokens(docs).collect())) == by_id(want)


pieces = st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(pieces, pieces, st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 4 for x in b)), max_size=8))
def test_automaton_is_greedy(begin, go_on, words):
    c = tokens.Counter(*tokens.build(sorted(begin), sorted(go_on)), kept=3)
    for w in words:
        if w:
            n = greedy(w, begin, go_on)
            assert c[w] == (1 + tokens._UNKNOWN if n is None else n)


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, e in enumerate(t):
            new.append(min(row[j] + (c != e), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90))
def test_myers(p, t):
    assert decontaminate.myers(decontaminate.masks(p), len(p), t)[0] == distance(p, t)


def test_decontamination(spark, docs, odd):
    rng = random.Random(9)
    source = next(r[1] for r in odd if r[0] == 3 + 19)  # a long text
    items = [(1, source[500:700]), (2, None), (3, " "), (4, "short"), (5, "nowhere in any text of the table at all")]
    s = list(source[1000:1200])
    for p in rng.sample(range(200), 6):
        s[p] = rng.choice("xyzq ")
    items.append((6, "".join(s)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    n = decontaminate.normal
    want = set()
    for r in odd:
        for i, t in items:
            if n(t) and n(r[1]):
                d = distance(n(t), n(r[1]))
                if d <= decontaminate.budget(len(n(t))):
                    want.add((r[0], i, d))
    assert any(d > 0 for _, _, d in want)
    for chars in (decontaminate.BLOCK_CHARS, 150):  # one block, several
        rows = decontaminate.matches(docs.select(docs.doc_id.alias("id"), "text"), bench, block_chars=chars).collect()
        assert {(r.id, r.item_id, r.distance) for r in rows} == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    bad = {i for i, _, _ in want}
    assert by_id(map(tuple, left.collect())) == by_id(tuple(r) for r in odd if r[0] not in bad)


KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))


def test_secrets(spark, docs, odd, tmp_path):
    ledger = str(tmp_path / "ledger")
    got = secrets.findings(docs, secrets.scan(docs, ledger)).collect()
    assert by_id((r.doc_id, [(x.start, x.kind, x.end) for x in r.found]) for r in got) == by_id((r[0], spans(r[1])) for r in odd)
    assert sum(map(len, (r.found for r in got))) >= 4
    # nothing is new: nothing is scanned; a new rule version reads every blob again, a new text only itself
    blobs = len({r[1] or "" for r in odd})
    assert secrets.scan(docs, ledger).count() == blobs
    more = docs.unionAll(docs.limit(1).withColumn("text", secrets.F.lit("password: anotherone1")))
    assert secrets.scan(more, ledger).count() == blobs + 1
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{16,}"))
    after = secrets.scan(more, ledger, newer)
    assert after.count() == 2 * (blobs + 1)
    assert after.filter("rules = array('hex@2')").count() == blobs + 1


def test_redaction(docs, odd, tmp_path):
    got = secrets.redacted(docs, str(tmp_path / "l"), length="n_chars")
    assert got.dtypes == docs.dtypes
    want = []
    for r in odd:
        t, out, at = r[1], "", 0
        for s, _, e in spans(t):
            if s >= at:
                out += t[at:s] + "[secret]"
            at = max(at, e)
        new = t if not spans(t) else out + t[at:]
        want.append((r[0], new, *r[2:4], len(new) if spans(t) else r[4], *r[5:]))
    assert by_id(map(tuple, got.collect())) == by_id(want)


def test_mixing(docs, odd):
    got = mixing.mix(docs, shares=(0.5, 1.5)).collect()
    assert len(got) == len(odd)
    size = lambda t: len(WORD.findall(t or ""))
    total = Counter()
    for r in odd:
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rate = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in order if weight[s] * rate > 2 * total[s]} - full
        if not more:
            break
        full |= more
    target = {s: 2 * total[s] if s in full else weight[s] * rate for s in order}
    taken, most = Counter(), Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r["size"] * 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
        assert r.taken > 0 if r.first_budget == 0 and r["size"] else True  # budgets are nested
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * most[s]
    assert by_id(map(tuple, got)) == by_id(map(tuple, mixing.mix(docs.repartition(5), shares=(0.5, 1.5)).collect()))


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 37), None, f"s{i % 7:02d}", 1, *[None] * 7) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(
        mixing.F.sum("taken").alias("taken"), mixing.F.max("target").alias("target")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 37


def test_empty_tables(spark, nothing, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality.passing(nothing).count() == 0
    assert quality.judge(nothing, ["doc_id"]).count() == 0
    assert licenses.scan(nothing).count() == 0
    assert tokens.count_tokens(nothing).count() == 0
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.clean(nothing, bench).count() == 0
    assert secrets.findings(nothing, secrets.scan(nothing, str(tmp_path / "l"))).count() == 0
    assert secrets.redacted(nothing, str(tmp_path / "m"), length="n_chars").count() == 0
    assert mixing.mix(nothing).count() == 0


def test_quality_has_no_rule_without_effect(spark):
    """A host all of whose documents fail a rule is rejected, whatever the rule."""
    rng = random.Random(8)
    bad = {"base": "too short", "symbols": prose(rng, 80) + " # $ %" * 9, "lines": "a line\n" * 40 + prose(rng, 90),
           "word_length": " ".join("abcdefghijklm" + str(i) for i in range(90)),
           "short_words": " ".join(chr(0x100 + i) for i in range(90))}
    rows = [(name, text) for name, text in bad.items() for _ in range(40)]
    rows += [(f"h{i}", prose(rng, 80)) for i in range(12) for _ in range(40)]
    d = spark.createDataFrame(rows, "source string, text string")
    v = {r.host: r for r in quality.host_verdicts(quality.measure(d)).collect()}
    assert [name for name in quality.RULES if v[name][f"fail_{name}"] != 40 or v[name].host_ok] == []
    assert v["h0"].host_ok and v["word_length"].host_ok
    gone = {r.source for r in d.select("source").distinct().collect()} - {r.source for r in quality.passing(d).collect()}
    assert gone == set(quality.RULES)
    rows = d.select(F.monotonically_increasing_id().alias("doc_id"), "*")
    judged = quality.judge(rows, ["doc_id"]).groupBy("kept").agg(F.count_if(~F.col("base_failed")).alias("n")).collect()
    assert {r.kept: r.n for r in judged} == {True: 13 * 40, False: 3 * 40}


def test_quality_prior_weighs_hosts_by_documents():
    """Against the moments computed plainly; a host of one document hardly moves the prior."""
    def plain(hosts):
        n, x = np.array(hosts, float).T
        m, k, total = x.sum() / n.sum(), len(n), n.sum()
        s = (n * (x / n - m) ** 2).sum()
        r = (s / (m * (1 - m)) - (k - 1)) / (total - (n * n).sum() / total - (k - 1))
        return m, min(max(1 / max(r, 1e-9) - 1, 1.0), 1e6)

    def ours(hosts):
        n, x = np.array(hosts, float).T
        return quality._prior(len(n), n.sum(), (n * n).sum(), x.sum(), (x * x / n).sum())
    big = [(1000, 100), (1000, 300), (500, 20), (2000, 150)]
    for hosts in (big, big + [(1, 1)], [(10, 1)] * 30, [(50, 50), (50, 0)]):
        assert ours(hosts) == pytest.approx(plain(hosts))
    assert ours(big + [(1, 1)])[1] == pytest.approx(ours(big)[1], rel=0.05)
    assert ours([(10, 0), (5, 0)]) == (0.0, 1e6) and ours([(10, 3)])[1] == 1e6
    assert quality._prior(0, 0.0, 0.0, 0.0, 0.0) == (0.0, 1e6)


def test_quality_lines_of_one_hash(spark):
    """Lines and words that collide modulo powers of two are different ones."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
    text = f"{one}\n{other}\n{one}\n" + " ".join(f"{one} {x}" if i % 2 else f"{other} {x}" for i, x in enumerate("pqrstuvw"))
    d = spark.createDataFrame([(1, text, None, "a", 1, *[None] * 7)], SCHEMA)
    got = quality.judge(d, ["doc_id"]).collect()[0]
    n, chars, _, _, dup, rep = counts(text)
    assert (got.n_words, got.word_chars, got.n_dup_lines, got.n_repeat_words) == (n, chars, dup, rep)


def test_mix_with_clashing_names(spark, odd):
    names = ["doc_id", "text", "lang", "source", "_size", "_hv", "_s", "row", "hv", "of", "mix", "base0"]
    d = spark.createDataFrame([r[:4] + tuple(range(8)) for r in odd], "doc_id long, text string, lang string, source string, "
                              + ", ".join(f"{n} int" for n in names[4:]))
    for keep in (False, True):
        got = mixing.mix(d, keep_text=keep).collect()
        assert len(got) == len(odd) and all(r["_size"] == 0 and r["base0"] == 7 and r["taken"] <= 2 * r["size"] for r in got)


def test_long_runs_of_token_heads(spark):
    """Texts that make a naive pattern go back again and again are scanned in one go."""
    import time

    long = "eyJ" * 150_000
    token = "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"
    rows = [(1, long), (2, long + "." + long), (3, f"x {token}, x{token} -{token}\n{token}.{token}"), (4, "eyJ-" * 100_000)]
    d = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA).select("doc_id", "text")
    began = time.time()
    out = secrets.findings(d, secrets.scan(d, secrets.new_ledger(spark)))
    kind = [r.kind for r in secrets.RULES].index("jwt")
    got = {r.doc_id: [(f.start, f.end) for f in r.found if f.kind == kind] for r in out.collect()}
    assert time.time() - began < 30
    want = {i: [m.span() for m in re.finditer(r"(?<![\w-])eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}", t, re.ASCII)] for i, t in rows if i in (1, 3)}
    assert got[1] == [] and got[3] == want[3] and len(got[3]) >= 2
