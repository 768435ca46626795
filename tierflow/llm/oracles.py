"""DuckDB SQL for the queries that SQL can express, written from their
contracts and not from the operators' code."""
from __future__ import annotations

from tierflow.llm import quality, suffix_sort, suffix_tree, vector_codes
from tierflow.llm.licenses import TEMPLATES
from tierflow.llm.secrets import BASE_KINDS, RULES

WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"


def quality_sql() -> str:
    rules = {"base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words", "symbols": "n_symbols > n_words / 10",
             "lines": "n_dup_lines > 0.3 * n_lines", "short": "word_chars < 2 * n_words"}
    fails = ", ".join(f"CAST(({c}) AS INT) AS f_{r}" for r, c in rules.items())
    flat = ", ".join(f"('{r}', f_{r})" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, source, COALESCE(text, '') AS text, {WORDS} AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
gram AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g
         FROM word WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM gram WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
line AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT l) AS n, COUNT(*) AS n_lines
         FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
         WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, len(ws) AS n_words, CAST(COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             COALESCE(line.n, 0) AS n_dup_lines, COALESCE(line.n_lines, 0) AS n_lines, COALESCE(rep.n, 0) AS n_repeat_words
      FROM d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (SELECT *, {fails} FROM m),
host AS (SELECT source, r, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(x) AS DOUBLE) AS x
         FROM f, LATERAL (VALUES {flat}) AS v(r, x) GROUP BY source, r),
mean AS (SELECT r, COUNT(*) - 1 AS k1, SUM(n) AS nn, SUM(n * n) AS n2, SUM(x) / SUM(n) AS mu FROM host GROUP BY r),
spread AS (SELECT h.r, mu, k1, nn - n2 / nn - k1 AS free, SUM(n * (x / n - mu) * (x / n - mu)) AS s
           FROM host h JOIN mean ON mean.r = h.r GROUP BY h.r, mu, k1, nn, n2),
prior AS (SELECT r, mu, CASE WHEN mu <= 0 OR mu >= 1 OR free <= 0 THEN {quality.STRONGEST}
                 ELSE LEAST(GREATEST(1 / GREATEST((s / (mu * (1 - mu)) - k1) / free, 1e-9) - 1, {quality.WEAKEST}), {quality.STRONGEST}) END AS st
          FROM spread),
verdict AS (SELECT source, MAX((x + mu * st) / (n + st)) AS worst, MAX((x + mu * st) / (n + st)) FILTER (WHERE h.r = 'base') AS rate
            FROM host h JOIN prior p ON p.r = h.r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base = 1 AS base_failed,
       f_base = 0 AND worst < {quality.MAX_HOST_RATE} AS kept, ROUND(rate, 9) AS host_rate
FROM f JOIN verdict v ON v.source IS NOT DISTINCT FROM f.source"""


def suffix_tree_sql() -> str:
    w = suffix_tree.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + {w - 1}], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {w} + 2)) AS p FROM d) x),
later AS (SELECT doc_id, p FROM (
            SELECT doc_id, p, ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM win) y WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM later, range({w}) AS o(k)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS s, COUNT(*) AS n
         FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - COALESCE(kept.n, 0) AS n_removed,
       sha256(COALESCE(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def suffix_sort_sql() -> str:
    w = suffix_sort.WINDOW
    return f"""
WITH d AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS x, strlen(COALESCE(text, '')) AS n FROM documents),
win AS (SELECT doc_id, p, md5(substr(x, 2 * p - 1, {2 * w})) AS s
        FROM (SELECT doc_id, x, unnest(range(1, n - {w} + 2)) AS p FROM d) y),
often AS (SELECT doc_id, p FROM (SELECT doc_id, p, COUNT(*) OVER (PARTITION BY s) AS c FROM win) z WHERE c > 1),
byte AS (SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(regexp_extract_all(x, '..')) AS b FROM d),
flag AS (SELECT byte.doc_id, i, b,
                COUNT(often.p) OVER (PARTITION BY byte.doc_id ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) > 0 AS gone
         FROM byte LEFT JOIN often ON often.doc_id = byte.doc_id AND often.p = byte.i),
run AS (SELECT *, gone AND NOT COALESCE(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS starts FROM flag),
doc AS (SELECT doc_id, CAST(SUM(CAST(gone AS INT)) AS BIGINT) AS r, CAST(SUM(CAST(starts AS INT)) AS BIGINT) AS s,
               string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM run GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, COALESCE(r, 0) AS n_removed, COALESCE(s, 0) AS n_spans,
       sha256(unhex(COALESCE(kept, ''))) AS kept_sha256
FROM d LEFT JOIN doc ON doc.doc_id = d.doc_id"""


def licenses_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, string_split('{t.phrase}', ' '), string_split('{t.words}', ' '), {t.at})"
                     for k, t in enumerate(TEMPLATES))
    return rf"""
WITH t(k, label, base, phrase, full_words, shift) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{upper.lower()}'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
near AS (SELECT doc_id, ws, t.* FROM d, t
         WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(phrase, ' ') || ' ')),
place AS (SELECT *, CAST(len(list_filter(range(0, len(full_words)), lambda j: s - shift + j >= 0 AND ws[s - shift + j + 1] = full_words[j + 1])) AS DOUBLE)
                 / len(full_words) AS share
          FROM (SELECT *, unnest(range(0, len(ws))) AS s FROM near) x WHERE ws[s + 1:s + len(phrase)] = phrase),
g AS (SELECT doc_id, COUNT(*) FILTER (WHERE base) AS n_base, MIN(s) FILTER (WHERE base) AS first_word,
             MAX(s) FILTER (WHERE base) AS last_word,
             array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, MAX(share) AS score
      FROM place GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word,
       COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, 0.0) AS score
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def secrets_sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        pat, lead = (r.plain or r.pattern).replace("'", "''"), 1 if r.plain else 0
        parts.append(f"""
SELECT doc_id, {k} AS k, '{r.kind}' AS kind, s, e FROM (
  SELECT doc_id, grp[i] AS grp, CAST(list_sum(gap[1:i]) + COALESCE(list_sum(hit[1:i - 1]), 0) AS BIGINT) AS s,
         CAST(list_sum(gap[1:i]) + list_sum(hit[1:i]) AS BIGINT) AS e
  FROM (SELECT doc_id, list_transform(regexp_split_to_array(text, '{pat}'), lambda x: length(x)) AS gap,
               list_transform(regexp_extract_all(text, '{pat}', 0), lambda x: length(x)) AS hit,
               list_transform(regexp_extract_all(text, '{pat}', {r.group}), lambda x: length(x)) AS grp,
               list_transform(regexp_extract_all(text, '{pat}', {lead}), lambda x: length(x)) AS own,
               unnest(range(1, len(regexp_extract_all(text, '{pat}', 0)) + 1)) AS i
        FROM d WHERE regexp_matches(text, '{pat}')) x) y WHERE grp >= {r.least}""")
    n = len(BASE_KINDS)
    counts = ", ".join(f"COUNT(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, kind in enumerate(BASE_KINDS))
    names = ", ".join(f"COALESCE(n_{kind}, 0) AS n_{kind}" for kind in BASE_KINDS)
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
span AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts},
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {n}) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


def warc_sql() -> str:
    # four base-32 digits from each five hexadecimal ones
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * b + 1}, 5) AS BIGINT) >> {5 * (3 - j)}) & 31 AS INT) + 1, 1)"
        for b in range(8) for j in range(4))
    return f"""
WITH p AS (SELECT page_id, url, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h,
                  MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS top FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {digits} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, url FROM p"""


def spelling_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(text, '{upper}', '{upper.lower()}')"
    return rf"""
WITH RECURSIVE crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))),
run AS (SELECT doc_id, r, COUNT(*) AS n, hex(encode(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x
        FROM (SELECT doc_id, unnest(regexp_extract_all({low}, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY doc_id, r),
hashed AS (SELECT r, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h FROM run, crc),
v AS (SELECT w, CAST(SUM(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM hashed) q
      WHERE length(w) >= 5 GROUP BY w HAVING SUM(n) >= 3),
less AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS s FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM v)),
pair AS (SELECT a.w AS x, b.w AS y FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.w <> b.w
         UNION SELECT w, s FROM less WHERE s IN (SELECT w FROM v)
         UNION SELECT s, w FROM less WHERE s IN (SELECT w FROM v)),
near AS (SELECT x, y, v.n, COUNT(*) OVER (PARTITION BY x) AS n_near, ROW_NUMBER() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS r
         FROM pair JOIN v ON v.w = pair.y),
f AS (SELECT v.w, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN near.n >= 2 * v.n THEN y END AS form,
             CASE WHEN near.n >= 2 * v.n THEN near.n END AS form_n
      FROM v LEFT JOIN near ON near.x = v.w AND near.r = 1),
chain AS (SELECT w, w AS at FROM f UNION ALL SELECT chain.w, f.form FROM chain JOIN f ON f.w = chain.at WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, chain.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN chain ON chain.w = f.w JOIN f AS e ON e.w = chain.at AND e.form IS NULL"""


def vector_codes_sql() -> str:
    parts, entries, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE

    def assigned(k: int) -> str:
        return f"""
a{k} AS (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best FROM (
           SELECT part.vec_id, part.p, e.e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
           FROM part JOIN e{k} e ON e.p = part.p) y GROUP BY vec_id, p)"""

    def improved(k: int) -> str:
        return f"""
m{k} AS (SELECT p, e, i, SUM(v) AS s, COUNT(*) AS n FROM (
           SELECT part.p, a.best.e AS e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i
           FROM part JOIN a{k} a ON a.vec_id = part.vec_id AND a.p = part.p) y GROUP BY p, e, i),
e{k + 1} AS (SELECT o.p, o.e, COALESCE(c2, c) AS c FROM e{k} o LEFT JOIN (
           SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c2 FROM m{k} GROUP BY p, e) m ON m.p = o.p AND m.e = o.e)"""

    return f"""
WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
         FROM (SELECT vec_id, v, unnest(range(0, {parts})) AS p FROM q) y),
e0 AS (SELECT part.p, r - 1 AS e, x AS c FROM part
       JOIN (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) AS r FROM q QUALIFY r <= {entries}) f ON f.vec_id = part.vec_id),
{assigned(0)},
{improved(0)},
{assigned(1)},
{improved(1)},
{assigned(2)},
done AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(SUM(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS s
         FROM (SELECT p, e, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS i FROM e2) y)
SELECT q.vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM q JOIN done ON done.vec_id = q.vec_id, book"""


ORACLES = {
    "op4_suffix_tree": suffix_tree_sql(),
    "op5_quality": quality_sql(),
    "op6_licenses": licenses_sql(),
    "op7_suffix_sort": suffix_sort_sql(),
    "op9_secrets": secrets_sql(),
    "op10_warc": warc_sql(),
    "op11_spelling": spelling_sql(),
    "op12_vector_codes": vector_codes_sql(),
}
