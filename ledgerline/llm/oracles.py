"""SQL that gives the same rows as the queries, where SQL can express them.

The trained operators (2 by its hundreds of look-ahead rules, 3, 4, 8), the
alignment of 6 and the packing of 10 have none; tests hold them against
brute-force versions instead.
"""

from __future__ import annotations

from .quality_rules import METRICS, REACH, WEIGHT

_WORD = "[^\\x20\\x09-\\x0D]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE doc_id IS NOT NULL),
nm AS (SELECT doc_id, line, regexp_extract_all(lower(body), '{_WORD}') AS ws FROM ln),
tx AS (SELECT doc_id, line, ws, len(ws) AS n, array_to_string(ws, ' ') AS t FROM nm WHERE len(ws) >= 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, line) AS copy, row_number() OVER (ORDER BY doc_id, line) AS place FROM tx),
ds AS (SELECT t, ws, n, place FROM rk WHERE copy = 1),
hv AS (SELECT place, unnest([concat('p', n // 2, ':', array_to_string(ws[1:n // 2], ' ')), concat('p', (n - 1) // 2, ':', array_to_string(ws[1:(n - 1) // 2], ' ')),
  concat('s', n // 2, ':', array_to_string(ws[n - n // 2 + 1:n], ' ')), concat('s', (n - 1) // 2, ':', array_to_string(ws[n - (n - 1) // 2 + 1:n], ' '))]) AS h FROM ds WHERE n >= 5),
cd AS (SELECT DISTINCT a.place AS x, b.place AS y FROM hv a JOIN hv b ON a.h = b.h AND a.place > b.place),
pr AS (SELECT x, y, a.ws AS aw, b.ws AS bw, a.n AS an, b.n AS bn, unnest(generate_series(1, least(a.n, b.n))) AS i FROM cd JOIN ds a ON a.place = x JOIN ds b ON b.place = y WHERE abs(a.n - b.n) <= 1),
lc AS (SELECT x, y, any_value(an) AS an, any_value(bn) AS bn, count(CASE WHEN aw[1:i] = bw[1:i] THEN 1 END) AS head, count(CASE WHEN aw[an - i + 1:an] = bw[bn - i + 1:bn] THEN 1 END) AS tail FROM pr GROUP BY x, y),
nr AS (SELECT x, min(y) AS y FROM lc WHERE head + tail >= CASE WHEN an = bn THEN an - 1 ELSE least(an, bn) END GROUP BY x),
kp AS (SELECT ds.t, ds.place, least(ds.place, coalesce(nr.y, ds.place)) AS keeper FROM ds LEFT JOIN nr ON nr.x = ds.place)
SELECT rk.doc_id, CAST(rk.line AS BIGINT) AS line, k.doc_id AS keeper_id, CAST(k.line AS BIGINT) AS keeper_line, CAST(CASE WHEN kp.keeper = kp.place THEN 0 ELSE 1 END AS BIGINT) AS edits
FROM rk JOIN kp ON kp.t = rk.t JOIN rk k ON k.place = kp.keeper WHERE rk.place > kp.keeper"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS k FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, k FROM q WHERE i <= greatest(n - 3, 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
g AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.x, r.c FROM r JOIN g ON g.y = r.doc_id WHERE r.c < g.x)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id"""


def _op7() -> str:
    bucket = lambda v: f"CASE WHEN {v} < 32 THEN {v} ELSE 16 * (length(bin({v})) - 5) + ({v} >> CAST(length(bin({v})) - 5 AS BIGINT)) END"
    low = lambda b: f"(({b} - 16 * greatest({b} // 16 - 1, 0)) << greatest({b} // 16 - 1, 0))"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({bucket(m)} AS BIGINT) AS bucket FROM m WHERE NOT base_failed" for m in METRICS)

    def quartiles(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}, metric" if keys else "PARTITION BY metric"
        group = f"{keys}, metric" if keys else "metric"
        return f"""{name}0 AS (SELECT {group}, bucket, count(*) AS n FROM l GROUP BY {group}, bucket),
{name}1 AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS upto, sum(n) OVER ({part}) AS docs FROM {name}0),
{name}2 AS (SELECT {group}, CAST(min(CASE WHEN 4 * upto >= docs THEN bucket END) AS BIGINT) AS b1, CAST(min(CASE WHEN 4 * upto >= 3 * docs THEN bucket END) AS BIGINT) AS b3, max(docs) AS docs FROM {name}1 GROUP BY {group}),
{name} AS (SELECT *, {low('b1')} AS q1, {low('b3')} AS q3 FROM {name}2)"""

    wider = lambda c: f"((w.docs * w.{c} + {WEIGHT} * e.{c}) // (w.docs + {WEIGHT}))"
    pick = lambda c: f"CAST((o.docs * o.{c} + {WEIGHT} * {wider(c)}) // (o.docs + {WEIGHT}) AS BIGINT)"
    floor = "CASE o.metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (s, _) in METRICS.items()) + " END"
    bounds = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {c} END) AS {m}_{c}" for m in METRICS for c in ("low", "high"))
    inside = " AND ".join([f"m.{m} <= {m}_high" for m in METRICS] + [f"m.{m} >= {m}_low" for m, (_, both) in METRICS.items() if both])
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
wz AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ls AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM wz),
q AS (SELECT doc_id, n, i, concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 8))}) AS k FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM q WHERE i <= n - 7),
p AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS s FROM c WHERE c > 1),
rp AS (SELECT doc_id, CAST(sum(s) AS BIGINT) AS n_repeat_words FROM p GROUP BY doc_id),
b AS (SELECT wz.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM wz LEFT JOIN ls ON ls.doc_id = wz.doc_id LEFT JOIN rp ON rp.doc_id = wz.doc_id),
m AS (SELECT *, (1000 * n_symbols) // greatest(n_words, 1) AS symbols, (1000 * n_dup_lines) // greatest(n_lines, 1) AS dup_lines, (1000 * n_repeat_words) // greatest(n_words, 1) AS repeats, (100 * word_chars) // greatest(n_words, 1) AS word_length,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
l AS ({long}), {quartiles("o", "lang, source")}, {quartiles("w", "lang")}, {quartiles("e", "")},
f0 AS (SELECT o.lang, o.source, o.metric, {pick("q1")} AS q1, {pick("q3")} AS q3, {floor} AS least FROM o JOIN w ON w.lang IS NOT DISTINCT FROM o.lang AND w.metric = o.metric JOIN e ON e.metric = o.metric),
f1 AS (SELECT lang, source, metric, q1 - {REACH} * greatest(q3 - q1, least) AS low, q3 + {REACH} * greatest(q3 - q1, least) AS high FROM f0),
f AS (SELECT lang, source, {bounds} FROM f1 GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept
FROM m LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source"""


OP9 = f"""
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}|[\\x20\\x09-\\x0D]+')) AS t, generate_subscripts(regexp_extract_all(text, '{_WORD}|[\\x20\\x09-\\x0D]+'), 1) AS k FROM documents WHERE doc_id IS NOT NULL),
ps AS (SELECT doc_id, k, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k) AS e, lead(t, 1) OVER (PARTITION BY doc_id ORDER BY k) AS gap, lead(t, 2) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM tk),
wd AS (SELECT doc_id, k, translate(t, {_AZ}) AS t, e - length(t) AS s, e, CASE WHEN right(t, 1) IN ('.', '!', '?') OR nxt IS NULL OR contains(gap, chr(10)) THEN 1 ELSE 0 END AS last FROM ps WHERE regexp_matches(t, '^[^\\x20\\x09-\\x0D]')),
nb AS (SELECT *, coalesce(sum(last) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM wd),
un AS (SELECT doc_id, u, string_agg(t, ' ' ORDER BY k) AS txt, count(*) AS n, min(s) AS s, max(e) AS e FROM nb GROUP BY doc_id, u),
el AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u) AS unit FROM un WHERE n >= 4),
fr AS (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY doc_id, unit) AS copy, first_value(doc_id) OVER (PARTITION BY txt ORDER BY doc_id, unit) AS keeper FROM el),
dp AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM fr WHERE copy > 1)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_words, arg_min(keeper, unit) AS keeper_id FROM dp GROUP BY doc_id, run HAVING sum(n) >= 25"""



def _op11(parts: int = 16, entries: int = 64, width: int = 4, turns: int = 2) -> str:
    square = lambda a, b: " + ".join(f"({a}.x{j} - {b}.x{j}) * ({a}.x{j} - {b}.x{j})" for j in range(width))
    floor = lambda s: f"(({s} - (({s} % count(*)) + count(*)) % count(*)) // count(*))"
    xs = ", ".join(f"x{j}" for j in range(width))
    steps = []
    for t in range(turns + 1):
        steps.append(f"d{t} AS (SELECT p.vec_id, p.part, {xs.replace('x', 'p.x')}, c.entry, {square('p', 'c')} AS d FROM p JOIN c{t} c ON c.part = p.part)")
        steps.append(f"a{t} AS (SELECT vec_id, part, {', '.join(f'any_value(x{j}) AS x{j}' for j in range(width))}, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM d{t} GROUP BY vec_id, part)")
        if t < turns:
            steps.append(f"m{t} AS (SELECT part, entry, {', '.join(f'CAST({floor(f'sum(x{j})')} AS BIGINT) AS x{j}' for j in range(width))} FROM a{t} GROUP BY part, entry)")
            steps.append(f"c{t + 1} AS (SELECT c.part, c.entry, {', '.join(f'coalesce(m.x{j}, c.x{j}) AS x{j}' for j in range(width))} FROM c{t} c LEFT JOIN m{t} m ON m.part = c.part AND m.entry = c.entry)")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, {", ".join(f"q[{width} * part + {j + 1}] AS x{j}" for j in range(width))} FROM k, range({parts}) r(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT part, entry, {xs} FROM p JOIN f USING (vec_id)),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(concat_ws(',', {xs}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{turns}),
o AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{turns} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN k USING (vec_id), h"""


_HEX5 = "CAST('0x' || substr(s, {0}, 5) AS BIGINT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_HEX5.format(5 * k + 1)} >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

OP12 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS k FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to FROM d"""

OP13 = f"""
WITH RECURSIVE tb(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tb WHERE k < 8),
tl AS (SELECT list(c ORDER BY b) AS t FROM tb WHERE k = 8),
tx AS (SELECT 1 AS corpus, doc_id, text FROM documents UNION ALL SELECT 0, item_id, text FROM benchmark),
w AS (SELECT corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM tx),
u AS (SELECT corpus, doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
n AS (SELECT corpus, doc_id, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY corpus, doc_id ORDER BY i)),
f AS (SELECT corpus, doc_id, a AS x FROM n UNION ALL SELECT corpus, doc_id, a || ' ' || b FROM n WHERE b IS NOT NULL UNION ALL SELECT corpus, doc_id, a || ' ' || b || ' ' || c FROM n WHERE c IS NOT NULL),
g AS (SELECT corpus, doc_id, x, count(*) AS n FROM f GROUP BY corpus, doc_id, x),
hx AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM g)),
bt AS (SELECT x, list_transform(range(1, length(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS bs FROM hx),
cr AS (SELECT x, xor(list_reduce(bs, lambda r, v: xor(r >> 8, t[(xor(r, v) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bt, tl),
q AS (SELECT corpus, doc_id, bucket, sum(n) AS n FROM g JOIN cr USING (x) GROUP BY corpus, doc_id, bucket),
z AS (SELECT bucket, CAST(sum(CASE WHEN corpus = 1 THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN corpus = 0 THEN n ELSE 0 END) AS DOUBLE) AS t FROM q GROUP BY bucket),
y AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM z),
e AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM q JOIN y USING (bucket) WHERE corpus = 1 GROUP BY doc_id),
o AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('42:' || w.doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN e USING (doc_id) WHERE corpus = 1),
v AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS k FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= k THEN place END AS rank FROM r"""

SQL = {"op1_line_dedup": OP1, "op5_ngram_join": OP5, "op7_quality": _op7(), "op9_substring_dedup": OP9, "op11_vector_codes": _op11(), "op12_warc": OP12, "op13_resampling": OP13}
