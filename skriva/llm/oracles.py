"""DuckDB SQL for the operators that SQL can express, written apart from the operators' own ways: plain self-joins and windows."""

from __future__ import annotations

from .quality import RULES
from .urlfilter import RULES as URL_RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_folded("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""

_SCORES = {r: f"CASE WHEN {bottom} > 0 THEN {top}::DOUBLE / {bottom} ELSE 0 END" for r, (top, bottom, _, _) in RULES.items()}
_BINS = " UNION ALL ".join(
    f"SELECT doc_id, lang, '{r}' AS rule, {step}::DOUBLE AS step, least(ceil(({_SCORES[r]}) / {step}::DOUBLE), {size + 1})::INTEGER AS bin FROM good" for r, (_, _, step, size) in RULES.items())
_REJECT = " OR ".join(f"coalesce(({_SCORES[r]}) > (SELECT cutoff FROM best b WHERE b.rule = '{r}' AND b.lang IS NOT DISTINCT FROM s.lang), false)" for r in RULES)
_P = f"(0.02::DOUBLE / {len(RULES)})"
QUALITY = rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM again CROSS JOIN range(3) x(d) GROUP BY doc_id),
s AS (SELECT w.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN r USING (doc_id)),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
good AS (SELECT s.* FROM s WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words), b AS ({_BINS}),
c AS (SELECT lang, rule, step, bin, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM b JOIN q USING (doc_id) GROUP BY ALL),
a AS (SELECT lang, rule, step, bin - 1 AS c, sum(good) OVER w AS k, sum(bad) OVER w AS hit, sum(good) OVER (PARTITION BY lang, rule) AS n, sum(bad) OVER (PARTITION BY lang, rule) AS nb FROM c WINDOW w AS (PARTITION BY lang, rule ORDER BY bin DESC)),
tail AS (SELECT *, CASE WHEN k >= n * {_P} THEN 1 ELSE list_sum(list_transform(range(k::BIGINT + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P})))) END AS tail FROM a WHERE c >= 0 AND n > 0),
ok AS (SELECT *, hit::DOUBLE / greatest(nb, 1) - 10 * k::DOUBLE / greatest(n, 1) AS gain FROM tail WHERE tail <= 0.05::DOUBLE / ({len(RULES)} * greatest(1, (SELECT count(*) FROM (SELECT DISTINCT lang FROM c))))),
best AS (SELECT lang, rule, c * step AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, c DESC) AS k1 FROM ok WHERE gain > 0) WHERE k1 = 1),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_REJECT}) AS kept FROM f s"""

LEAKS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_folded("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_folded("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""

PAGES = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(h, '(?i)</?(?:p|h1)>', chr(1), 'g'), chr(1)) AS p FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(p, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM b)
SELECT page_id, url, coalesce(array_to_string(p, chr(10)), '') AS text, length(coalesce(array_to_string(p, chr(10)), '')) AS n_chars FROM c"""

_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
URLS = rf"""WITH u AS (SELECT page_id, {_folded("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES {_VALUES}), m AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1"""

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM n WHERE n >= 100)),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM w), m AS (SELECT doc_id, s FROM f WHERE k > 1),
i AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100, true) AS new FROM m),
j AS (SELECT doc_id, s, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
k AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM j GROUP BY ALL),
z AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM k),
o AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM z JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN o.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM n LEFT JOIN o USING (doc_id)"""



def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, round by round."""
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""c0 AS MATERIALIZED (SELECT c - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) AS c FROM v WHERE vec_id IS NOT NULL) WHERE c <= {k})"""]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i} c) GROUP BY r)""")
        if i < rounds:
            parts.append(
                f"""m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i} JOIN v USING (r)) GROUP BY ALL),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN n{i} n USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} o USING (c)"""


LINES = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
k AS (SELECT doc_id, i, l, {_folded("trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM l),
s AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, i, l, last IS NULL OR doc_id = last AS stays FROM k LEFT JOIN s USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
_LEAF = lambda text: f"sha256({' || '.join(_FIELD(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
#: One bit per step: the checksum of the digits of doc_id.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"
_SIBLINGS = "SELECT {tree}, i, l, string_agg(h, '' ORDER BY j) FILTER (j < i) AS a, string_agg(h, '' ORDER BY j) FILTER (j > i) AS b FROM (SELECT x.{tree}, x.l, x.i, y.i AS j, y.h FROM {nodes} x JOIN {nodes} y ON x.{tree} = y.{tree} AND x.l = y.l AND x.i // 3 = y.i // 3) GROUP BY ALL"
MERKLE = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS t, {_LEAF("text")} AS h, {_LEAF("replace(text, chr(10), '')")} AS other, coalesce(({_CRC}) % 2 = 0, false) AS even FROM documents),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
n AS (SELECT t, 0 AS l, i, h, count(*) OVER (PARTITION BY t) AS c FROM f UNION ALL SELECT t, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(c) + 2) // 3 FROM n WHERE c > 1 GROUP BY t, l, i // 3),
sub AS MATERIALIZED (SELECT t, 0 AS one, t - 1 AS i, h FROM n WHERE c = 1),
m AS (SELECT one, 0 AS l, i, h, count(*) OVER () AS c FROM sub UNION ALL SELECT one, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(c) + 2) // 3 FROM m WHERE c > 1 GROUP BY one, l, i // 3),
sn AS MATERIALIZED ({_SIBLINGS.format(tree="t", nodes="n")}), sm AS MATERIALIZED ({_SIBLINGS.format(tree="one", nodes="m")}),
depth AS (SELECT t, max(l) AS top FROM n GROUP BY t), high AS (SELECT max(l) AS top FROM m),
way AS (SELECT r, t, i, 0 AS l, CASE WHEN even THEN coalesce(other, h) ELSE h END AS now, '' AS proof FROM f UNION ALL
  SELECT r, way.t, (CASE WHEN way.l = d.top THEN way.t - 1 ELSE way.i END) // 3, way.l + 1, sha256(coalesce(coalesce(sn.a, sm.a), '') || now || coalesce(coalesce(sn.b, sm.b), '')), proof || coalesce(coalesce(sn.a, sm.a), '') || coalesce(coalesce(sn.b, sm.b), '')
  FROM way JOIN depth d ON d.t = way.t CROSS JOIN high LEFT JOIN sn ON way.l < d.top AND sn.t = way.t AND sn.l = way.l AND sn.i = way.i
  LEFT JOIN sm ON way.l >= d.top AND sm.l = way.l - d.top AND sm.i = CASE WHEN way.l = d.top THEN way.t - 1 ELSE way.i END WHERE way.l < d.top + high.top)
SELECT f.doc_id, f.h AS leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = root.h AS verified
FROM way JOIN depth d ON d.t = way.t CROSS JOIN high JOIN f ON f.r = way.r JOIN sub ON sub.t = f.t CROSS JOIN (SELECT h FROM m WHERE c = 1) root WHERE way.l = d.top + high.top"""

ORACLES = {
    "op3_minhash_neardup": NEAR, "op5_quality_rules": QUALITY, "op6_decontaminate": LEAKS, "op8_html_wrapper": PAGES, "op9_url_filter": URLS, "op10_repeats": REPEATS,
    "op11_annulus_clusters": _clusters(), "op12_line_dedup": LINES, "op13_merkle_manifest": MERKLE,
}
