"""SQL for DuckDB that gives the rows of the numbered queries, by plain definitions."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def url_filters(rules: tuple[tuple[str, str], ...]) -> str:
    listed = ", ".join(f"('{p}', '{p.partition('/')[0]}', '{p[len(p.partition('/')[0]):]}', '{v}')" for p, v in rules)
    split = lambda u: f"CASE WHEN contains({u}, '://') THEN substr({u}, instr({u}, '://') + 3) END"
    host = lambda u: f"coalesce(translate(regexp_extract({split(u)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = lambda u: f"coalesce(regexp_extract({split(u)}, '^[^/?#]*([^?#]*)', 1), '')"
    query = lambda u: f"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)='))), '&')"
    key = lambda u: f"CASE WHEN {host(u)} <> '' THEN regexp_replace({host(u)}, '^www\\.', '') || regexp_replace({path(u)}, '/+$', '') || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END END"
    steps = lambda p: f"list_transform(string_split(regexp_extract({p}, '^([^?#]*)', 1), '/')[2:], lambda x: [x])"
    tidied = lambda p: f"array_to_string(list_reduce(list_concat([['']], {steps(p)}), lambda a, x: CASE WHEN x[1] = '..' THEN a[:greatest(len(a) - 1, 1)] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END), '/')"
    tidy = lambda p: f"CASE WHEN regexp_matches(regexp_extract({p}, '^([^?#]*)', 1), '/\\.\\.?(?:/|$)') THEN {tidied(p)} || regexp_extract({p}, '^[^?#]*((?s:.*))$', 1) ELSE {p} END"
    return f"""
WITH RECURSIVE rules(rule, rhost, rpath, v) AS (VALUES {listed}),
found AS (
  SELECT url AS src, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<link\\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')), lambda x: regexp_extract(x, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<meta\\b[^>]*>'), lambda x: regexp_matches(x, '(?i)http-equiv\\s*=\\s*["'']?refresh\\b')), lambda x: regexp_extract(x, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>;]+(?:;[^"''\\s>;]+)*)', 1)))) AS t
  FROM pages WHERE url IS NOT NULL),
told AS (SELECT src, regexp_replace(t, '(?i)&(?:amp|#0*38|#x0*26);', '&', 'g') AS t, regexp_extract(src, '^([^:/?#]+)://', 1) AS scheme, {host('src')} AS h, {path('src')} AS p FROM found WHERE t <> ''),
links AS (SELECT src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || h || {tidy('t')}
  WHEN starts_with(t, '?') THEN scheme || '://' || h || p || t
  WHEN NOT starts_with(t, '#') AND NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') AND h <> '' THEN scheme || '://' || h || {tidy("(CASE WHEN contains(p, '/') THEN regexp_replace(p, '[^/]*$', '') ELSE '/' END || t)")} END AS dst FROM told),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT src FROM links WHERE dst IS NOT NULL UNION SELECT dst FROM links WHERE dst IS NOT NULL),
known AS (SELECT url, {host('url')} AS host, {path('url')} AS path, {key('url')} AS key FROM urls),
ruled AS (SELECT k.*, (SELECT max_by(struct_pack(rule := rule, v := v), length(rule)) FROM rules WHERE (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath)) AS r FROM known k),
edges AS (SELECT a.key AS a, b.key AS b FROM links l JOIN known a ON a.url = l.src JOIN known b ON b.url = l.dst WHERE a.key <> b.key),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS node, a AS seen FROM ways UNION SELECT r.node, e.b FROM reach r JOIN ways e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
bad AS (SELECT DISTINCT coalesce(c.component, k.key) AS g FROM ruled k LEFT JOIN comp c ON c.node = k.key WHERE k.r.v = 'block' AND k.key IS NOT NULL)
SELECT p.page_id, k.host, k.path, k.r.rule AS rule, coalesce(k.r.v, CASE WHEN coalesce(c.component, k.key) IN (SELECT g FROM bad) THEN 'block' END, 'allow') AS verdict, c.component
FROM pages p LEFT JOIN ruled k ON k.url IS NOT DISTINCT FROM p.url LEFT JOIN comp c ON c.node = k.key"""


NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= 75 * (na + nb - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) m ON m.node = s.doc_id"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters FROM l LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT
  + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT + 32 * (n_letters > 0 AND 100 * n_upper > 60 * n_letters)::INT AS BIGINT) AS failed_bits FROM m)
SELECT *, 'strict-1' AS policy_version, failed_bits = 0 AS kept, failed_bits & 3 <> 0 AS base_failed FROM b"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM i)),
sz AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS x FROM (SELECT d.doc_id, d.w, sz.size, unnest(range(1, len(d.w) - sz.size + 2)) AS k FROM d, sz WHERE len(d.w) >= sz.size)),
h AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.x = iw.x),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items, sha256(coalesce(o.l, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, k FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS lo FROM g) WHERE lo < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS pos FROM r),
v AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT v.doc_id, string_agg(t, ' ' ORDER BY pos) AS t FROM v ANTI JOIN p USING (doc_id, pos) GROUP BY v.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""


def quality_ablation(rules: tuple[str, ...]) -> str:
    """Counts by rule, all of which reject, over the ledger."""
    full = (1 << len(rules)) - 1
    one = "SELECT 'strict-1' AS policy_version, count(*) AS n_docs, '{0}' AS rule, {1} AS bit, count(*) FILTER (failed_bits & {2} <> 0) AS n_failed, count(*) FILTER (failed_bits = {2}) AS n_failed_alone, count(*) FILTER (failed_bits & {3} = 0) AS n_kept_without FROM ledger"
    return f"WITH ledger AS ({QUALITY_RULES}) " + " UNION ALL ".join(one.format(r, k, 1 << k, full & ~(1 << k)) for k, r in enumerate(rules))


def merkle() -> str:
    """The tree level by level for each source, then over the sources; siblings by level, and the fold of the changed leaf with them."""
    field = lambda c: f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # CRC-32 bit by bit: every byte joins at its first step.
    steps = "list_concat([4294967295], list_transform(range(8 * length(cast(doc_id AS VARCHAR))), lambda i: CASE WHEN i % 8 = 0 THEN ord(substr(cast(doc_id AS VARCHAR), i // 8 + 1, 1)) ELSE 0 END))"
    crc = f"list_reduce({steps}, lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)))"
    up = "SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM {0} WHERE n > 1 GROUP BY g, lvl, pos // 3"
    power = "cast(3 ** {0} AS BIGINT)"
    siblings = lambda base, tree, keys: f"""SELECT {keys}, s.lvl, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < b.pos // {power.format('s.lvl')}), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > b.pos // {power.format('s.lvl')}), '') AS r
  FROM {base} b JOIN {tree} s ON s.g = b.g AND s.n > 1 AND s.pos // 3 = b.pos // {power.format('(s.lvl + 1)')} GROUP BY {keys}, s.lvl"""  # noqa: E731
    return f"""WITH RECURSIVE d AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND (xor({crc}, 4294967295) & 1) = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS f FROM documents),
 base AS (SELECT row_number() OVER () AS id, doc_id, g, h, f, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
 t(g, lvl, pos, h, n) AS (SELECT g, 0, pos, h, n FROM base UNION ALL {up.format('t')}),
 tops AS (SELECT 0 AS g, g AS pos, h, count(*) OVER () AS n FROM t WHERE n = 1),
 u(g, lvl, pos, h, n) AS (SELECT g, 0, pos, h, n FROM tops UNION ALL {up.format('u')}),
 inner_p AS ({siblings('base', 't', 'b.id')}), outer_p AS ({siblings('tops', 'u', 'b.pos')}),
 steps AS (SELECT id, lvl AS k, l, r FROM inner_p UNION ALL SELECT b.id, 1000 + o.lvl, o.l, o.r FROM base b JOIN outer_p o ON o.pos = b.g),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM steps),
 fold(id, i, f) AS (SELECT id, 0, f FROM base UNION ALL SELECT f.id, f.i + 1, sha256(p.l || f.f || p.r) FROM fold f JOIN numbered p ON p.id = f.id AND p.i = f.i + 1),
 ended AS (SELECT id, arg_max(f, i) AS f FROM fold GROUP BY id), proofs AS (SELECT id, string_agg(l || r, '' ORDER BY i) AS p FROM numbered GROUP BY id), root AS (SELECT h FROM u WHERE n = 1)
SELECT b.doc_id, b.h AS leaf, tops.h AS subroot, root.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.f AS folded_root, e.f = root.h AS verified
FROM base b JOIN tops ON tops.pos = b.g CROSS JOIN root JOIN ended e ON e.id = b.id LEFT JOIN proofs p ON p.id = b.id"""
