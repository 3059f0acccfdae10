"""DuckDB SQL for the registered queries that SQL can state."""

from __future__ import annotations

from . import line_dedup, warc
from .shared import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]+"
_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


OP3 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_folded("text")}, '{_WORD}') AS ws FROM documents
), occurrence AS (
  SELECT r, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS before FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)
), c1 AS (SELECT w, count(*) AS n FROM occurrence GROUP BY w),
o1 AS (SELECT r, w, count(*) AS n FROM occurrence GROUP BY r, w),
c2 AS (SELECT before, w, count(*) AS n FROM occurrence WHERE i > 1 GROUP BY before, w),
o2 AS (SELECT r, before, w, count(*) AS n FROM occurrence WHERE i > 1 GROUP BY r, before, w),
total AS (SELECT count(*) AS n FROM occurrence),
scored AS (
  SELECT p.r, CASE
    WHEN p.i > 1 AND c2.n > o2.n THEN ln(c2.n - o2.n) - ln(greatest(cb.n - ob.n, 0.5))
    ELSE ln(greatest(cw.n - ow.n, 0.5)) - ln(greatest((SELECT n FROM total) - len(d.ws), 1)) + CASE WHEN p.i > 1 THEN ln(0.4) ELSE 0 END END AS s
  FROM occurrence p JOIN d ON d.r = p.r
  JOIN c1 cw ON cw.w = p.w JOIN o1 ow ON ow.r = p.r AND ow.w = p.w
  LEFT JOIN c1 cb ON cb.w = p.before LEFT JOIN o1 ob ON ob.r = p.r AND ob.w = p.before
  LEFT JOIN c2 ON c2.before = p.before AND c2.w = p.w LEFT JOIN o2 ON o2.r = p.r AND o2.before = p.before AND o2.w = p.w
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, round(sum(s.s), 3) AS log_score, round(sum(s.s) / len(d.ws), 6) AS mean_log_score
FROM d LEFT JOIN scored s ON s.r = d.r GROUP BY d.r, d.doc_id, len(d.ws)
"""


def _encoded(column: str) -> str:
    for code in warc.CONTROLS[1:]:
        column = f"replace({column}, chr({code}), '%{code:02X}')"
    return column


OP4 = f"""
WITH p AS (SELECT page_id, {_encoded("url")} AS url, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, max(page_id) AS keeper FROM p WHERE bytes >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, bytes::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, url
FROM p LEFT JOIN k ON k.digest = p.digest
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_folded("text")}, '{_BENCH_WORD}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_folded("text")}, '{_BENCH_WORD}') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, span, array_to_string(ws[i : i + span - 1], ' ') AS w
  FROM (SELECT item, ws, least(len(ws), 13) AS span, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)
), doc_windows AS (
  SELECT r, span, i, array_to_string(ws[i : i + span - 1], ' ') AS w
  FROM (SELECT r, ws, span, unnest(range(1, len(ws) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM item_windows) WHERE len(ws) >= span)
), hit AS (SELECT r, i, span, item FROM doc_windows JOIN item_windows USING (span, w)),
hit_words AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, unnest(range(0, span)) AS k FROM hit) GROUP BY r),
hit_items AS (SELECT r, list_sort(list(DISTINCT item) FILTER (item IS NOT NULL)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def url_sql(rules: list[tuple[str, str]]) -> str:
    """Verdicts of host/path rules; the longest that fits wins, else allow."""
    listed = ", ".join(f"('{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in rules)
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), fits AS (
  SELECT n, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) AS turn
  FROM p JOIN (VALUES {listed}) AS listed(rule, rule_host, rule_path, verdict)
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits ON fits.n = p.n AND turn = 1
"""


OP9 = rf"""
WITH shown AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{line_dedup.HIDDEN}', ' ', 'g'), '{line_dedup.CUT}', chr(10), 'g'), '{line_dedup.TAG}', ' ', 'g'), '[ \t]+', ' ', 'g') AS bare
  FROM pages
), p AS (SELECT r, page_id, host, list_filter(list_transform(string_split(bare, chr(10)), lambda x: trim(x, ' ')), lambda x: x != '') AS lines FROM shown),
held AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
totals AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
common AS (SELECT host, list(line) AS gone FROM held JOIN totals USING (host) WHERE n > {line_dedup.RATIO} * pages GROUP BY host),
cut AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN common USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM cut
"""

OP10 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce('i' || doc_id, 'n') || ':' || coalesce('t' || text, 'n')), 1, 15))::BIGINT AS place FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
weighted AS (SELECT *, [5.0, 2.0, 1.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM sizes),
filled AS (
  SELECT *, most / weight AS full_at, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM weighted
), level AS (SELECT arg_min(own_level, (full_at, rank)) AS level FROM filled WHERE own_level <= full_at),
targets AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM level) * weight, most)) AS target,
    CASE WHEN max(rank) OVER () > 1 THEN 0.5::DOUBLE * (1 - 2 * (rank - 1) / (max(rank) OVER () - 1)) ELSE 0.0 END::DOUBLE AS a FROM filled
), placed AS (
  SELECT doc_id, size, source_size, target, a,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2 AS middle
  FROM d JOIN targets ON d.source IS NOT DISTINCT FROM targets.source
), timed AS (
  SELECT doc_id, size, source_size, target, p, a, CASE WHEN target > 0 THEN (p * source_size + middle) / target ELSE 0.0 END AS u,
    p * source_size + middle <= target AND (p = 0 OR size > 0) AS fits, middle FROM placed, (VALUES (0), (1)) AS passes(p)
), moment AS (
  SELECT *, CASE WHEN NOT fits THEN NULL WHEN a = 0 THEN u ELSE ((1 + a) - sqrt(greatest((1 + a) * (1 + a) - 4 * a * u, 0.0))) / (2 * a) END AS t FROM timed
)
SELECT f.doc_id, f.size, f.source_size, round(f.target, 6) AS target, f.size * (f.fits::BIGINT + s.fits::BIGINT) AS taken, round(f.t, 12) AS position, round(s.t, 12) AS second_position
FROM moment f JOIN moment s ON f.doc_id IS NOT DISTINCT FROM s.doc_id AND f.source_size = s.source_size AND f.middle = s.middle AND f.size = s.size
WHERE f.p = 0 AND s.p = 1
"""


def _merkle_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _merkle_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_merkle_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of an ASCII text, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({0}) + 1), lambda i: ascii({0}[i])::BIGINT)), lambda a, b: "
    "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
)


def _merkle_tree(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, pos, n, digest), and their runs of siblings."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16, n
), {name}_runs AS (SELECT tree, level, pos // 16 AS parent, list(digest ORDER BY pos) AS run FROM {name} WHERE n > 1 GROUP BY ALL)"""


OP13 = f"""
WITH RECURSIVE l0 AS (
  SELECT doc_id, coalesce('.' || source, '') AS tree, {_merkle_leaf("text")} AS digest,
    CASE WHEN {_CRC.format("(doc_id::VARCHAR)")} % 5 = 0 THEN {_merkle_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS seen
  FROM documents
), l1 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r FROM l0
), {_merkle_tree("t", "l1")},
tops AS (SELECT tree AS name, '' AS tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_merkle_tree("u", "tops")},
root AS (SELECT digest AS root FROM u WHERE n = 1),
steps AS (
  SELECT l1.r, x.level, (l1.pos // (16 ** x.level)::BIGINT % 16) AS place, x.run FROM l1 JOIN t_runs x ON x.tree = l1.tree AND x.parent = l1.pos // (16 ** (x.level + 1))::BIGINT
  UNION ALL
  SELECT l1.r, 100 + x.level, (s.pos // (16 ** x.level)::BIGINT % 16), x.run
  FROM l1 JOIN tops s ON s.name = l1.tree JOIN u_runs x ON x.parent = s.pos // (16 ** (x.level + 1))::BIGINT
), ordered AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS step, array_to_string(run[:place], '') AS before, array_to_string(run[place + 2:], '') AS after FROM steps
), folded AS (
  SELECT r, 0::BIGINT AS step, coalesce(seen, digest) AS digest FROM l1
  UNION ALL
  SELECT f.r, f.step + 1, sha256(o.before || f.digest || o.after) FROM folded f JOIN ordered o ON o.r = f.r AND o.step = f.step + 1
), proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) AS last FROM ordered GROUP BY r)
SELECT l1.doc_id, l1.digest AS leaf, s.digest AS subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = root.root AS verified
FROM l1 JOIN tops s ON s.name = l1.tree CROSS JOIN root LEFT JOIN proofs p ON p.r = l1.r JOIN folded f ON f.r = l1.r AND f.step = coalesce(p.last, 0)
"""


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def divergence_sql(least_docs: int, top: int) -> str:
    share = lambda count, n: f"(1 + (1000000000::HUGEINT * (({count}) + 5)) // (({n}) + 5 * terms))"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_folded("text")}, '{_TERM}') AS ws FROM documents
), w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
terms AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
langs AS (SELECT l.lang, count(t.term) AS terms, coalesce(sum(t.total), 0) AS lang_n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN terms t ON t.lang = l.lang GROUP BY l.lang),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN terms t ON t.lang = w.lang AND t.term = w.term GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source),
shares AS (
  SELECT g.lang, g.source, t.term, coalesce(c.c, 0) AS c, {share("coalesce(c.c, 0)", "g.n")} AS p, {share("t.total", "l.lang_n")} AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN terms t ON t.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
), over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over)
) WHERE part = 'pair' OR rank <= {top}
"""
