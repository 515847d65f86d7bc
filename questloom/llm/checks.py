"""DuckDB SQL for the queries that SQL can express, written from their contracts and the methods' definitions."""

from __future__ import annotations

from questloom.llm import mixing, quality_rules, secrets


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = rf"""
WITH read AS (
  SELECT page_id, html,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), {_CAPITALS}) END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') END AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS parts
  FROM pages),
named AS (
  SELECT page_id, html, coalesce(host, '') AS host, coalesce(path, '') AS path,
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(parts) = 0 THEN '' ELSE '?' || array_to_string(parts, '&') END AS address
  FROM read),
rules(rule, host, path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
listed AS (SELECT DISTINCT address FROM named WHERE NOT contains(html, '</html>') AND address IS NOT NULL),
best AS (
  SELECT n.*, r.rule, r.verdict, row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rule) DESC NULLS LAST, length(r.host) DESC, r.rule DESC, r.verdict DESC) AS place
  FROM named n LEFT JOIN rules r
    ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path))
SELECT page_id, host, path, rule, l.address IS NOT NULL AND rule IS NULL AS listed,
  coalesce(verdict, CASE WHEN l.address IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM best LEFT JOIN listed l USING (address) WHERE place = 1
"""

OP6 = f"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5('1:' || doc_id), 1, 12))::BIGINT AS draw FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ({list(mixing.WEIGHTS)})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum({mixing.MOST} * source_size) OVER before)::BIGINT, 0))::DOUBLE
    / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER before)::BIGINT, 0))::DOUBLE AS level
  FROM sources WINDOW before AS (
    ORDER BY {mixing.MOST} * source_size::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, {mixing.MOST} * source_size::DOUBLE <= weight * level AS is_full FROM levels),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN {mixing.MOST} * source_size::DOUBLE
    ELSE weight * max(CASE WHEN NOT is_full THEN level END) OVER () END AS target FROM filled),
plans AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM goals),
drawn AS (
  SELECT p.source, d.draw, sum(d.size) AS size, any_value(p.target - p.whole * p.source_size) AS wanted
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source GROUP BY p.source, d.draw),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw) AS through FROM drawn WHERE wanted > 0),
ends AS (SELECT source, draw, abs(through - wanted) AS off FROM summed UNION ALL SELECT DISTINCT source, -1, wanted FROM summed),
cuts AS (SELECT source, draw AS cut FROM ends QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, draw) = 1)
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (p.whole + (d.draw <= coalesce(c.cut, -1))::INT))::BIGINT AS taken
FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""


def _op7() -> str:
    rules = quality_rules.RULES
    rows = [
        f"('{name}', {place}, {i}, {float(cut)}, {sign})"
        for place, (name, (_, sign, cuts)) in enumerate(rules.items())
        for i, cut in enumerate(cuts)
    ]
    values = " ".join(
        f"WHEN '{name}' THEN " + (f"{top}::DOUBLE / nullif({below}, 0)" if below else f"{top}::DOUBLE")
        for name, (ratio, _, _) in rules.items()
        for top, _, below in [ratio.partition(" / ")]
    )
    risk = quality_rules.ALPHA / len(rules)
    return rf"""
WITH tokens AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lined AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM tokens),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM tokens),
windows AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM spots),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measured AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM lined LEFT JOIN repeated USING (doc_id)),
failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
rules(rule, place, i, cutoff, sign) AS (VALUES {", ".join(rows)}),
tried AS (
  SELECT f.*, r.*, CASE r.rule {values} END AS ratio FROM failing f, rules r),
hits AS (SELECT *, coalesce(CASE WHEN sign > 0 THEN ratio > cutoff ELSE ratio < cutoff END, false) AS hit FROM tried),
truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
counted AS (
  SELECT lang, rule, i, cutoff, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND hit) AS good_hit,
    count(*) FILTER (quality = 0 AND hit) AS bad_hit
  FROM hits JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
sizes AS (SELECT lang, max(n_good) AS n FROM counted GROUP BY lang),
terms AS (
  SELECT lang, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({risk}) + (n - k) * ln(1 - {risk})) AS p
  FROM (SELECT lang, n, unnest(range(0, floor(n * {risk})::BIGINT + 1)) AS k FROM sizes)),
allowed AS (
  SELECT lang, max(k) AS k FROM (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY k) AS total FROM terms)
  WHERE total <= {quality_rules.DELTA} / ((SELECT count(*) FROM rules) * (SELECT count(*) FROM sizes)) GROUP BY lang),
chosen AS (
  SELECT c.lang, rule, i FROM counted c JOIN allowed a ON c.lang IS NOT DISTINCT FROM a.lang
  WHERE good_hit <= k AND bad_hit > 0 QUALIFY row_number() OVER (PARTITION BY c.lang, rule ORDER BY bad_hit DESC, i) = 1),
broken AS (
  SELECT doc_id, string_agg(h.rule, ',' ORDER BY place) AS broken
  FROM hits h JOIN chosen c ON h.lang IS NOT DISTINCT FROM c.lang AND h.rule = c.rule AND h.i = c.i WHERE hit GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND b.broken IS NULL AS kept, coalesce(b.broken, '') AS broken
FROM failing LEFT JOIN broken b USING (doc_id)
"""


OP7 = _op7()


def _op8() -> str:
    found = []
    for place, rule in enumerate(secrets.RULES):
        pattern = _text(rule.pattern)
        found.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, string_split_regex(text, {pattern}) AS parts,"
            f" regexp_extract_all(text, {pattern}, 0) AS whole, regexp_extract_all(text, {pattern}, {rule.group}) AS held, {rule.least} AS least"
            f" FROM documents WHERE regexp_matches(text, {pattern})"
        )
    return f"""
WITH found AS ({" UNION ALL ".join(found)}),
spots AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, kind, place, length(array_to_string(parts[1:i], '')) + length(array_to_string(whole[1:i - 1], '')) AS start,
    length(whole[i]) AS width
  FROM spots WHERE length(held[i]) >= least),
named AS (SELECT *, kind || ':' || start || ':' || (start + width) AS name FROM spans),
summed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(name, ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(name, ',' ORDER BY start, place) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN summed USING (doc_id)
"""


OP8 = _op8()


def _op13() -> str:
    def digest(n_chars: str) -> str:
        fields = ["doc_id", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"

    # DuckDB has no crc32: its table, then one step a character of the id.
    return f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM (SELECT unnest(range(256)) AS b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
sums AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), crc_table),
leaves AS (
  SELECT doc_id, lang, {digest("n_chars")} AS leaf, crc % 7 = 0 AS tampered, {digest("n_chars + 1")} AS other
  FROM documents LEFT JOIN sums USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, level, pos, n, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
beside AS (
  SELECT p.doc_id, p.lang, p.pos, n.level, n.digest, n.pos % 2 AS on_right
  FROM placed p JOIN nodes n ON p.lang IS NOT DISTINCT FROM n.lang AND n.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.doc_id, p.lang, p.pos, s.height + t.level, t.digest, t.pos % 2
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON t.pos = xor(s.pos >> t.level, 1)),
proofs AS (SELECT lang, pos, sha256(string_agg(digest, '' ORDER BY level, on_right)) AS proof_sha256 FROM beside GROUP BY lang, pos),
ways AS (
  SELECT p.lang, p.pos, s.subroot, s.height + (SELECT max(level) FROM tops) AS height,
    CASE WHEN tampered THEN coalesce(other, leaf) ELSE leaf END AS start
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang),
folds(lang, pos, level, height, digest) AS (
  SELECT lang, pos, 0, height, start FROM ways
  UNION ALL
  SELECT f.lang, f.pos, f.level + 1, f.height, sha256(CASE WHEN on_right = 0 THEN b.digest ELSE '' END || f.digest || CASE WHEN on_right = 1 THEN b.digest ELSE '' END)
  FROM folds f LEFT JOIN beside b ON f.lang IS NOT DISTINCT FROM b.lang AND f.pos = b.pos AND f.level = b.level WHERE f.level < f.height)
SELECT p.doc_id, p.leaf, w.subroot, r.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN ways w ON p.lang IS NOT DISTINCT FROM w.lang AND p.pos = w.pos
  JOIN folds f ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos AND f.level = f.height
  LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos
  CROSS JOIN (SELECT digest FROM tops WHERE n = 1) r
"""


OP13 = _op13()
