"""DuckDB SQL that says the same as the queries that SQL can express."""

from __future__ import annotations

from tasklattice.llm import near_dedup, quality_rules, url_filters

WORD = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def quality_sql(p: quality_rules.QualityParams = quality_rules.PRODUCTION) -> str:
    q = quality_rules
    n_line = f"len(regexp_extract_all(line, '{WORD}'))"
    separators = f"len(regexp_extract_all(line, '{q.SEPARATORS}'))"
    phrases = f"len(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_text('|'.join(q.BOILERPLATE))}))"
    rule = f"""CASE WHEN {separators} >= {p.min_separators} AND {separators} * 100 >= {n_line} * {p.min_separator_percent} THEN 'navigation'
      WHEN {phrases} > 0 AND {n_line} <= {phrases} * {p.phrase_words} THEN 'boilerplate'
      WHEN len(regexp_extract_all(line, {_text(q.CLUTTER)})) * 100 >= {n_line} * {p.max_clutter_percent} THEN 'punctuation'
      WHEN {n_line} < {p.short_line_words} AND NOT regexp_matches(line, {_text(q.CLOSERS + r"[\x20\x09-\x0D]*$")}) THEN 'punctuation' END"""
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT doc_id, a, b, c FROM grams GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM grams JOIN twice USING (doc_id, a, b, c)) GROUP BY 1),
lines AS (SELECT doc_id, line, {rule} AS rule FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORD}')),
by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(rule) AS removed, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (WHERE rule IS NOT NULL), 0) AS lost FROM lines GROUP BY 1),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(removed, 0) AS n_removed_lines, coalesce(chars, 0)::BIGINT AS line_chars, coalesce(lost, 0)::BIGINT AS lost_chars
  FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN by_line USING (doc_id))
SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words) AND lost_chars * 100 <= line_chars * {p.max_lost_percent} AS kept FROM base"""


def dedup_sql(p: near_dedup.DedupParams = near_dedup.PRODUCTION) -> str:
    k = p.shingle_words
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= {k} THEN range(1, len(w) - {k - 2}) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM docs))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {p.min_percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM both_ways UNION SELECT b, r FROM reach JOIN both_ways ON a = doc_id),
least_of AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.doc_id = d.doc_id"""


def warc_sql() -> str:
    digit = "('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER"
    base32 = f"array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (({digit} >> (15 - 5 * (i % 4))) & 31)::INTEGER]), '')"
    return f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), lead_of AS (SELECT html, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, nullif(url, '') AS target_uri
FROM p JOIN lead_of USING (html)"""


#: Levels that the SQL spells out; the paths of the tables have no more segments.
URL_LEVELS = 8


def url_sql(p: url_filters.UrlParams = url_filters.PRODUCTION) -> str:
    fits = "NULL"
    action = "NULL"
    for r in sorted(p.rules, key=lambda r: (len(r.text), r.action == "block", r.text)):
        cond = f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        fits, action = f"CASE WHEN {cond} THEN '{r.text}' ELSE {fits} END", f"CASE WHEN {cond} THEN '{r.action}' ELSE {action} END"
    steps = []
    for d in range(URL_LEVELS):
        seg = f"segments[{d + 1}]"
        unlike = f"abs(blocked / labelled - nb / nl) > {p.merge_z} * sqrt((nb / nl) * (1.0 - nb / nl) * (1.0 / labelled + 1.0 / nl))"
        steps.append(f"""c{d} AS MATERIALIZED (SELECT host, template, {seg} AS s, count(*) AS c, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM t{d} WHERE len(segments) > {d} GROUP BY ALL),
n{d} AS MATERIALIZED (SELECT host, template, sum(labelled)::DOUBLE AS nl, sum(blocked)::DOUBLE AS nb FROM c{d} GROUP BY ALL HAVING count(*) >= {p.variable_children} AND round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)), 6) >= {p.evenness}),
o{d} AS MATERIALIZED (SELECT c.host, c.template, c.s FROM c{d} c JOIN n{d} n ON n.host = c.host AND n.template = c.template WHERE labelled >= {p.own_labels} AND {unlike}),
t{d + 1} AS MATERIALIZED (SELECT t.* REPLACE (t.template || CASE WHEN len(segments) <= {d} THEN '' ELSE '/' || CASE WHEN n.host IS NOT NULL AND o.host IS NULL THEN '*' ELSE {seg} END END AS template)
  FROM t{d} t LEFT JOIN n{d} n ON n.host = t.host AND n.template = t.template LEFT JOIN o{d} o ON o.host = t.host AND o.template = t.template AND o.s = {seg})""")
    s, last = p.smoothing, f"t{URL_LEVELS}"
    unlike = f"{p.merge_z} * sqrt((pb / pl) * (1.0 - pb / pl) * (1.0 / labelled + 1.0 / pl))"
    return f"""WITH rows AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT *, {fits} AS rule, {action} AS action FROM rows),
t0 AS MATERIALIZED (SELECT host, path, (action IS NOT NULL)::INT AS labelled, coalesce(action = 'block', false)::INT AS blocked, '' AS template, string_split(replace(regexp_replace(path, '^/|/$', '', 'g'), '*', '%2A'), '/') AS segments FROM (SELECT DISTINCT host, path, action FROM fit)),
{", ".join(steps)},
templates AS MATERIALIZED (SELECT host, template, regexp_replace(template, '/[^/]*$', '') AS parent, count(*)::DOUBLE AS n, sum(labelled)::DOUBLE AS labelled, sum(blocked)::DOUBLE AS blocked FROM {last} GROUP BY ALL),
overall AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS o FROM templates),
hosts AS (SELECT host, (sum(blocked) + any_value(o) * ({s}::DOUBLE + sum(n) - sum(labelled))) / (sum(n) + {s}::DOUBLE) AS hp FROM templates, overall GROUP BY 1),
siblings AS (SELECT host, parent, sum(labelled) AS pl, sum(blocked) AS pb FROM templates WHERE labelled > 0 GROUP BY 1, 2),
placed AS MATERIALIZED (SELECT host, parent, template, n, labelled, blocked, CASE WHEN labelled = 0 THEN 'none' WHEN blocked / labelled - pb / pl > {unlike} THEN 'above' WHEN pb / pl - blocked / labelled > {unlike} THEN 'below' ELSE 'like' END AS branch FROM templates LEFT JOIN siblings USING (host, parent)),
branches AS (SELECT host, parent, branch, (sum(blocked) + any_value(hp) * ({s}::DOUBLE + sum(n) - sum(labelled))) / (sum(n) + {s}::DOUBLE) AS purity FROM placed JOIN hosts USING (host) WHERE labelled > 0 GROUP BY ALL),
judged AS MATERIALIZED (SELECT host, template, branch <> 'none' AS holds, round(coalesce(purity, hp), 9) AS purity FROM placed LEFT JOIN branches USING (host, parent, branch) JOIN hosts USING (host))
SELECT page_id, f.host, f.path, rule, coalesce(action, CASE WHEN holds AND purity >= {p.reject_purity} THEN 'block' ELSE 'allow' END) AS verdict, j.template, purity
FROM fit f JOIN {last} t ON t.host = f.host AND t.path = f.path JOIN judged j ON j.host = t.host AND j.template = t.template"""


SQL = {
    "op1_quality_rules": quality_sql(),
    "op5_minhash_dedup": dedup_sql(),
    "op8_warc_transactions": warc_sql(),
    "op10_url_filters": url_sql(),
}
