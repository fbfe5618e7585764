"""SQL twins of the queries of this folder that SQL can express."""

from __future__ import annotations

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP2 = r"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, pos, line,
         regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (key)
GROUP BY doc_id
"""

OP5 = r"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix/' || concat_ws('/', doc_id, text)) AS key
  FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM total),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT arg_min(level, cap / weight) FILTER (level * weight <= cap) AS level FROM levels),
plan AS (
  SELECT source, source_size, least(cap, coalesce(weight * chosen.level, cap)) AS target
  FROM levels, chosen),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((budget // greatest(source_size, 1)) * size
        + greatest(0, least(size, budget % greatest(source_size, 1) - start)))::BIGINT AS taken
FROM placed
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _near(words: int, percent: int) -> str:
    """Components of links among documents as sets of shingles."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL)
  JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y
  WHERE 100 * shared >= {percent} * (m.n + n.n - shared)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.y FROM reached r JOIN links l ON r.b = l.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) r ON r.a = d.doc_id
"""


def _op4(rounds: int = 8, damping: float = 0.85, limit: float = 0.5) -> str:
    """The rounds of the graph written out one after the other."""
    ctes = []
    for i in range(rounds):
        ctes.append(f"""
s{i + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
  SELECT host, good AS trust, bad AS distrust FROM seeds
  UNION ALL SELECT dst, share * trust * {damping}::DOUBLE, 0::DOUBLE FROM edges JOIN s{i} ON src = host
  UNION ALL SELECT src, 0::DOUBLE, back * distrust * {damping}::DOUBLE FROM edges JOIN s{i} ON dst = host)
  GROUP BY host)""")
    fits = """CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END"""
    return rf"""
WITH parts AS MATERIALIZED (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (SELECT page_id, html, host, path, {fits} AS rule FROM parts),
ruled AS MATERIALIZED (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said
  FROM named),
seeds AS MATERIALIZED (
  SELECT host, avg((said IS NOT DISTINCT FROM 'allow')::INT) AS good, avg((said IS NOT DISTINCT FROM 'block')::INT) AS bad
  FROM ruled WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html,
    '(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s<>]+)', 1)), {_LOWER}) AS dst
  FROM ruled),
pairs AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY ALL),
edges AS MATERIALIZED (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share, n / sum(n) OVER (PARTITION BY dst) AS back FROM pairs),
s0 AS (SELECT host, good AS trust, bad AS distrust FROM seeds),{",".join(ctes)}
SELECT page_id, r.host, path, rule,
       coalesce(said, CASE WHEN distrust >= {limit} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN s{rounds} s ON s.host = r.host
"""

OP12 = rf"""
WITH words AS MATERIALIZED (
  SELECT row, doc_id, term, count(*) AS tf
  FROM (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, {_LOWER}),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents))
  GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM words GROUP BY row),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM words, corpus GROUP BY term),
asked AS (
  SELECT DISTINCT item, item_id, term
  FROM (SELECT item, item_id, unnest(regexp_extract_all(translate(text, {_LOWER}),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT item_id, text, row_number() OVER () AS item FROM benchmark))),
scored AS (
  SELECT item, item_id, row, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN words USING (term) JOIN weights USING (term) JOIN sizes USING (row), corpus
  GROUP BY ALL HAVING score > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


ORACLES = {
    "op1_exact_dedup": OP1,
    "op2_line_dedup": OP2,
    "op3_near_duplicates": _near(5, 75),
    "op4_url_filter": _op4(),
    "op5_mixing": OP5,
    "op11_minhash": f"SELECT *, doc_id = component_id AS kept FROM ({_near(2, 80)})",
    "op12_lexical_search": OP12,
}
