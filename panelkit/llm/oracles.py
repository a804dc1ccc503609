"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '') AS raw,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(v, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM named, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT n.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM named n LEFT JOIN fitting USING (page_id)
"""

ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLES["op8_warc"] = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), seen AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM rows
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM seen
"""

ORACLES["op2_line_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), every AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM docs
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM every
), placed AS (
  SELECT *, row_number() OVER d AS i, sum(w) OVER (d ROWS UNBOUNDED PRECEDING) AS upto
  FROM counted WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), ranged AS (
  SELECT *, upto - w AS since, max(upto) OVER (PARTITION BY doc_id) AS total,
         count(*) OVER (PARTITION BY doc_id ORDER BY upto - w RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ahead,
         count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS back
  FROM placed
), sequences AS (
  SELECT doc_id, list(line ORDER BY i) AS lines FROM placed GROUP BY doc_id
), stretches AS (
  SELECT doc_id, i AS first, ahead AS n FROM ranged WHERE total - since >= 50
  UNION SELECT doc_id, i - back + 1, back FROM ranged WHERE upto >= 50
), named AS (
  SELECT doc_id, first, n, array_to_string(list_slice(lines, first, first + n - 1), chr(10)) AS body
  FROM stretches JOIN sequences USING (doc_id)
), later AS (
  SELECT doc_id, first, n FROM named
  QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, first) > 1
), gone AS (
  SELECT DISTINCT p.doc_id, p.pos FROM placed p JOIN later l ON p.doc_id = l.doc_id AND p.i BETWEEN l.first AND l.first + l.n - 1
), removed AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(places, '') AS removed_lines
FROM docs LEFT JOIN removed USING (doc_id)
"""

# crc32 of the decimal key: each byte is put in and followed by eight shifts
_CRC32 = """
list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                                                   FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda h, b: CASE WHEN b >= 0 THEN xor(h, b) ELSE xor(h >> 1, 3988292384 * (h & 1)) END)
"""

_RECORD = """
sha256(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
       || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
       || coalesce(strlen({text}) || ':' || {text}, '-'))
"""

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS g, {_RECORD.format(text="text")} AS leaf,
         CASE WHEN xor({_CRC32}, 4294967295) % 2 = 0 THEN {_RECORD.format(text="replace(text, chr(10), '')")} END AS bad
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS r FROM leaves
), nodes(g, level, i, d) AS (
  SELECT g, 0, r, leaf FROM placed
  UNION ALL
  SELECT g, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM nodes) WHERE c > 1 GROUP BY g, level, i // 3
), tops AS (
  SELECT g, arg_max(d, level) AS subroot, row_number() OVER (ORDER BY g) - 1 AS r FROM nodes GROUP BY g
), over(level, i, d) AS (
  SELECT 0, r, subroot FROM tops
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM over) WHERE c > 1 GROUP BY level, i // 3
), every AS (
  SELECT * FROM nodes UNION ALL SELECT NULL, * FROM over
), sides AS (
  SELECT a.g, a.level, a.i,
         coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM every a JOIN every b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.i // 3 = b.i // 3
       JOIN every c ON a.g IS NOT DISTINCT FROM c.g AND c.level = a.level + 1 AND c.i = a.i // 3
  GROUP BY a.g, a.level, a.i
), lower_part(doc_id, g, level, i, acc, proof) AS (
  SELECT doc_id, g, 0, r, coalesce(bad, leaf), '' FROM placed
  UNION ALL
  SELECT p.doc_id, p.g, p.level + 1, p.i // 3, sha256(l || acc || r), proof || l || r
  FROM lower_part p JOIN sides s ON p.g = s.g AND p.level = s.level AND p.i = s.i
), met AS (
  SELECT doc_id, g, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM lower_part GROUP BY doc_id, g
), upper_part(doc_id, level, i, acc, proof) AS (
  SELECT doc_id, 0, r, acc, proof FROM met JOIN tops USING (g)
  UNION ALL
  SELECT p.doc_id, p.level + 1, p.i // 3, sha256(l || acc || s.r), proof || l || s.r
  FROM upper_part p JOIN sides s ON s.g IS NULL AND p.level = s.level AND p.i = s.i
), ended AS (
  SELECT doc_id, arg_max(acc, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM upper_part GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN tops USING (g) JOIN ended USING (doc_id), (SELECT arg_max(d, level) AS root FROM over)
"""

ORACLES["op13_ranked_search"] = r"""
WITH every AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM every GROUP BY ALL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM every GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * N_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, N_docs
), lengths AS (
  SELECT doc_id, 100 - 50 + (50 * n * N_docs) // L AS m FROM sizes, corpus
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split
), members AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS both_n, count(*) AS o
  FROM members a JOIN members b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common WHERE 100 * o >= 85 * (both_n - o)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, s
"""
