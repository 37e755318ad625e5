"""DuckDB SQL of the operators that SQL can express, over whole tables and by plain definition: no prefixes, indexes or samples."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs of classes of equal sets that share a shingle are counted; components by the closure of the links.
NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words),
keyed AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k FROM sets),
classes AS (SELECT min(doc_id) AS node, k, any_value(s) AS s, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY k),
items AS (SELECT node, n, unnest(s) AS h FROM classes),
links AS (SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.h = b.h AND a.node < b.node
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, CASE WHEN d.n = 0 THEN d.doc_id ELSE l.c END AS component_id
FROM keyed d LEFT JOIN classes c ON c.k = d.k AND d.n > 0 LEFT JOIN least l ON l.a = c.node"""

#: The same with the number of links of each document's class.
NGRAM_JACCARD_LINKS = (
    NGRAM_JACCARD.replace("least AS (", "degrees AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),\nleast AS (").replace(" AS component_id\n", " AS component_id, coalesce(g.n, 0) AS n_links\n")
    + " LEFT JOIN degrees g ON g.a = c.node"
)

#: Every run of words of a document, of each length that a window has, is looked up among the windows.
DECONTAMINATION = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS k FROM items WHERE len(w) > 0),
runs AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS k
    FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
found AS (SELECT r.doc_id, r.i, r.size, v.item_id FROM runs r JOIN windows v ON v.k = r.k AND v.size = r.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: All strings of 200 bytes are counted by their 128-bit md5; texts are cut into overlapping blocks first, as finding a place in a string takes time.
SUFFIX_DEDUP = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
sized AS (SELECT doc_id, x, length(x) // 2 AS n FROM texts),
blocks AS (SELECT doc_id, n, unnest(range(0, (n - 200) // 512 + 1)) AS k, x FROM sized WHERE n >= 200),
pieces AS (SELECT doc_id, k * 512 AS base, substring(x, 1024 * k + 1, 1024 + 398) AS y FROM blocks),
starts AS (SELECT doc_id, base, y, unnest(range(0, least(512, length(y) // 2 - 199))) AS i FROM pieces),
strings AS (SELECT doc_id, base + i AS p, md5_number(substring(y, 2 * i + 1, 400)) AS h FROM starts),
twice AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM strings SEMI JOIN twice USING (h)),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS fresh FROM hit),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS lo, max(p) + 200 AS hi FROM numbered GROUP BY doc_id, run),
edges AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spans UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS y FROM edges e JOIN sized USING (doc_id) GROUP BY e.doc_id),
counted AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM sized LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)"""

#: The next document is that of the next id, after the last the first.
EDITED_TEXTS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS u FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(t, 1, n - n // 4) || substring(u, 1, n // 4)) AS edited_sha256 FROM n"""

#: Of the rules that fit, the longest.
URL_RULES = r"""
WITH rules AS (SELECT * FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) t(verdict, rule)),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
fits AS (SELECT p.page_id, r.rule, r.verdict FROM parts p JOIN rules r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1))) AND starts_with(p.path, substring(r.rule, strpos(r.rule, '/')))
    QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) = 1)
SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM parts p LEFT JOIN fits f USING (page_id)"""

ORACLE_SQL: dict[str, str] = {"op3_edited_texts": EDITED_TEXTS, "op9_url_rules": URL_RULES, "op4_ngram_jaccard_join": NGRAM_JACCARD, "op4_ngram_jaccard_links": NGRAM_JACCARD_LINKS, "op6_fm_decontamination": DECONTAMINATION, "op7_suffix_dedup": SUFFIX_DEDUP}
