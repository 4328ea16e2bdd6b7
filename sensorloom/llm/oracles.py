"""What the operators compute, as DuckDB SQL, for those that SQL can express."""

from __future__ import annotations

from sensorloom.llm.licenses import TEMPLATES, THRESHOLD, bigrams, least_common, longest

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD, _FOLDED = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
degree AS (SELECT x AS doc_id, count(*) AS n_links FROM both_ways GROUP BY x),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id,
       CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY CASE WHEN n.n IS NULL THEN 'none' || d.doc_id ELSE f END) END AS class_id
     , coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN degree USING (doc_id) LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
LEFT JOIN (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS f FROM g GROUP BY doc_id) USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
mark AS (SELECT word.doc_id, word.i, x, max(again.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
         FROM word LEFT JOIN again ON again.doc_id = word.doc_id AND again.i = word.i)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN mark USING (doc_id) GROUP BY d.doc_id, w
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_FOLDED}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_FOLDED}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
win AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM d, lens)),
hit AS (SELECT doc_id, i, m, item_id FROM win JOIN p USING (m, s)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def licenses() -> str:
    known = sorted({(name, tuple(bigrams(text))) for name, text in TEMPLATES})
    rows = ", ".join(f"({k}, '{name}', {len(g)}, {least_common(len(g), THRESHOLD)}, {longest(len(g), THRESHOLD)})" for k, (name, g) in enumerate(known))
    grams = ", ".join(f"({k}, '{x}')" for k, (_, g) in enumerate(known) for x in g)
    return rf"""
WITH t(k, license, n, least, most) AS (VALUES {rows}), tg(k, g) AS (VALUES {grams}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM w WHERE len(w) > 1),
pos AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS g FROM b),
mine AS (SELECT doc_id, k, i, g FROM pos JOIN tg USING (g)),
ok AS (SELECT doc_id, k FROM mine JOIN t USING (k) GROUP BY doc_id, k, least HAVING count(DISTINCT g) >= least),
near AS (SELECT m.* FROM mine m JOIN ok USING (doc_id, k)),
span AS (SELECT a.doc_id, a.k, a.i AS lo, z.i AS hi FROM near a JOIN near z ON a.doc_id = z.doc_id AND a.k = z.k AND z.i >= a.i JOIN t ON t.k = a.k WHERE z.i - a.i < most),
common AS (SELECT s.doc_id, s.k, s.lo, s.hi, count(DISTINCT m.g) AS c FROM span s JOIN near m ON m.doc_id = s.doc_id AND m.k = s.k AND m.i BETWEEN s.lo AND s.hi GROUP BY ALL),
s AS (SELECT c.doc_id, license, round(2.0 * c / (len(list_distinct(p[lo:hi])) + n), 6) AS dice FROM common c JOIN t USING (k) JOIN b ON b.doc_id = c.doc_id WHERE c >= least),
m AS (SELECT * FROM s WHERE dice >= {THRESHOLD})
SELECT d.doc_id, count(DISTINCT license) AS n_licenses, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
       arg_min(license, (-dice, license)) AS best_license, max(dice) AS best_dice
FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""


def sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN, "op2_substring_dedup": SUBSTRING_DEDUP, "op9_decontamination": DECONTAMINATION, "op10_licenses": licenses()}
