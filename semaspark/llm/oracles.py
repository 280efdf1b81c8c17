"""DuckDB SQL for the operators that SQL can express, by plain comparison."""

from __future__ import annotations

_COMPONENTS = """
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, COUNT(*) AS n FROM links GROUP BY x)
"""

CHATS = """
WITH t AS (
  SELECT conv_id, CASE WHEN role IS NULL THEN '0' ELSE '1' END || CASE WHEN text IS NULL THEN '0' ELSE '1' END || '<|' || COALESCE(role, '') || '|>' || chr(10) || COALESCE(text, '') || chr(10) || '<|end|>' || chr(10) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, COALESCE(role, ''), COALESCE(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY k) AS s FROM t GROUP BY conv_id),
m AS (SELECT a.conv_id, a.s FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.s[1] = a.s[1] AND len(b.s) > len(a.s) AND b.s[:len(a.s)] = a.s))
SELECT min(conv_id) AS conv_id, CAST(len(s) AS BIGINT) AS n_turns, COUNT(*) AS copies, array_to_string(list_transform(s, lambda x: x[3:]), '') AS rendered FROM m GROUP BY s
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
{_COMPONENTS}
SELECT d.doc_id, COALESCE(n, 0) AS n_links, least(d.doc_id, COALESCE(y, d.doc_id)) AS class_id, d.doc_id = least(d.doc_id, COALESCE(y, d.doc_id)) AS kept
FROM documents d LEFT JOIN degree ON degree.x = d.doc_id LEFT JOIN least_of ON least_of.x = d.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
{_COMPONENTS}
SELECT d.vec_id, COALESCE(n, 0) AS n_links, least(d.vec_id, COALESCE(y, d.vec_id)) AS component_id, d.vec_id = least(d.vec_id, COALESCE(y, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN degree ON degree.x = d.vec_id LEFT JOIN least_of ON least_of.x = d.vec_id
"""

DECONTAMINATION = """
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM dw WHERE len(w) > 0)),
ig AS (SELECT item_id, i - 1 AS at_, greatest(len(w) - 4, 1) AS span, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
df AS (SELECT g, 1 + ln((SELECT COUNT(DISTINCT item_id) FROM ig) / COUNT(DISTINCT item_id)) AS weight FROM ig GROUP BY g),
own AS (SELECT DISTINCT item_id, g, weight FROM ig JOIN df USING (g)),
total AS (SELECT item_id, SUM(weight) AS full_ FROM own GROUP BY item_id),
size_ AS (SELECT doc_id, COUNT(*) AS n FROM dg GROUP BY doc_id),
windows AS (SELECT DISTINCT doc_id, item_id, unnest(range(greatest(pos - span + 1, 0), least(pos, greatest(n - span, 0)) + 1)) AS start_, span FROM dg JOIN ig USING (g) JOIN size_ USING (doc_id)),
held AS (SELECT DISTINCT doc_id, item_id, start_, o.g, weight FROM windows JOIN dg USING (doc_id) JOIN own o USING (item_id) WHERE pos >= start_ AND pos < start_ + span AND dg.g = o.g),
alike AS (SELECT doc_id, item_id, start_, SUM(weight) / any_value(full_) AS similarity FROM held JOIN total USING (item_id) GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS item_ids, MAX(similarity) AS similarity FROM alike WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id)
SELECT d.doc_id, hit.doc_id IS NOT NULL AS contaminated, COALESCE(n_items, 0) AS n_items, COALESCE(item_ids, '') AS item_ids, ROUND(COALESCE(similarity, 0.0), 6) AS similarity FROM documents d LEFT JOIN hit ON hit.doc_id = d.doc_id
"""

ORACLES = {
    "op3_chat_snapshot_collapse": CHATS, "op5_decontamination_simhash": DECONTAMINATION,
    "op9_ngram_jaccard_join": JACCARD, "op10_embedding_near_dedup": EMBEDDINGS,
}


def licences(templates: dict[str, str], header: str, threshold: float = 0.6) -> str:
    """The license scan over documents as files, from the templates' text."""
    values = ", ".join(f"('{n}', '{b}')" for n, b in templates.items())
    n = len(templates)
    return f"""
WITH tpl(name, body) AS (VALUES {values}),
tt AS (SELECT name, term, COUNT(*) AS tf FROM (SELECT name, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS term FROM tpl) GROUP BY 1, 2),
idf AS (SELECT term, ln({n + 1}.0 / (1 + COUNT(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT name, term, tf * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT name, sqrt(SUM(w * w)) AS n FROM tw GROUP BY name),
f AS (SELECT doc_id, text, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 200 AS VARCHAR)) AS dir,
  CASE WHEN doc_id % 10 = 0 THEN 'LICENSE.' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS name_ FROM documents),
h AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(COALESCE(text, ''), '\\r?\\n'), lambda l: regexp_matches(l, '{header}')), chr(10)) AS head FROM f),
hw AS (SELECT doc_id, term, tf * COALESCE(idf, ln({n + 1}.0) + 1) AS w FROM (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(head), '[\\p{{L}}\\p{{N}}]+')) AS term FROM h WHERE head <> '') GROUP BY 1, 2) LEFT JOIN idf USING (term)),
hn AS (SELECT doc_id, sqrt(SUM(w * w)) AS n FROM hw GROUP BY doc_id),
cs AS (SELECT hw.doc_id, tw.name, SUM(hw.w * tw.w) / any_value(hn.n) / any_value(tn.n) AS c FROM hw JOIN tw USING (term) JOIN hn ON hn.doc_id = hw.doc_id JOIN tn ON tn.name = tw.name GROUP BY 1, 2),
best AS (SELECT doc_id, name, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 10) DESC, name) AS r FROM cs) WHERE r = 1),
own AS (SELECT f.doc_id, dir, name_, CASE WHEN c >= {threshold} THEN best.name END AS license, COALESCE(c, 0.0) AS cosine FROM f LEFT JOIN best USING (doc_id)),
given AS (SELECT dir AS above, license AS theirs FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY round(cosine, 10) DESC, license) AS r FROM own WHERE name_ LIKE 'LICENSE%' AND license IS NOT NULL) WHERE r = 1),
ups AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:d], '/') AS above, d FROM own, range(0, 4) t(d)),
near AS (SELECT dir, above, theirs FROM (SELECT u.*, theirs, row_number() OVER (PARTITION BY dir ORDER BY d DESC) AS r FROM ups u JOIN given USING (above)) WHERE r = 1)
SELECT own.doc_id, own.dir || '/' || name_ AS path, COALESCE(license, theirs) AS license, ROUND(cosine, 6) AS cosine, CASE WHEN license IS NOT NULL THEN 'own' ELSE above END AS origin
FROM own LEFT JOIN near ON near.dir = own.dir
"""
