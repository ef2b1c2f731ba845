"""Independent DuckDB SQL for the operators that SQL can express."""

ORACLES = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
}
ORACLES["op6_line_dedup"] = r"""
WITH l AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
t AS (SELECT doc_id, site, i, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
bad AS (SELECT line FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
r AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE line NOT IN (SELECT line FROM bad)) AS kept, count(*) FILTER (WHERE line IN (SELECT line FROM bad)) AS gone FROM t GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone > 0 THEN coalesce(kept, '') ELSE text END AS text, gone AS lines_removed FROM documents d JOIN r USING (doc_id)"""
