"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP7 = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""

#: The sharing by rounds: those above the limit are fixed at it, the others share the rest anew.
OP5 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM sources
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)
             - 3 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered
), final AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE level <= 3 * (source_size / weight)
), goals AS (
  SELECT source, source_size, CASE WHEN final.level IS NULL THEN source_size * 3.0::DOUBLE ELSE least(source_size * 3.0::DOUBLE, final.level * weight) END AS target
  FROM sources, final
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
), copied AS (
  SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""

OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), opened AS (
  SELECT conv_id, n, row_number() OVER (PARTITION BY role, text ORDER BY conv_id) AS place,
         min(conv_id) OVER (PARTITION BY role, text) AS first,
         nth_value(conv_id, 2) OVER (PARTITION BY role, text ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
  FROM turns WHERE k = 1
), pairs AS (
  SELECT conv_id, n, CASE WHEN place = 1 THEN second ELSE first END AS rejected_id FROM opened
), differing AS (
  SELECT p.conv_id, min(a.k) AS k
  FROM pairs p JOIN turns a ON a.conv_id = p.conv_id LEFT JOIN turns b ON b.conv_id = p.rejected_id AND b.k = a.k
  WHERE b.k IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY p.conv_id
), cut AS (
  SELECT p.conv_id, p.rejected_id, CASE WHEN p.rejected_id IS NULL THEN p.n - 1 ELSE coalesce(d.k - 1, p.n) END AS prefix
  FROM pairs p LEFT JOIN differing d USING (conv_id)
), parts AS (
  SELECT c.conv_id, 'prompt' AS part, t.* EXCLUDE conv_id FROM cut c JOIN turns t ON t.conv_id = c.conv_id AND t.k <= c.prefix
  UNION ALL SELECT c.conv_id, 'chosen', t.* EXCLUDE conv_id FROM cut c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.prefix
  UNION ALL SELECT c.conv_id, 'rejected', t.* EXCLUDE conv_id FROM cut c JOIN turns t ON t.conv_id = c.rejected_id AND t.k > c.prefix
), rendered AS (
  SELECT conv_id, part, k, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM parts
), placed AS (
  SELECT *, sum(len(piece)) OVER (PARTITION BY conv_id, part ORDER BY k) AS stop FROM rendered
), joined AS (
  SELECT conv_id, part, string_agg(piece, '' ORDER BY k) AS body,
         coalesce(string_agg((stop - len(text) - 11)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k) FILTER (role = 'assistant'), '') AS spans
  FROM placed GROUP BY conv_id, part
)
SELECT c.conv_id, c.rejected_id, c.prefix::BIGINT AS prefix_turns, sha256(coalesce(p.body, '')) AS prompt_sha256,
       sha256(coalesce(a.body, '')) AS chosen_sha256, sha256(coalesce(b.body, '')) AS rejected_sha256,
       coalesce(a.spans, '') AS chosen_mask, coalesce(b.spans, '') AS rejected_mask
FROM cut c LEFT JOIN joined p ON p.conv_id = c.conv_id AND p.part = 'prompt'
LEFT JOIN joined a ON a.conv_id = c.conv_id AND a.part = 'chosen' LEFT JOIN joined b ON b.conv_id = c.conv_id AND b.part = 'rejected'
"""

OP11 = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed
), chosen AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def _lloyd(k: int, rounds: int) -> str:
    """The rounds one after the other, each as tables of its own."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (
  SELECT row_id, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(x, m)])::BIGINT AS d FROM kept, c{r}
), a{r} AS MATERIALIZED (SELECT row_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY row_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM (SELECT a.c, unnest(x) AS v, unnest(range(64)) AS i FROM a{r} a JOIN kept USING (row_id)) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(any_value(f.m), any_value(c{r}.m)) AS m FROM c{r} LEFT JOIN (SELECT c, list(v ORDER BY i) AS m FROM s{r} GROUP BY c) f USING (c) GROUP BY c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, [floor(64 * v::DOUBLE)::BIGINT for v in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([v for v in embedding if v IS NOT NULL AND isfinite(v) AND abs(64 * v::DOUBLE) <= 134217728]) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS c, x AS m FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, 'null')) AS h, x FROM kept ORDER BY h, x LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row_id) JOIN c{rounds} USING (c)
"""


OP12 = _lloyd(16, 3)

ORACLES: dict[str, str] = {"op5_mixing": OP5, "op6_chat": OP6, "op7_exact_dedup": OP7, "op11_fim": OP11, "op12_clustering": OP12}
