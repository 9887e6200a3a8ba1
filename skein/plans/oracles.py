"""DuckDB SQL for the registered graph queries."""

from __future__ import annotations

GRAPH = r"""
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS name, 'namespace' AS kind, NULL::INT AS cc, r_regionkey::BIGINT AS node_seq FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'module', NULL, (1::BIGINT << 40) + n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'class', NULL, (2::BIGINT << 40) + c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'class', NULL, (3::BIGINT << 40) + s_suppkey FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, o_orderkey::VARCHAR, 'function', (1 + (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey))::INT, (4::BIGINT << 40) + o_orderkey FROM orders
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'function', p_size::INT, (5::BIGINT << 40) + p_partkey FROM part
), edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind, 'certain' AS confidence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'certain' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'certain' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'calls', 'certain' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls', CASE l_returnflag WHEN 'A' THEN 'certain' WHEN 'N' THEN 'inferred' ELSE 'uncertain' END FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'calls', CASE l_returnflag WHEN 'A' THEN 'certain' WHEN 'N' THEN 'inferred' ELSE 'uncertain' END FROM lineitem
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, CASE WHEN l_linestatus = 'O' THEN 'reads' ELSE 'writes' END, 'certain' FROM lineitem
), entrypoints AS (
  SELECT 'customer:' || c_custkey AS node_id, 'api' AS kind,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'untrusted_external' WHEN 'MACHINERY' THEN 'semi_trusted_external' ELSE 'trusted_internal' END AS trust_level,
         CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'medium' ELSE 'low' END AS asset_value, c_mktsegment AS description FROM customer
)"""

TRADE = r"""
tnodes AS (SELECT 'nation:' || n_nationkey AS id, (n_nationkey % 7)::INT AS cc, n_nationkey::BIGINT AS node_seq FROM nation),
trade AS (
  SELECT DISTINCT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'
), tags AS (
  SELECT 'nation:' || n_nationkey AS node_id, ['untrusted_external', 'semi_trusted_external', 'trusted_internal'][n_regionkey % 3 + 1] AS trust_level FROM nation WHERE n_nationkey % 4 = 0
), reach AS (
  SELECT src AS root, dst AS node FROM trade UNION SELECT reach.root, t.dst FROM reach JOIN trade t ON t.src = reach.node
), allpairs AS (SELECT * FROM reach WHERE root <> node)"""

FLOWS = r"""
flows AS (
  SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL
)"""

LINKS = r"""
links AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)"""

SPACE = r"""
space AS (SELECT doc_id, (sum(n_chars) OVER (ORDER BY doc_id) - n_chars)::BIGINT AS "start", (sum(n_chars) OVER (ORDER BY doc_id))::BIGINT AS "end" FROM documents)"""

ESCAPE = r"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({0}, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g'), '[\s\x{{85}}\x{{a0}}]+', '_', 'g'), '[^A-Za-z0-9_.:@$-]+', '_', 'g'), ''), 'unknown')"


PROGRAM = r"""
units AS (
  SELECT 'part:' || p_partkey AS id, p_name AS name, p_partkey % 3 AS speech FROM part
), suppliers AS (
  SELECT 'supplier:' || s_suppkey AS id, s_name AS name, s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'go' ELSE 'jvm' END AS family FROM supplier
), named AS (
  SELECT l_orderkey, l_suppkey, p_name, CASE l_orderkey % 3 WHEN 0 THEN 'go' ELSE 'jvm' END AS family FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes)


def _neighbours(key: str, kind: str, near: str, far: str, columns: str) -> str:
    return f"{_with(GRAPH)} SELECT {columns} FROM nodes WHERE id IN (SELECT {far} FROM edges WHERE kind = '{kind}' AND {near} = '{key}')"


_ALL_UNITS = """units AS (SELECT l_suppkey AS file, l_orderkey || '/' || l_linenumber AS unit, l_partkey % 5000 AS s, l_partkey % 5000 + l_quantity::BIGINT AS e FROM lineitem),
  found AS (SELECT event_id, user_id % (SELECT count(*) FROM supplier) AS file, event_id % 5000 AS place FROM events)"""
_WALK = """walk AS (
  SELECT src, dst, [src, dst] AS path FROM {0} WHERE src <> dst {1}
  UNION ALL SELECT walk.src, t.dst, list_append(walk.path, t.dst) FROM walk JOIN {0} t ON t.src = walk.dst
  WHERE NOT list_contains(walk.path, t.dst) AND len(walk.path) <= {2}
)"""

ORACLES: dict[str, str] = {
    "g_summary": _with(GRAPH) + """ SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM nodes WHERE kind IN ('function', 'method')) AS functions,
        (SELECT count(*) FROM nodes WHERE kind = 'class') AS classes, (SELECT count(*) FROM nodes WHERE kind = 'proxy') AS proxies,
        (SELECT count(*) FROM edges WHERE kind = 'calls') AS call_edges, (SELECT count(*) FROM entrypoints) AS entrypoints""",
    "g_kind_counts": _with(GRAPH) + " SELECT 'node' AS element, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind",
    "g_callees": _neighbours("customer:1", "calls", "src", "dst", "id, name, cc"),
    "g_callers": _neighbours("part:1", "calls", "dst", "src", "id, name, cc"),
    "g_degrees": _with(GRAPH) + """, p AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls' AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
        SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM p UNION ALL SELECT dst, 0, 1 FROM p) GROUP BY id""",
    "g_state_read_by": _neighbours("order:2", "reads", "src", "dst", "id, name"),
    "g_state_written_by": _neighbours("order:3", "writes", "src", "dst", "id, name"),
    "g_readers_of": _neighbours("part:2", "reads", "dst", "src", "id"),
    "g_writers_of": _neighbours("part:1", "writes", "dst", "src", "id"),
    "g_kind_projection": _with(GRAPH) + " SELECT DISTINCT src, dst FROM edges WHERE kind IN ('reads', 'contains') AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)",
    "g_weakest_confidence": _with(GRAPH) + """ SELECT src, dst, kind, ['certain', 'inferred', 'uncertain'][max(CASE confidence WHEN 'certain' THEN 1 WHEN 'inferred' THEN 2 ELSE 3 END)] AS confidence
        FROM edges WHERE kind = 'calls' GROUP BY src, dst, kind""",
    "g_lookup_batch": _with(GRAPH) + """, refs AS (SELECT n_name AS ref FROM nation UNION SELECT s_suppkey::VARCHAR FROM supplier UNION SELECT 'customer:' || c_custkey FROM customer),
        keyed AS (SELECT id, node_seq, id AS ref, -1 AS rank FROM nodes UNION ALL SELECT id, node_seq, name, 0 FROM nodes UNION ALL SELECT id, node_seq, split_part(id, ':', 2), 1 FROM nodes)
        SELECT ref, arg_min(id, (rank <> -1, rank, node_seq)) AS node_id FROM refs JOIN keyed USING (ref) GROUP BY ref""",
    "g_lookup_one": _with(GRAPH) + """ SELECT id, name, kind FROM nodes WHERE name = '7' OR id LIKE '%:7' ORDER BY CASE WHEN name = '7' THEN 0 ELSE 1 END, node_seq LIMIT 1""",
    "g_reachable_trade": _with(TRADE, recursive=True) + " SELECT node FROM allpairs WHERE root = 'nation:0'",
    "g_ancestors_trade": _with(TRADE, recursive=True) + " SELECT root AS node FROM allpairs WHERE node = 'nation:0'",
    "g_reachable_calls": _with(GRAPH, recursive=True) + """, r AS (SELECT dst AS node FROM edges WHERE kind = 'calls' AND src = 'customer:1' UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node AND e.kind = 'calls')
        SELECT node FROM r WHERE node <> 'customer:1'""",
    "g_reachable_events": _with(FLOWS, recursive=True) + """, r AS (SELECT src AS root, dst AS node FROM flows UNION SELECT r.root, f.dst FROM r JOIN flows f ON f.src = r.node)
        SELECT root, node FROM r WHERE root <> node""",
    "g_paths_trade_d3": _with(TRADE, _WALK.format("trade", "AND src = 'nation:0'", 3), recursive=True) + " SELECT array_to_string(path, '>') AS path FROM walk WHERE dst = 'nation:5'",
    "g_paths_events_d4": _with(FLOWS, _WALK.format("flows", "", 4), recursive=True) + " SELECT src, dst, array_to_string(path, '>') AS path FROM walk",
    # Three steps back from the supplier: an order of a customer calls a part, which calls the supplier.
    "g_entrypoint_paths": _with("""last AS MATERIALIZED (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1)""", """middle AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM last))""") + """
        SELECT 'customer:' || o_custkey || '>order:' || l_orderkey || '>part:' || l_partkey || '>supplier:1' AS path FROM middle JOIN orders ON o_orderkey = l_orderkey""",
    "g_connect_subgraphs": _with(TRADE, _WALK.format("trade", "", 2), recursive=True) + """, l AS (SELECT id FROM tnodes WHERE node_seq % 5 IN (0, 1)), r AS (SELECT id FROM tnodes WHERE node_seq % 5 = 1)
        SELECT DISTINCT array_to_string(path, '>') AS path FROM walk WHERE src IN (SELECT id FROM l) AND dst IN (SELECT id FROM r) UNION SELECT id FROM l WHERE id IN (SELECT id FROM r)""",
    "g_bfs_ball": _with(TRADE, recursive=True) + """, both_ways AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade),
        one AS (SELECT dst AS node FROM both_ways WHERE src = 'nation:3'), two AS (SELECT dst AS node FROM both_ways WHERE src IN (SELECT node FROM one))
        SELECT node, min(hops)::INT AS hops FROM (SELECT 'nation:3' AS node, 0 AS hops UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node""",
    "g_blast_radius_trade": _with(TRADE, recursive=True) + " SELECT id AS node, (SELECT count(*) FROM allpairs WHERE root = id) AS downstream, (SELECT count(*) FROM allpairs WHERE node = id) AS upstream FROM tnodes",
    "g_top_critical": _with(TRADE, recursive=True) + """ SELECT root, node, cc, place::INT AS place FROM (SELECT root, node, cc, row_number() OVER (PARTITION BY root ORDER BY cc DESC, node DESC) AS place
        FROM allpairs JOIN tnodes ON id = node WHERE cc > 0) WHERE place <= 5""",
    "g_entrypoint_reach": _with(GRAPH, recursive=True) + """, calls AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'),
        r AS (SELECT trust_level AS label, node_id AS node FROM entrypoints UNION SELECT r.label, c.dst FROM r JOIN calls c ON c.src = r.node) SELECT label, count(*) AS n FROM r GROUP BY label""",
    "g_privilege_boundary": _with(TRADE, recursive=True) + """, r AS (SELECT trust_level AS label, node_id AS node FROM tags UNION SELECT t.trust_level, p.node FROM tags t JOIN reach p ON p.root = t.node_id),
        s AS (SELECT node, string_agg(label, '+' ORDER BY label) AS trust FROM r GROUP BY node),
        raw AS (SELECT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
                WHERE l_quantity >= 50 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01')
        SELECT src, dst, a.trust AS src_trust, b.trust AS dst_trust, count(*) AS n FROM raw JOIN s a ON a.node = src JOIN s b ON b.node = dst WHERE a.trust <> b.trust GROUP BY ALL""",
    "g_taint": _with(TRADE, recursive=True) + """, r AS (SELECT node_id AS root, node_id AS node FROM tags WHERE trust_level <> 'trusted_internal' UNION SELECT t.node_id, p.node FROM tags t JOIN reach p ON p.root = t.node_id WHERE trust_level <> 'trusted_internal')
        SELECT node, string_agg(root, ', ' ORDER BY root) AS via FROM r GROUP BY node""",
    "g_unresolved_links": _with(LINKS) + " SELECT dst, count(*) AS sites, count(DISTINCT src) AS sources FROM links WHERE dst NOT IN (SELECT url FROM pages) GROUP BY dst",
    "g_resolution_by_target": _with(GRAPH) + " SELECT dst, count(*) AS sites, count(DISTINCT src) AS sources, split_part(dst, ':', 2) AS name FROM edges WHERE kind = 'calls' AND dst LIKE 'supplier:%' GROUP BY dst",
    "g_proxy_materialise": _with(LINKS) + f""", named AS (SELECT DISTINCT dst AS symbol, 'proxy.unresolved:' || {ESCAPE.format('dst')} AS plain FROM links)
        SELECT symbol, CASE WHEN count(*) OVER (PARTITION BY plain) > 1 THEN plain || '__' || substr(sha256(symbol), 1, 16) ELSE plain END AS id FROM named""",
    "g_unique_match_link": """ SELECT p_partkey, CASE WHEN count(*) OVER w = 1 THEN 'part:' || p_partkey END AS node_id, CASE WHEN count(*) OVER w = 1 THEN 'inferred' ELSE 'uncertain' END AS confidence FROM part WINDOW w AS (PARTITION BY p_name)""",
    "g_tiered_match": """WITH hits AS (
          SELECT s_suppkey AS ref_id, 0 AS tier, n_name AS id FROM supplier JOIN nation ON 'r' || n_regionkey = 'r' || (s_suppkey % 40)
          UNION ALL SELECT s_suppkey, 1, n_name FROM supplier JOIN nation ON n_name IN (string_split(s_name, '#')[-1], 'NATION_' || (s_suppkey % 30))
        ), best AS (SELECT ref_id, tier, count(DISTINCT id) AS n, min(id) AS id, min(tier) OVER (PARTITION BY ref_id) AS low FROM hits GROUP BY ref_id, tier)
        SELECT ref_id, id AS node_id FROM best WHERE tier = low AND n = 1""",
    "g_complexity_hotspots": _with(GRAPH) + " SELECT id, cc FROM nodes WHERE cc >= 10",
    "g_complexity_bands": _with(GRAPH) + " SELECT kind, CASE WHEN cc > 10 THEN 'high' WHEN cc >= 5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM nodes WHERE cc IS NOT NULL GROUP BY ALL",
    "g_interval_stab": _with(SPACE) + """ SELECT event_id, doc_id FROM (SELECT event_id, event_id * 997 % (SELECT max("end") FROM space) AS p FROM events) JOIN space ON p >= "start" AND p < "end" """,
    "g_coalesce_spans": _with(SPACE) + """, placed AS (SELECT lang, "start", "end", max("end") OVER (PARTITION BY lang ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM space JOIN documents USING (doc_id)),
        islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM placed)
        SELECT lang, min("start") AS "start", max("end") AS "end", count(*) AS n FROM islands GROUP BY lang, k""",
    "g_diff_nodes": _with(GRAPH) + """, o AS (SELECT id, name, kind, cc, o_orderdate, o_orderpriority FROM nodes JOIN orders ON id = 'order:' || o_orderkey),
        a AS (SELECT * FROM o WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT id, name, kind, CASE WHEN o_orderpriority = '1-URGENT' THEN cc + 1 ELSE cc END AS cc FROM o WHERE o_orderdate >= TIMESTAMP '1996-01-01')
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'modified' END AS status, CASE WHEN a.cc <> b.cc THEN 'cc' ELSE '' END AS changed
        FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.cc <> b.cc""",
    "g_diff_edges": _with(GRAPH) + """, e AS (SELECT src, dst, kind, confidence, o_orderdate FROM edges JOIN orders ON src = 'order:' || o_orderkey WHERE kind = 'calls'),
        a AS (SELECT src, dst, kind, confidence FROM e WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT src, dst, kind, confidence FROM e WHERE o_orderdate >= TIMESTAMP '1996-01-01')
        SELECT *, 'added' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "g_diff_entrypoints": _with(GRAPH) + """ SELECT node_id, CASE WHEN description = 'AUTOMOBILE' THEN 'removed' ELSE 'modified' END AS status, CASE WHEN description = 'AUTOMOBILE' THEN '' ELSE 'asset_value' END AS changed
        FROM entrypoints WHERE description = 'AUTOMOBILE' OR asset_value = 'low'""",
    "g_subgraph_induced": _with(GRAPH) + """, m AS (SELECT id FROM nodes WHERE kind = 'function' AND cc >= 6)
        SELECT kind, confidence, count(*) AS n FROM edges WHERE kind IN ('calls', 'reads') AND src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m) GROUP BY ALL""",
    "g_entrypoint_rules": _with(GRAPH) + """ SELECT id AS node_id,
        CASE WHEN name LIKE '%7' THEN 'user_input' WHEN id LIKE 'supplier:%' THEN 'third_party' WHEN kind = 'class' THEN 'api' ELSE 'user_input' END AS kind,
        CASE WHEN name LIKE '%7' THEN 'untrusted_external' WHEN id LIKE 'supplier:%' THEN 'semi_trusted_external' WHEN kind = 'class' THEN 'untrusted_external' ELSE 'trusted_internal' END AS trust_level,
        CASE WHEN name LIKE '%7' THEN 'medium' WHEN id LIKE 'supplier:%' THEN 'medium' WHEN kind = 'class' THEN 'high' ELSE 'low' END AS asset_value
        FROM nodes WHERE name LIKE '%7' OR kind = 'class' OR (kind = 'function' AND cc >= 3)""",
    "g_annotations_findings": """SELECT 'order:' || l_orderkey AS id, count(*) AS n, string_agg(CASE WHEN l_returnflag = 'R' THEN 'finding' ELSE 'audit_note' END || ': line ' || l_linenumber, '; ' ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'finding' ELSE 'audit_note' END) AS listed
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45 GROUP BY l_orderkey""",
    "g_module_deps": _with(LINKS) + r""" SELECT regexp_extract(src, '^https?://([^/?#]*)', 1) AS src, CASE WHEN dst LIKE 'http%' THEN regexp_extract(dst, '^https?://([^/?#]*)', 1) ELSE regexp_extract(src, '^https?://([^/?#]*)', 1) END AS dst, count(*) AS n FROM links GROUP BY ALL""",
    "g_containment": _with(GRAPH) + " SELECT src, count(*) AS n, string_agg(DISTINCT dst, ',' ORDER BY dst) AS members FROM edges WHERE kind = 'contains' GROUP BY src",
    "g_inherit_closure": """SELECT 'supplier:' || s_suppkey AS root, 'nation:' || s_nationkey AS node, 1::BIGINT AS hops FROM supplier
        UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "g_nearest_owner": """SELECT 'nation:' || n_nationkey AS node, 'region:' || n_regionkey AS owner FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "g_attack_surface": _with(GRAPH) + " SELECT node_id, name, n.kind AS node_kind, e.kind AS kind, trust_level, asset_value FROM entrypoints e LEFT JOIN nodes n ON n.id = e.node_id",
    "g_merge_last_wins": "SELECT 'part:' || p_partkey AS id, (CASE WHEN p_size % 3 = 0 THEN p_size + 100 ELSE p_size END)::INT AS cc FROM part",
    "g_overload_ids": """WITH u AS (SELECT 'm:f' || l_partkey AS base, l_orderkey AS l, l_linenumber AS c, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS k FROM lineitem)
        SELECT CASE WHEN k = 1 THEN base ELSE base || '@' || l || '_' || c END AS id, count(*) AS n FROM u GROUP BY ALL""",
    "g_escaped_symbols": _with(LINKS) + f" SELECT {ESCAPE.format('dst')} AS symbol, count(*) AS n FROM links GROUP BY ALL",
    "g_binary_gaps": """WITH f AS (SELECT l_suppkey AS artifact, l_orderkey * 40 AS s, l_orderkey * 40 + l_quantity::BIGINT AS e FROM lineitem),
        w AS (SELECT artifact, s, coalesce(max(e) OVER (PARTITION BY artifact ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM f)
        SELECT artifact, reach AS "start", s AS "end" FROM w WHERE s > reach""",
    "g_binary_calls_whole": """WITH f AS (SELECT l_suppkey AS artifact, l_orderkey || '/' || l_linenumber AS id, l_orderkey * 40 AS s, l_orderkey * 40 + l_quantity::BIGINT AS e FROM lineitem),
        z AS (SELECT (SELECT count(*) FROM supplier) AS files, (SELECT max(e) FROM f) AS space),
        i AS (SELECT user_id % files AS artifact, event_id * 7919 % space AS address, arg_min(event_id * 104729 % space, event_id) AS target, arg_min(CASE WHEN event_type = 'click' THEN 'direct' ELSE 'tail' END, event_id) AS how FROM events, z GROUP BY ALL),
        o AS (SELECT i.artifact, address, count(DISTINCT id) AS n, min(id) AS only FROM i JOIN f ON f.artifact = i.artifact AND target >= s AND target < e GROUP BY ALL),
        c AS (SELECT i.artifact, i.address, i.how, id FROM i JOIN f ON f.artifact = i.artifact AND i.address >= s AND i.address < e)
        SELECT artifact, count(*) AS n, count(CASE WHEN o.n = 1 THEN 1 END) AS resolved, count(DISTINCT id) AS callers FROM c LEFT JOIN o USING (artifact, address) GROUP BY artifact""",
    "g_binary_calls": """WITH f AS (SELECT l_suppkey AS artifact, l_orderkey || '/' || l_linenumber AS id, l_orderkey * 40 AS s, l_orderkey * 40 + l_quantity::BIGINT AS e FROM lineitem),
        z AS (SELECT (SELECT count(*) FROM supplier) AS files, (SELECT max(e) FROM f) AS space),
        i AS (SELECT user_id % files AS artifact, event_id * 7919 % space AS address, arg_min(event_id * 104729 % space, event_id) AS target, arg_min(CASE WHEN event_type = 'click' THEN 'direct' ELSE 'tail' END, event_id) AS how FROM events, z GROUP BY ALL),
        o AS (SELECT i.artifact, address, count(DISTINCT id) AS n, min(id) AS only FROM i JOIN f ON f.artifact = i.artifact AND target >= s AND target < e GROUP BY ALL),
        c AS (SELECT i.artifact, i.address, i.how, id FROM i JOIN f ON f.artifact = i.artifact AND i.address >= s AND i.address < e)
        SELECT c.artifact, c.address, c.id AS src, CASE WHEN o.n = 1 THEN o.only END AS dst, CASE WHEN o.n IS DISTINCT FROM 1 THEN 'uncertain' WHEN c.how = 'direct' THEN 'certain' ELSE 'inferred' END AS confidence FROM c LEFT JOIN o USING (artifact, address)""",
    "g_mapped_spans": """WITH r AS (SELECT DISTINCT l_suppkey AS artifact, (l_partkey % 3)::INT AS line, k * 4 AS s FROM (SELECT l_suppkey, l_partkey, l_linenumber, min(l_orderkey) AS k FROM lineitem GROUP BY ALL)),
        g AS (SELECT *, s - 4 * row_number() OVER (PARTITION BY artifact, line ORDER BY s) AS island FROM r)
        SELECT artifact, line, min(s) AS "start", max(s) + 4 AS "end" FROM g GROUP BY artifact, line, island""",
    "g_interval_overlap_whole": "WITH " + _ALL_UNITS + " SELECT event_id, count(*) AS n FROM found JOIN units USING (file) WHERE place <= e AND place + 3 >= s GROUP BY event_id",
    "g_tightest_owner": "WITH " + _ALL_UNITS + " SELECT event_id, arg_min(unit, (e - s, unit)) AS unit FROM found JOIN units USING (file) WHERE place >= s AND place <= e GROUP BY event_id",
    "g_interval_overlap": "WITH " + _ALL_UNITS.replace("|| '/' || l_linenumber AS unit", "AS key, l_linenumber AS line") + " SELECT event_id, key, line FROM found JOIN units USING (file) WHERE place <= e AND place + 3 >= s",
    "g_call_resolution": _with(LINKS) + """, open AS (SELECT * FROM links WHERE dst NOT IN (SELECT url FROM pages)), inside AS (SELECT l.* FROM links l WHERE src IN (SELECT url FROM pages))
        SELECT (SELECT count(*) FROM inside) AS call_sites, (SELECT count(*) FROM inside) - (SELECT count(*) FROM open) AS resolved, (SELECT count(*) FROM open) AS unresolved,
        (SELECT count(DISTINCT dst) FROM open) AS unresolved_targets, (SELECT count(DISTINCT src) FROM open) AS unresolved_callers""",
    "g_unresolved_by_callee": _with(LINKS) + """ SELECT trim(string_split(string_split(dst, '.')[-1], ':')[-1]) AS callee, count(*) AS sites, count(DISTINCT src) AS callers FROM links WHERE dst NOT IN (SELECT url FROM pages) GROUP BY callee""",
    "g_diff_fields": """SELECT 'modified' AS status, changed, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN o_orderstatus = 'O' THEN 'name' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'cc' END) AS changed FROM orders) WHERE changed <> '' GROUP BY changed""",
    "g_taint_whole": """SELECT 'supplier:' || l_suppkey AS node, count(DISTINCT o_custkey) AS n FROM (
          SELECT DISTINCT o.o_custkey, b.l_suppkey FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) o
          JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b USING (l_partkey)) GROUP BY l_suppkey""",
    "g_privilege_boundary_whole": _with(GRAPH, recursive=True) + """, calls AS MATERIALIZED (SELECT src, dst FROM edges WHERE kind = 'calls'), pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM calls),
        r AS (SELECT trust_level AS label, node_id AS node FROM entrypoints UNION SELECT r.label, p.dst FROM r JOIN pairs p ON p.src = r.node),
        t AS (SELECT node, string_agg(label, '+' ORDER BY label) AS trust FROM r GROUP BY node)
        SELECT src, dst, a.trust AS src_trust, b.trust AS dst_trust FROM calls JOIN t a ON a.node = src JOIN t b ON b.node = dst WHERE a.trust <> b.trust""",
    "g_bfs_ball_whole": """WITH last AS MATERIALIZED (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1)
        SELECT 'supplier:1' AS node, 0 AS hops UNION ALL SELECT 'part:' || l_partkey, 1 FROM last
        UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 2 FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM last)
        UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 2 FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM last) AND l_suppkey <> 1""",
    "g_cross_file_calls": _with(PROGRAM.replace("SELECT l_orderkey, l_suppkey, p_name", "SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_returnflag, p_name")) + """, hits AS (SELECT name, CASE speech WHEN 0 THEN 'go' ELSE 'jvm' END AS family, count(*) AS n, min(id) AS only_id FROM units GROUP BY ALL),
        calls AS (SELECT 'order:' || l_orderkey AS src, l_linenumber % 3 AS how, CASE WHEN l_returnflag = 'R' THEN 'uncertain' ELSE 'certain' END AS grade, p_name, l_partkey, h.n AS k, only_id
          FROM named LEFT JOIN hits h ON h.name = p_name AND h.family = named.family)
        SELECT src, CASE how WHEN 0 THEN 'part:' || l_partkey WHEN 2 THEN 'lib.' || p_name ELSE CASE WHEN k = 1 THEN only_id ELSE 'order:' || p_name END END AS dst,
        CASE WHEN how = 2 OR how = 1 AND k IS NULL THEN grade WHEN how = 1 AND k > 1 THEN 'uncertain' WHEN grade = 'uncertain' THEN grade ELSE 'inferred' END AS confidence, count(*) AS n FROM calls GROUP BY ALL""",
    "g_inherit_links": _with(PROGRAM) + """, wanted AS (SELECT id AS src, 'Supplier#' || lpad((s_suppkey + 3)::VARCHAR, 9, '0') AS base, family FROM suppliers)
        SELECT w.src, coalesce(min(CASE WHEN n.n = 1 THEN n.id END), any_value(w.base)) AS dst, 'inferred' AS confidence FROM wanted w
        LEFT JOIN (SELECT name, family, count(*) AS n, min(id) AS id FROM suppliers GROUP BY ALL) n ON n.name = w.base AND n.family = w.family GROUP BY w.src""",
    "g_type_uses": _with(PROGRAM) + """ SELECT DISTINCT 'order:' || l_orderkey AS src, n.id AS dst FROM named JOIN (SELECT name, family, min(id) AS id FROM suppliers GROUP BY ALL HAVING count(*) = 1) n
        ON n.name = 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') AND n.family = named.family""",
    "g_deferred_calls": """SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst FROM orders WHERE o_orderstatus <> 'F'""",
    "g_tail_calls": """WITH f AS (SELECT l_suppkey AS artifact, l_orderkey * 40 AS s, min(l_orderkey || '/' || l_linenumber) AS id, max(l_orderkey * 40 + l_quantity::BIGINT) AS e FROM lineitem GROUP BY ALL),
        j AS (SELECT user_id % (SELECT count(*) FROM supplier) AS artifact, event_id * 7919 % top * 40 AS address, event_id * 13 % top * 40 AS target FROM events, (SELECT max(o_orderkey) AS top FROM orders))
        SELECT j.artifact, address, a.id AS src, b.id AS dst FROM j JOIN f a ON a.artifact = j.artifact AND address >= a.s AND address < a.e JOIN f b ON b.artifact = j.artifact AND b.s = target AND b.s % 7 <> 0 WHERE a.id <> b.id""",
    "g_stub_links": """WITH n AS (SELECT p_name, count(*) AS n, min('part:' || p_partkey) AS one FROM part GROUP BY p_name)
        SELECT 'stub:' || p_partkey AS stub, CASE WHEN n = 1 AND p_size % 5 <> 0 THEN one END AS node_id, CASE WHEN n = 1 AND p_size % 5 <> 0 THEN 'inferred' ELSE 'uncertain' END AS confidence FROM part JOIN n USING (p_name)""",
    "g_shipped_rules": """WITH u AS (SELECT l_orderkey || '/' || l_linenumber AS node_id, l_quantity >= 49 AS main, l_partkey % 4 AS speech, l_returnflag, l_linestatus, l_suppkey % 2 = 0 AS exported FROM lineitem),
        r AS (SELECT *, CASE WHEN speech = 0 AND l_returnflag = 'A' THEN 'python-http' WHEN speech = 1 AND l_returnflag = 'R' THEN 'csharp-http' WHEN speech = 2 AND exported THEN 'erlang-export' WHEN speech = 3 AND l_linestatus = 'O' THEN 'zig-export' WHEN main THEN 'main' END AS rule FROM u)
        SELECT node_id, rule, CASE rule WHEN 'main' THEN 'user_input' WHEN 'erlang-export' THEN 'third_party' ELSE 'api' END AS kind,
        CASE rule WHEN 'main' THEN 'trusted_internal' WHEN 'erlang-export' THEN 'semi_trusted_external' ELSE 'untrusted_external' END AS trust_level,
        CASE rule WHEN 'main' THEN 'low' WHEN 'erlang-export' THEN 'medium' ELSE 'high' END AS asset_value FROM r WHERE rule IS NOT NULL""",
}

_IMPORTS = r"""
files AS (SELECT count(*) AS files FROM supplier),
imports AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'supplier:' || l_orderkey % files AS dst FROM lineitem, files WHERE l_quantity >= 47 AND l_linenumber = 1 AND l_returnflag <> 'N'),
sees AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'supplier:' || l_suppkey AS dst FROM lineitem UNION SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey FROM supplier
  UNION SELECT s.src, i.dst FROM sees s JOIN imports i ON i.src = s.dst)"""

ORACLES |= {
    "g_scope_lookup": """WITH said AS (
          SELECT 'customer:' || c_custkey AS scope, 's' || c_custkey % 40 AS name, 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 0
          UNION ALL SELECT 'nation:' || s_nationkey, 's' || s_suppkey % 40, 'supplier:' || s_suppkey FROM supplier
          UNION ALL SELECT 'region:' || n_regionkey, 's' || n_nationkey % 40, 'nation:' || n_nationkey FROM nation
        ), declared AS (SELECT scope, name, count(DISTINCT id) AS n, min(id) AS only_id FROM said GROUP BY scope, name),
        chain AS (SELECT o_orderkey, 's' || o_orderkey % 40 AS name, unnest(['customer:' || o_custkey, 'nation:' || c_nationkey, 'region:' || n_regionkey]) AS scope, unnest([1, 2, 3]) AS distance
          FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
        hit AS (SELECT o_orderkey, arg_min({'n': n, 'id': only_id}, distance) AS b, min(distance) AS distance FROM chain JOIN declared USING (scope, name) GROUP BY o_orderkey)
        SELECT o_orderkey AS ref_id, CASE WHEN b.n = 1 THEN b.id END AS node_id, b.n AS n, distance::BIGINT AS distance FROM hit""",
    "g_visible_calls": _with(_IMPORTS, recursive=True) + """, units AS (SELECT DISTINCT 'supplier:' || l_suppkey AS module, 'f' || l_partkey % 400 AS name, 'supplier:' || l_suppkey || '/f' || l_partkey % 400 AS id, l_partkey % 400 >= 20 AS internal FROM lineitem),
        refs AS (SELECT DISTINCT 'supplier:' || l_suppkey AS module, 'f' || l_orderkey * 7 % 400 AS name FROM lineitem)
        SELECT r.module || '>' || r.name AS ref_id, CASE WHEN count(DISTINCT u.id) = 1 THEN min(u.id) END AS node_id, count(DISTINCT u.id) AS n
        FROM refs r JOIN units u ON u.name = r.name WHERE NOT u.internal OR EXISTS (SELECT 1 FROM sees s WHERE s.src = r.module AND s.dst = u.module) GROUP BY r.module, r.name""",
    "g_module_sight": _with(_IMPORTS, recursive=True) + """ SELECT a.src AS module, (SELECT min(b.dst) FROM sees b JOIN sees c ON c.src = b.dst AND c.dst = a.src WHERE b.src = a.src) AS component, count(*)::BIGINT AS n FROM sees a GROUP BY a.src""",
    "g_export_tables": """WITH RECURSIVE files AS (SELECT count(*) AS files FROM supplier),
        declared AS (SELECT 'm' || p_partkey % files AS module, 'p' || p_partkey * 3 % 50 AS name, 'part:' || p_partkey AS id FROM part, files WHERE p_size > 44),
        aliases AS (SELECT DISTINCT 'm' || l_suppkey % files AS module, 'p' || l_partkey % 50 AS name, 'm' || l_orderkey % files AS tm, 'p' || l_orderkey * 11 % 50 AS tn FROM lineitem, files WHERE l_linenumber = 2 AND l_quantity >= 45),
        own AS (SELECT module, name, count(DISTINCT id) AS n, min(id) AS id FROM declared GROUP BY ALL),
        follow AS (SELECT module, name, min(tm) AS tm, min(tn) AS tn FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.module = a.module AND o.name = a.name) GROUP BY module, name HAVING count(*) = 1),
        named AS (SELECT module, name FROM own UNION SELECT module, name FROM aliases),
        stars AS (SELECT 'm' || s_suppkey % files AS module, 'm' || (s_suppkey * 7 + 1) % files AS tm FROM supplier, files WHERE s_suppkey % 3 <> 0 UNION SELECT 'm' || s_suppkey % files, 'm' || (s_suppkey * 5 + 2) % files FROM supplier, files WHERE s_suppkey % 4 = 0),
        names AS (SELECT DISTINCT 'p' || k AS name FROM range(50) t(k)),
        step AS MATERIALIZED (SELECT * FROM follow UNION ALL SELECT s.module, x.name, s.tm, x.name FROM stars s, names x WHERE NOT EXISTS (SELECT 1 FROM named k WHERE k.module = s.module AND k.name = x.name)),
        requests AS (SELECT DISTINCT 'm' || l_suppkey % files AS module, 'p' || l_partkey % 50 AS name FROM lineitem, files),
        walk AS (SELECT module, name, module AS am, name AS an FROM requests UNION SELECT w.module, w.name, s.tm, s.tn FROM walk w JOIN step s ON s.module = w.am AND s.name = w.an),
        ends AS (SELECT w.module, w.name, count(DISTINCT o.id) AS n, min(o.id) AS only_id FROM walk w JOIN own o ON o.module = w.am AND o.name = w.an AND o.n = 1 GROUP BY ALL)
        SELECT r.module, r.name, CASE WHEN n = 1 THEN only_id END AS node_id, coalesce(n, 0) AS n FROM requests r LEFT JOIN ends USING (module, name)""",
}

ORACLES |= {
    "g_nearest_declaration": """WITH RECURSIVE bases AS (SELECT DISTINCT 'customer:' || c_custkey AS src, 'customer:' || up AS dst FROM (SELECT c_custkey, unnest([c_custkey // 2, c_custkey // 3]) AS up FROM customer WHERE c_custkey > 3)),
        methods AS (SELECT 'customer:' || o_custkey AS type, 'n' || (o_orderkey // 4) % 5 AS name, o_orderpriority AS sig, 'order:' || o_orderkey AS id, o_orderstatus <> 'F' AS inheritable FROM orders WHERE o_orderkey % 4 = 0),
        asked AS (SELECT DISTINCT 'customer:' || o_custkey AS type, 'n' || o_orderkey % 5 AS name FROM orders WHERE o_orderkey % 3 = 0),
        passed AS (SELECT DISTINCT type, name, sig, id FROM methods WHERE inheritable
          UNION SELECT b.src, p.name, p.sig, p.id FROM passed p JOIN bases b ON b.dst = p.type WHERE NOT EXISTS (SELECT 1 FROM methods m WHERE m.inheritable AND m.type = b.src AND m.name = p.name AND m.sig = p.sig)),
        up AS (SELECT type AS root, type AS node FROM asked UNION SELECT up.root, b.dst FROM up JOIN bases b ON b.src = up.node),
        found AS (SELECT a.type, a.name, m.id, TRUE AS own FROM asked a JOIN methods m USING (type, name)
          UNION ALL SELECT DISTINCT a.type, a.name, p.id, FALSE FROM asked a JOIN bases b ON b.src = a.type JOIN passed p ON p.type = b.dst AND p.name = a.name
            WHERE NOT EXISTS (SELECT 1 FROM methods m WHERE m.type = a.type AND m.name = a.name AND m.sig = p.sig)),
        n AS (SELECT type, name, count(DISTINCT id) AS n, min(id) AS only_id, bool_and(own) AS own FROM found GROUP BY ALL),
        blocked AS (SELECT DISTINCT a.type, a.name FROM asked a JOIN up u ON u.root = a.type JOIN customer c ON u.node = 'customer:' || c_custkey AND c_custkey % 97 = 5 AND a.name = 'n' || c_custkey % 5),
        odd AS (SELECT DISTINCT root AS type FROM up WHERE node IN (SELECT dst FROM bases) AND node NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 89 <> 3)),
        graded AS (SELECT a.type, a.name, CASE WHEN b.type IS NOT NULL THEN 'state' WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'uncertain' END AS status, coalesce(n, 0) AS n, only_id, own
          FROM asked a LEFT JOIN n USING (type, name) LEFT JOIN blocked b ON b.type = a.type AND b.name = a.name)
        SELECT type, name, status, CASE WHEN status = 'resolved' THEN only_id END AS node_id, n, coalesce(status = 'resolved' AND own AND type NOT IN (SELECT type FROM odd), FALSE) AS own FROM graded WHERE status IS NOT NULL""",
    "g_mapping_overlay": """WITH s AS (SELECT l_suppkey AS artifact, (l_partkey * 13 + l_orderkey) % 50000 AS b, (l_partkey * 13 + l_orderkey) % 50000 + l_quantity::BIGINT * 3 AS e, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source FROM lineitem),
        points AS (SELECT artifact, b AS p FROM s WHERE e > b UNION SELECT artifact, e FROM s WHERE e > b), pieces AS (SELECT artifact, p AS "start", lead(p) OVER (PARTITION BY artifact ORDER BY p) AS "end" FROM points)
        SELECT p.artifact, "start", "end", min(source)::INT AS source FROM pieces p JOIN s ON s.artifact = p.artifact AND s.b <= p."start" AND s.e > p."start" WHERE "end" IS NOT NULL GROUP BY ALL""",
    "g_scan_spans": """WITH spans AS (SELECT l_suppkey AS artifact, l_orderkey * 100 AS b, l_orderkey * 100 + 40 + min(l_quantity::BIGINT) AS e, CASE WHEN l_orderkey % 7 = 0 THEN 'thumb' END AS own FROM lineitem GROUP BY l_suppkey, l_orderkey),
        marks AS (SELECT l_suppkey AS artifact, l_orderkey * 100 + l_partkey % 60 AS p, max(CASE l_returnflag WHEN 'R' THEN 'data' WHEN 'N' THEN 'thumb' ELSE 'arm' END) AS mode FROM lineitem GROUP BY ALL),
        cuts AS (SELECT artifact, b, e, own, b AS p FROM spans UNION SELECT s.artifact, b, e, own, m.p FROM spans s JOIN marks m ON m.artifact = s.artifact AND m.p > b AND m.p < e),
        pieces AS (SELECT artifact, b, own, p, coalesce(lead(p) OVER (PARTITION BY artifact, b ORDER BY p), e) AS q FROM cuts),
        moded AS (SELECT c.artifact, c.p AS "start", c.q AS "end", coalesce(c.own, (SELECT arg_max(m.mode, m.p) FROM marks m WHERE m.artifact = c.artifact AND m.p >= c.b AND m.p <= c.p), 'arm') AS mode FROM pieces c)
        SELECT * FROM moded WHERE mode <> 'data'""",
    "g_pc_relative": """WITH w AS (SELECT l_orderkey % 7 AS artifact, l_orderkey * 32 + l_linenumber * 4 AS address, l_linenumber % 2 = 1 AS odd, CASE WHEN l_quantity = 7 THEN 2 ELSE 4 END AS size, l_orderkey % 32 AS r,
            CASE WHEN l_suppkey % 9 = 0 AND l_orderkey % 7 % 2 = 0 THEN 3 ELSE l_orderkey % 32 END AS r2, l_partkey * 7919 % 1048576 AS wide, l_partkey * 31 % 4096 AS low FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
        p AS (SELECT *, lag(address) OVER o AS a1, lag(size) OVER o AS s1, lag(odd) OVER o AS o1, lag(r) OVER o AS r1, lag(wide) OVER o AS w1 FROM w WINDOW o AS (PARTITION BY artifact ORDER BY address)),
        sign AS (SELECT *, CASE WHEN w1 >= 524288 THEN w1 - 1048576 ELSE w1 END AS far, CASE WHEN low >= 2048 THEN low - 4096 ELSE low END AS near FROM p WHERE NOT odd AND o1 AND size = 4 AND s1 = 4 AND a1 + 4 = address AND r1 <> 0 AND r1 = r2)
        SELECT artifact, address, CASE WHEN artifact % 2 = 0 THEN (a1 + far * 4096 + near) // 2 * 2 - CASE WHEN (a1 + far * 4096 + near) < 0 AND (a1 + far * 4096 + near) % 2 <> 0 THEN 2 ELSE 0 END ELSE a1 + far * 262144 + near * 64 END AS target FROM sign""",
    "g_longest_prefix": r"""WITH t AS (SELECT regexp_extract(url, '^(https?://[^/]*)', 1) AS prefix, 'host' AS value FROM pages WHERE page_id % 17 = 0 UNION SELECT regexp_replace(url, '/[^/]*$', ''), 'v' || page_id % 3 FROM pages WHERE page_id % 3 = 0 UNION SELECT url, 'v' || page_id % 3 FROM pages WHERE page_id % 5 = 0),
        known AS (SELECT prefix, count(DISTINCT value) AS k, min(value) AS value FROM t GROUP BY prefix),
        paths AS (SELECT DISTINCT url || CASE WHEN dst LIKE '/%' THEN dst ELSE '/' || dst END AS path FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)),
        hit AS (SELECT path, arg_max({'p': prefix, 'v': value, 'k': k}, length(prefix)) AS b FROM paths JOIN known ON starts_with(path || '/', prefix || '/') GROUP BY path)
        SELECT path, b.p AS prefix, b.v AS value FROM hit WHERE b.k = 1""",
}

_DOWN = """sold AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A'), has AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'),
        pairs AS (SELECT DISTINCT 'part:' || p AS root, 'supplier:' || s AS node FROM sold
          UNION ALL SELECT DISTINCT 'order:' || o, 'part:' || p FROM has UNION ALL SELECT DISTINCT 'order:' || o, 'supplier:' || s FROM has JOIN sold USING (p)
          UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
          UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'part:' || p FROM has JOIN orders ON o_orderkey = o
          UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'supplier:' || s FROM has JOIN orders ON o_orderkey = o JOIN sold USING (p))"""

ORACLES |= {
    "g_blast_radius_whole": _with(GRAPH, _DOWN) + """ SELECT id AS node, coalesce(d.n, 0) AS downstream, coalesce(u.n, 0) AS upstream FROM nodes
        LEFT JOIN (SELECT root, count(*) AS n FROM pairs GROUP BY root) d ON d.root = id LEFT JOIN (SELECT node, count(*) AS n FROM pairs GROUP BY node) u ON u.node = id""",
    "g_top_critical_whole": _with(GRAPH, _DOWN) + """ SELECT root, node, cc, place::INT AS place FROM (SELECT root, node, cc, row_number() OVER (PARTITION BY root ORDER BY cc DESC, node DESC) AS place
        FROM pairs JOIN nodes ON id = node WHERE cc > 0 AND root LIKE 'customer:%') WHERE place <= 5""",
}

ORACLES |= {
    "g_value_flow": """WITH RECURSIVE defs AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (
          SELECT 'customer:' || o_custkey AS scope, o_orderkey AS pos, 'v' || o_orderkey % 4 AS name, CASE WHEN o_orderkey % 5 < 2 THEN 'callable' WHEN o_orderkey % 5 < 4 THEN 'name' ELSE 'other' END AS kind,
            CASE WHEN o_orderkey % 5 < 2 THEN 'part:' || o_orderkey % 7 ELSE 'v' || (o_orderkey * 3 + 1) % 4 END AS value, o_orderpriority <> '1-URGENT' AS always FROM orders WHERE o_orderkey % 4 <> 3
          UNION ALL SELECT 'nation:' || c_nationkey, c_custkey, 'v3', 'callable', 'part:' || c_custkey % 3, c_custkey % 2 = 0 FROM customer WHERE c_custkey % 29 = 0)),
        ups AS (SELECT 'customer:' || c_custkey AS scope, 'nation:' || c_nationkey AS up FROM customer),
        asks AS MATERIALIZED (SELECT 'u' || l_orderkey || '/' || l_linenumber AS use_id, 'customer:' || min(o_custkey) AS scope, min(o_orderkey) AS pos, 'v' || min(l_partkey % 4) AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, l_linenumber
          UNION ALL SELECT 'd' || id, scope, pos, value FROM defs WHERE kind = 'name'),
        kills AS MATERIALIZED (SELECT a.use_id, a.scope, a.pos, a.name, max(d.pos) AS kill FROM asks a LEFT JOIN defs d ON d.scope = a.scope AND d.name = a.name AND d.always AND d.pos < a.pos GROUP BY ALL),
        last AS (SELECT scope, name, max(pos) AS kill FROM defs WHERE always GROUP BY ALL),
        meets AS MATERIALIZED (SELECT k.use_id, d.id FROM kills k JOIN defs d ON d.scope = k.scope AND d.name = k.name AND d.pos < k.pos AND (k.kill IS NULL OR d.pos >= k.kill)
          UNION SELECT k.use_id, d.id FROM kills k JOIN ups USING (scope) JOIN defs d ON d.scope = ups.up AND d.name = k.name LEFT JOIN last l ON l.scope = d.scope AND l.name = d.name WHERE k.kill IS NULL AND (l.kill IS NULL OR d.pos >= l.kill)),
        walk AS (SELECT use_id, id FROM meets WHERE use_id LIKE 'u%' UNION SELECT w.use_id, m.id FROM walk w JOIN meets m ON m.use_id = 'd' || w.id)
        SELECT substr(use_id, 2) AS use_id, count(DISTINCT CASE WHEN kind = 'callable' THEN value END) AS n,
          CASE WHEN count(DISTINCT CASE WHEN kind = 'callable' THEN value END) = 1 AND NOT bool_or(kind = 'other' OR kind = 'name' AND 'd' || id NOT IN (SELECT use_id FROM meets)) THEN min(CASE WHEN kind = 'callable' THEN value END) END AS node_id,
          bool_or(kind = 'other' OR kind = 'name' AND 'd' || id NOT IN (SELECT use_id FROM meets)) AS unknown
        FROM walk JOIN defs USING (id) GROUP BY use_id""",
}

ORACLES |= {
    "g_formal_links": """WITH RECURSIVE f AS (SELECT count(*) AS k FROM supplier),
        sym AS MATERIALIZED (SELECT 'part:' || p_partkey AS id, 'supplier:' || p_partkey % k AS module, 's' || p_partkey * 7 % 300 AS name, p_size % 3 = 0 AS sig, p_size % 5 = 0 AS priv, p_size % 7 <> 0 AS run, p_size % 4 = 0 AS ghost FROM part, f),
        line AS MATERIALIZED (SELECT l_orderkey AS o, l_linenumber AS l, l_orderkey || '/' || l_linenumber AS ref_id, 'part:' || min(l_partkey) AS src, 'supplier:' || min(l_partkey) % any_value(k) AS module, min(l_suppkey) AS s, min(l_returnflag) AS flag, min(l_partkey) % 11 <> 0 AS app FROM lineitem, f GROUP BY l_orderkey, l_linenumber),
        imp AS (SELECT DISTINCT 'supplier:' || l_suppkey % k AS src, 'supplier:' || l_orderkey % k AS dst FROM lineitem, f WHERE l_quantity >= 49 AND l_linenumber = 1 AND l_returnflag <> 'N'),
        sees AS (SELECT DISTINCT module AS src, module AS dst FROM line UNION SELECT s.src, i.dst FROM sees s JOIN imp i ON i.src = s.dst),
        ask AS (SELECT DISTINCT * FROM (SELECT ref_id, module, 0 AS tier, 's' || o % 450 AS name FROM line UNION ALL SELECT ref_id, module, 0, 's' || s * 3 % 450 FROM line UNION ALL SELECT ref_id, module, 1, 's' || o * 7 % 300 FROM line)),
        cand AS MATERIALIZED (SELECT a.module, a.name, y.id, CASE WHEN y.module = a.module THEN y.sig::INT WHEN y.sig THEN 2 ELSE 3 END AS rank
          FROM (SELECT DISTINCT module, name FROM ask) a JOIN sym y USING (name) JOIN sees v ON v.src = a.module AND v.dst = y.module WHERE y.module = a.module OR NOT y.priv),
        hit AS (SELECT ref_id, tier, rank, count(DISTINCT id) AS n, min(id) AS id FROM ask JOIN cand USING (module, name) GROUP BY ref_id, tier, rank),
        best AS MATERIALIZED (SELECT ref_id, id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY tier, rank) AS r FROM hit) WHERE r = 1 AND n = 1),
        own AS MATERIALIZED (SELECT line.*, CASE WHEN b.id IS NULL OR NOT app THEN 1 WHEN NOT run THEN 0 WHEN ghost AND l % 2 = 1 THEN 0 ELSE 2 END AS holds FROM line LEFT JOIN best b USING (ref_id) LEFT JOIN sym ON sym.id = b.id),
        around AS (SELECT o, l, l - 1 AS pos, 2 AS holds, false AS nested FROM own UNION ALL SELECT a.o, a.l, a.pos - 1, least(a.holds, w.holds), true FROM around a JOIN own w ON w.o = a.o AND w.l = a.pos),
        chain AS MATERIALIZED (SELECT o, l, arg_min(holds, pos) AS holds, bool_or(nested) AS nested FROM around GROUP BY o, l),
        runtime AS (SELECT ref_id, CASE WHEN flag = 'A' THEN 2 WHEN flag = 'N' AND nested THEN c.holds ELSE 0 END AS r FROM own JOIN chain c USING (o, l) WHERE app)
        SELECT ref_id, src, b.id AS dst, 'references' AS kind, 'inferred' AS confidence FROM line JOIN best b USING (ref_id)
        UNION ALL SELECT ref_id, line.src, b.id, 'calls', CASE WHEN r = 2 THEN 'inferred' ELSE 'uncertain' END FROM line JOIN best b USING (ref_id) JOIN runtime USING (ref_id) JOIN sym x ON x.id = line.src AND x.run JOIN sym y ON y.id = b.id AND y.run WHERE r > 0
        UNION ALL SELECT NULL, g.id, t.id, 'corresponds_to', 'inferred' FROM sym g JOIN (SELECT name, min(id) AS id FROM sym WHERE NOT sig GROUP BY name HAVING count(*) = 1) t USING (name) WHERE g.sig""",
}
