"""SQL of the projected workspace, for the queries' twins."""

from __future__ import annotations

#: Common table expressions, each after those that it reads.
TABLES = {
    "geo": "SELECT n_nationkey, n_name, 'geo/' || r_name || '.mdx' AS path FROM nation JOIN region ON n_regionkey = r_regionkey",
    "nodes": """
      SELECT 'geo/' || r_name || '.mdx' AS identity, 'geo/' || r_name || '.mdx' AS path, CAST(NULL AS VARCHAR) AS id, TRUE AS is_root, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, CAST(-1 AS BIGINT) AS doc_ord, CAST(NULL AS VARCHAR) AS coverage, CAST(NULL AS VARCHAR[]) AS tags, r_name AS own_text FROM region
      UNION ALL SELECT path || '#n' || n_nationkey, path, 'n' || n_nationkey, FALSE, path, 1, CAST(n_nationkey AS BIGINT) * 1000000000, 'required', CAST([] AS VARCHAR[]), n_name FROM geo
      UNION ALL SELECT path || '#n' || n_nationkey || '.c' || c_custkey, path, 'n' || n_nationkey || '.c' || c_custkey, FALSE, path || '#n' || n_nationkey, 2, CAST(n_nationkey AS BIGINT) * 1000000000 + c_custkey + 1, 'required', [c_mktsegment], c_name FROM customer JOIN geo ON c_nationkey = n_nationkey
      UNION ALL SELECT DISTINCT 'parts/' || replace(p_brand, '#', '_') || '.mdx', 'parts/' || replace(p_brand, '#', '_') || '.mdx', NULL, TRUE, NULL, 0, -1, NULL, CAST(NULL AS VARCHAR[]), p_brand FROM part
      UNION ALL SELECT 'parts/' || replace(p_brand, '#', '_') || '.mdx#p' || p_partkey, 'parts/' || replace(p_brand, '#', '_') || '.mdx', 'p' || p_partkey, FALSE, 'parts/' || replace(p_brand, '#', '_') || '.mdx', 1, p_partkey + 1, CASE WHEN p_size % 7 = 0 THEN 'none' ELSE 'required' END, list_sort(list_distinct(string_split(p_type, ' '))), p_name FROM part
      UNION ALL SELECT 'sup.mdx', 'sup.mdx', NULL, TRUE, NULL, 0, -1, NULL, CAST(NULL AS VARCHAR[]), 'suppliers' FROM (SELECT 1 FROM supplier LIMIT 1)
      UNION ALL SELECT 'sup.mdx#s' || s_suppkey, 'sup.mdx', 's' || s_suppkey, FALSE, 'sup.mdx', 1, s_suppkey + 1, 'required', CAST([] AS VARCHAR[]), s_name FROM supplier""",
    "parts": "SELECT p_partkey, 'parts/' || replace(p_brand, '#', '_') || '.mdx#p' || p_partkey AS part FROM part",
    "people": "SELECT c_custkey, path || '#n' || n_nationkey || '.c' || c_custkey AS customer FROM customer JOIN geo ON c_nationkey = n_nationkey",
    "units": """
      SELECT *, 'orders/' || l_orderkey || '.ts' AS path, 'l' || l_linenumber || CASE WHEN n > 1 THEN '@' || n ELSE '' END AS unit,
        'orders/' || l_orderkey || '.ts#l' || l_linenumber || CASE WHEN n > 1 THEN '@' || n ELSE '' END AS identity
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem)""",
    "edges": """
      SELECT 'contains' AS kind, parent AS source, identity AS target FROM nodes WHERE parent IS NOT NULL
      UNION ALL SELECT DISTINCT 'depends', customer, part FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN people ON o_custkey = c_custkey JOIN parts ON l_partkey = p_partkey
      UNION ALL SELECT DISTINCT 'embeds', part, 'sup.mdx#s' || l_suppkey FROM lineitem JOIN parts ON l_partkey = p_partkey
      UNION ALL SELECT 'references', identity, part FROM units JOIN parts ON l_partkey = p_partkey
      UNION ALL SELECT 'embeds', identity, 'sup.mdx#s' || l_suppkey FROM units JOIN parts ON l_partkey = p_partkey""",
    "occurrences": """
      SELECT path AS file, CAST(l_linenumber * 1000 + n * 10 AS BIGINT) AS start, CAST(l_linenumber * 1000 + n * 10 + 9 AS BIGINT) AS "end", 'references' AS kind, identity AS source, part AS target
      FROM units JOIN parts ON l_partkey = p_partkey""",
    "anc": """
      SELECT identity, path AS ancestor, len(string_split(id, '.')) AS distance FROM nodes WHERE id IS NOT NULL
      UNION ALL SELECT identity, path || '#' || split_part(id, '.', 1), 1 FROM nodes WHERE id LIKE '%.%'""",
}
NEEDS = {"nodes": ["geo"], "people": ["geo"], "edges": ["nodes", "people", "parts", "units"], "occurrences": ["units", "parts"], "anc": ["nodes"]}


def twin(body: str, *tables: str, **more: str) -> str:
    """``WITH`` the named tables and what they need, and further ones, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in tables:
        need(name)
    parts = [f"{n} AS ({TABLES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
