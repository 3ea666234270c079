"""Queries over the projected workspace: traversal, coverage, policy, hashes, validation, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import globs, scalars
from weftgraph.operators import coverage as cover
from weftgraph.operators import availability, graph, hashes, mutations, policy, text, validation
from weftgraph.plans.twins import twin
from weftgraph.schema import checkpoint
from weftgraph.sources import tables
from weftgraph.sources.tables import project

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


NODE = ["identity", "path", "coverage", "tags"]


@query(twin("SELECT kind, source, target FROM edges WHERE kind IN ('depends', 'embeds') AND (source LIKE 'geo/%' OR source LIKE 'parts/%')", "edges"))
def edges_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.filter_edges(tables.references(spark, sf_dir, code=False), ["depends", "embeds"])
    return found.filter(F.startswith("source", F.lit("geo/")) | F.startswith("source", F.lit("parts/")))


@query(twin("SELECT kind, count(*) AS n FROM edges GROUP BY kind", "edges"))
def edge_set(spark, sf_dir):
    return graph.edge_set(project(spark, sf_dir).edges).groupBy("kind").agg(F.count("*").alias("n"))


@query(twin("SELECT identity, path, coverage, tags FROM nodes WHERE NOT is_root AND list_contains(tags, 'BUILDING')", "nodes"))
def nodes_by_tag(spark, sf_dir):
    return graph.filter_nodes(tables.nodes(spark, sf_dir), tag="BUILDING").select(NODE)


@query(twin("SELECT identity, path, coverage, tags FROM nodes WHERE coverage = 'none'", "nodes"))
def nodes_by_coverage(spark, sf_dir):
    return graph.filter_nodes(tables.nodes(spark, sf_dir), coverage="none").select(NODE)


@query(twin("SELECT identity, path, coverage, tags FROM nodes WHERE regexp_matches(path, '^parts/Brand_1[^/]*\\.mdx$')", "nodes"))
def nodes_by_glob(spark, sf_dir):
    return graph.filter_nodes(tables.nodes(spark, sf_dir), file="parts/Brand_1*.mdx").select(NODE)


@query(twin("SELECT CASE WHEN path LIKE 'geo/%' THEN 'geo' ELSE 'items' END AS grp, count(*) AS n FROM nodes GROUP BY 1", "nodes"))
def group_members(spark, sf_dir):
    groups = {"geo": ["geo/**"], "items": ["parts/*.mdx", "sup.mdx"]}
    own = F.array_compact(F.array(*[F.when(globs.matches_any(F.col("path"), g), F.lit(k)) for k, g in groups.items()]))
    return tables.nodes(spark, sf_dir).select(F.explode(own).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))


REPORT = "sup.mdx#s1"


@query(twin(f"""
SELECT n.identity, n.coverage, (SELECT count(*) FROM edges WHERE target = '{REPORT}') AS n_in, (SELECT count(*) FROM edges WHERE source = '{REPORT}') AS n_out,
  (SELECT min(source) FROM edges WHERE target = '{REPORT}') AS first_in
FROM nodes n WHERE identity = '{REPORT}'""", "nodes", "edges"))  # fmt: skip
def node_report(spark, sf_dir):
    work = project(spark, sf_dir)
    found = graph.report(work.nodes, work.edges, REPORT)
    return found.select("identity", "coverage", F.size("incoming").cast("long").alias("n_in"), F.size("outgoing").cast("long").alias("n_out"), F.element_at("incoming", 1)["source"].alias("first_in"))


@query(twin("SELECT identity, doc_ord FROM nodes WHERE path = 'geo/ASIA.mdx' AND (id = 'n12' OR starts_with(id, 'n12.'))", "nodes"))
def subtree(spark, sf_dir):
    return graph.subtree(tables.nodes(spark, sf_dir), "geo/ASIA.mdx", "n12").select("identity", "doc_ord")


@query(twin("SELECT identity, ancestor, CAST(distance AS INT) AS distance FROM anc", "anc"))
def ancestors(spark, sf_dir):
    return graph.ancestors(tables.nodes(spark, sf_dir))


@query(twin("SELECT parent AS identity, count(*) AS n, list(identity ORDER BY doc_ord)[1] AS first_child, list(identity ORDER BY doc_ord DESC)[1] AS last_child FROM nodes WHERE parent IS NOT NULL GROUP BY parent", "nodes"))
def children_ordered(spark, sf_dir):
    kids = tables.nodes(spark, sf_dir).filter("parent IS NOT NULL").groupBy(F.col("parent").alias("identity"))
    return kids.agg(F.count("*").alias("n"), F.min_by("identity", "doc_ord").alias("first_child"), F.max_by("identity", "doc_ord").alias("last_child"))


@query(twin("SELECT path, list(id ORDER BY doc_ord) FILTER (id IS NOT NULL) AS ids FROM nodes GROUP BY path", "nodes"))
def ids_by_file(spark, sf_dir):
    own = tables.nodes(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("doc_ord", "id")))).alias("i"))
    return own.select("path", F.transform("i", lambda x: x["id"]).alias("ids"))


@query(twin("SELECT identity FROM nodes WHERE id IS NOT NULL AND identity NOT IN (SELECT target FROM edges WHERE kind <> 'contains')", "edges"))
def ids_unreferenced(spark, sf_dir):
    work = project(spark, sf_dir)
    return graph.unreferenced(work.nodes.filter("id IS NOT NULL"), work.edges).select("identity")


@query(twin("""
SELECT n.identity, arg_min(a.ancestor, a.distance) AS nearest FROM nodes n
LEFT JOIN (SELECT a.* FROM anc a JOIN nodes p ON a.ancestor = p.identity AND (p.is_root OR p.doc_ord % 3000000000 = 0)) a ON a.identity = n.identity
WHERE n.is_root OR n.depth = 2 OR n.doc_ord % 3000000000 = 0 GROUP BY n.identity""", "nodes", "anc"))  # fmt: skip
def ids_tree_parent(spark, sf_dir):
    own = tables.nodes(spark, sf_dir)
    listed = own.filter("is_root OR depth = 2 OR doc_ord % 3000000000 = 0")
    return graph.nearest_listed(own, listed)


@query(twin("SELECT file, start, \"end\", source, target FROM occurrences WHERE target LIKE 'parts/Brand_7.mdx#%'", "occurrences"))
def occurrences_to(spark, sf_dir):
    return tables.occurrences(spark, sf_dir).filter(globs.matches(scalars.identity_path(F.col("target")), "parts/Brand_7.mdx")).select("file", "start", "end", "source", "target")


@query(twin("SELECT file, count(*) AS n, min(start) AS first_start FROM occurrences GROUP BY file", "occurrences"))
def occurrences_by_file(spark, sf_dir):
    return tables.occurrences(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))


@query(twin("""
SELECT c_custkey AS custkey, count(*) AS n_occurrences, count(DISTINCT l_partkey) AS n_edges
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey"""))
def occurrence_vs_edge_counts(spark, sf_dir):
    line, order = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders")
    own = line.join(order, line["l_orderkey"] == order["o_orderkey"]).groupBy(F.col("o_custkey").alias("custkey"))
    return own.agg(F.count("*").alias("n_occurrences"), F.count_distinct("l_partkey").alias("n_edges"))


@query(twin("""
SELECT path, "offset", arg_max(identity, depth) AS identity FROM (
  SELECT n.path, p."offset", n.identity, n.depth FROM (SELECT path, (doc_ord % 999999937) * 2 + depth * 3 AS "offset" FROM nodes WHERE depth < 2 AND NOT is_root) p JOIN nodes n ON n.path = p.path
  WHERE n.depth < 2 AND p."offset" >= CASE WHEN n.is_root THEN 0 ELSE (n.doc_ord % 999999937) * 2 END AND p."offset" < CASE WHEN n.is_root THEN 10000000 ELSE (n.doc_ord % 999999937) * 2 + 2 END
) GROUP BY path, "offset\"""", "nodes"))  # fmt: skip
def at_offset(spark, sf_dir):
    own = tables.nodes(spark, sf_dir).filter("depth < 2")
    at = (F.col("doc_ord") % 999999937) * 2
    spans = own.select("path", "identity", "depth", F.when(F.col("is_root"), 0).otherwise(at).alias("start"), F.when(F.col("is_root"), 10000000).otherwise(at + 2).alias("end"))
    asked = own.filter("NOT is_root").select("path", (at + F.col("depth") * 3).alias("offset")).distinct()
    return text.innermost(spans, asked)


@query(twin("SELECT identity, path, unit FROM units WHERE n > 1", "units"))
def unit_suffix(spark, sf_dir):
    return tables.units(spark, sf_dir).filter("n > 1").select("identity", "path", "unit")


DEPENDENCY = "kind IN ('depends', 'embeds', 'references')"
REQUIREMENT_EDGES = "SELECT source, target FROM edges WHERE kind IN ('depends', 'embeds') AND source NOT LIKE 'orders/%'"
LEVELS = """
  SELECT source, p1[len(p1)] AS target, len(p1) - 1 AS hops, p1 AS path FROM (SELECT source, min([source, target]) AS p1 FROM re GROUP BY source, target)
  UNION ALL SELECT a.source, b.target, 2, min([a.source, a.target, b.target]) FROM re a JOIN re b ON a.target = b.source GROUP BY a.source, b.target"""
ASKED = "geo/%.c%"


@query(twin(f"""
SELECT a.source, a.target, min(l.hops) IS NOT NULL AS reachable, arg_min(l.path, l.hops) AS path FROM asked a LEFT JOIN l ON a.source = l.source AND a.target = l.target
GROUP BY a.source, a.target""", "edges", re=REQUIREMENT_EDGES + f" AND (source LIKE '{ASKED}' OR source LIKE 'parts/%')", l=LEVELS,
    asked="SELECT customer AS source, 'sup.mdx#s' || s_suppkey AS target FROM people JOIN customer USING (c_custkey) JOIN supplier ON s_nationkey = c_nationkey"))
def reachable_pairs(spark, sf_dir):
    """Every customer, and the suppliers of the customer's nation."""
    work = project(spark, sf_dir, code=False)
    home = tables.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    sources = tables.customer_identity(spark, sf_dir).join(home, "c_custkey").select(F.col("nation").alias("grp"), F.col("customer").alias("source"))
    targets = tables.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.concat(F.lit("sup.mdx#s"), F.col("s_suppkey").cast("string")).alias("target"))
    return graph.reachable_in_groups(work.edges.filter("kind IN ('depends', 'embeds')"), sources, targets)


@query(twin("""
SELECT identity, min(d) AS distance FROM (
  SELECT identity, 0 AS d FROM nodes WHERE path = 'geo/ASIA.mdx' AND depth = 2
  UNION ALL SELECT target, 1 FROM edges WHERE kind = 'depends' AND source LIKE 'geo/ASIA.mdx#%'
  UNION ALL SELECT target, 2 FROM edges WHERE kind = 'embeds' AND source IN (SELECT target FROM edges WHERE kind = 'depends' AND source LIKE 'geo/ASIA.mdx#%')
) GROUP BY identity""", "edges"))
def bfs_distance(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    return graph.bfs(work.edges.filter("kind IN ('depends', 'embeds')"), work.nodes.filter("path = 'geo/ASIA.mdx' AND depth = 2"))


WITNESS = """
  SELECT target AS identity, min([source, target]) AS path, 1 AS hops FROM edges WHERE kind = 'depends' AND source LIKE 'geo/%' GROUP BY target"""


@query(twin("""
SELECT identity, path FROM w
UNION ALL SELECT e.target, min(list_append(w.path, e.target)) FROM edges e JOIN w ON e.source = w.identity WHERE e.kind = 'embeds' GROUP BY e.target""", "edges", w=WITNESS))
def shortest_witness(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    return graph.witnesses(work.edges.filter("kind IN ('depends', 'embeds')"), work.nodes.filter("path LIKE 'geo/%' AND NOT is_root").select("identity"))


def _profile_sql(where: str) -> str:
    return twin(where, "edges", t="""
      SELECT n.*, [x FOR x IN [CASE WHEN is_root THEN 'root node' END, CASE WHEN coverage = 'none' THEN 'coverage="none"' END, CASE WHEN EXISTS (SELECT 1 FROM nodes c WHERE c.parent = n.identity) THEN 'non-leaf' END,
        CASE WHEN NOT coalesce(list_has_any(tags, ['LARGE', 'SMALL', 'PROMO']), FALSE) THEN 'lacking tags' END] IF x IS NOT NULL] AS reasons
      FROM nodes n WHERE path LIKE 'parts/%'""",
        direct="SELECT part AS identity, min([identity, part]) AS path FROM units JOIN parts ON l_partkey = p_partkey WHERE regexp_matches(units.path, '^orders/[^/]*7\\.ts$') GROUP BY part")


#: Parts count as covered by the orders whose number ends in 7.
PARTS = cover.Profile(target=("parts/*.mdx",), boundary=("orders/*7.ts",), mode="direct", target_tags=("LARGE", "SMALL", "PROMO"), edge_kinds=("references",))


@query(_profile_sql("SELECT identity FROM t WHERE len(reasons) = 0"))
def coverage_required(spark, sf_dir):
    return cover.judged(project(spark, sf_dir), PARTS).filter(F.size("reasons") == 0).select("identity")


@query(_profile_sql("SELECT identity, reasons FROM t WHERE len(reasons) > 0"))
def coverage_ignored(spark, sf_dir):
    return cover.judged(project(spark, sf_dir), PARTS).filter(F.size("reasons") > 0).select("identity", "reasons")


@query(_profile_sql("SELECT t.identity, d.path FROM t JOIN direct d ON t.identity = d.identity WHERE len(reasons) = 0"))
def coverage_direct(spark, sf_dir):
    return cover.coverage(project(spark, sf_dir), PARTS).filter("status = 'covered'").select("identity", "path")


@query(_profile_sql("SELECT t.identity FROM t LEFT JOIN direct d ON t.identity = d.identity WHERE len(reasons) = 0 AND d.path IS NULL"))
def coverage_uncovered(spark, sf_dir):
    return cover.coverage(project(spark, sf_dir), PARTS).filter("status = 'uncovered'").select("identity")


@query(_profile_sql("SELECT CASE WHEN len(reasons) > 0 THEN 'ignored' WHEN d.path IS NULL THEN 'uncovered' ELSE 'covered' END AS status, count(*) AS n FROM t LEFT JOIN direct d ON t.identity = d.identity GROUP BY 1"))
def coverage_counts(spark, sf_dir):
    return cover.coverage(project(spark, sf_dir), PARTS).groupBy("status").agg(F.count("*").alias("n"))


SUPPLIERS = cover.Profile(target=("sup.mdx",), boundary=("geo/*.mdx",), boundary_kind="spec", edge_kinds=("depends", "embeds"))


@query(twin("""
SELECT n.identity, CASE WHEN is_root THEN 'ignored' WHEN b.path IS NULL THEN 'uncovered' ELSE 'covered' END AS status, CASE WHEN NOT is_root THEN b.path END AS path,
  CASE WHEN is_root THEN ['root node', 'non-leaf'] ELSE CAST([] AS VARCHAR[]) END AS reasons
FROM nodes n LEFT JOIN (SELECT e.target AS identity, min(list_append(w.path, e.target)) AS path FROM edges e JOIN w ON e.source = w.identity WHERE e.kind = 'embeds' GROUP BY e.target) b ON n.identity = b.identity
WHERE n.path = 'sup.mdx'""", "edges", w=WITNESS))
def coverage_transitive(spark, sf_dir):
    return cover.coverage(project(spark, sf_dir, code=False), SUPPLIERS)


S, R = policy.Selector, policy.Rule


@query(twin("""
SELECT 'asia-no-brand-7' AS rule, kind, source, target FROM edges WHERE kind = 'depends' AND source LIKE 'geo/ASIA.mdx#%' AND target LIKE 'parts/Brand_7.mdx#%'
UNION ALL SELECT 'code-no-suppliers', kind, source, target FROM edges WHERE kind = 'embeds' AND regexp_matches(source, '^orders/[^/]1\\.ts#') AND target LIKE 'sup.mdx#%'""", "edges"))
def policy_forbidden(spark, sf_dir):
    rules = [R("asia-no-brand-7", "forbidden", S(group=("geo/ASIA.mdx",)), S(files=("parts/Brand_7.mdx",)), ("depends",)), R("code-no-suppliers", "forbidden", S(files=("orders/?1.ts",)), S(files=("sup.mdx",)))]
    return policy.violations(project(spark, sf_dir), rules)


@query(twin("""
SELECT 'africa-low-brands' AS rule, kind, source, target FROM edges WHERE kind = 'depends' AND source LIKE 'geo/AFRICA.mdx#%' AND NOT regexp_matches(target, '^parts/Brand_[^/]\\.mdx#')""", "edges"))
def policy_allowed_only(spark, sf_dir):
    return policy.violations(project(spark, sf_dir, code=False), [R("africa-low-brands", "allowedOnly", S(files=("geo/AFRICA.mdx",)), S(files=("parts/Brand_?.mdx",)), ("depends",))])


@query(twin("""
SELECT 'line-brand' AS rule, kind, source, target FROM (SELECT *, regexp_extract(source, '^orders/([^/]+)\\.ts#', 1) AS o, regexp_extract(target, '^parts/Brand_([^/]+)\\.mdx#', 1) AS b FROM edges WHERE kind = 'references')
WHERE o <> '' AND o = b""", "edges"))
def policy_captures(spark, sf_dir):
    return policy.violations(project(spark, sf_dir), [R("line-brand", "forbidden", S(files=("orders/$1.ts",)), S(files=("parts/Brand_$1.mdx",)), ("references",))])


@query(twin("""
SELECT 'builders-no-promo' AS rule, e.kind, e.source, e.target FROM edges e JOIN nodes s ON e.source = s.identity JOIN nodes t ON e.target = t.identity
WHERE e.kind = 'depends' AND list_contains(s.tags, 'BUILDING') AND list_contains(t.tags, 'PROMO')""", "edges"))
def policy_tags(spark, sf_dir):
    return policy.violations(project(spark, sf_dir, code=False), [R("builders-no-promo", "forbidden", S(tags=("BUILDING",)), S(tags=("PROMO",)))])


def _frame(x: str) -> str:
    return f"unhex(printf('%016x', strlen({x}))) || encode({x})"


def _frames(*xs: str) -> str:
    return " || ".join(map(_frame, xs))


PIECES = f"""
  SELECT identity, 0 AS c, CAST(0 AS BIGINT) AS place, '' AS name, own_text AS text, {_frames("'run'", "own_text")} AS part FROM nodes
  UNION ALL SELECT source, 1, 0, target, '/', {_frames("'embed'", "target", "'0'", "'run'", "'/'")} FROM edges WHERE kind = 'embeds' AND source NOT LIKE 'orders/%'
  UNION ALL SELECT parent, 2, doc_ord, identity, coalesce(tags[1], ''), {_frames("'child'", "identity", "'0'", "'run'", "coalesce(tags[1], '')")} FROM nodes WHERE parent IS NOT NULL"""
OWN = f"""
  SELECT n.identity, n.parent, n.doc_ord, n.path, n.tags, n.coverage, p.own_hash FROM nodes n JOIN (
    SELECT identity, sha256(unhex(hex({_frame("'own'")}) || string_agg(hex(part), '' ORDER BY c, place, name))) AS own_hash FROM pieces GROUP BY identity
  ) p ON p.identity = n.identity"""


def _content(spark, sf_dir) -> tuple:
    """The projected documents' workspace, and their content."""
    work = project(spark, sf_dir, code=False)
    nodes, edges = checkpoint(work.nodes), checkpoint(work.edges)
    return nodes, edges, tables.parts(nodes, edges)


@query(twin("SELECT identity, own_hash FROM own", "edges", pieces=PIECES, own=OWN))
def own_hash(spark, sf_dir):
    """Of documents' nodes; code has no hash."""
    nodes, _, parts = _content(spark, sf_dir)
    return hashes.own_hash(nodes, parts)


@query(twin("SELECT identity, count(*) AS n_parts, sha256(string_agg(text, '|' ORDER BY c, place, name)) AS runs FROM pieces GROUP BY identity", "edges", pieces=PIECES))
def own_content(spark, sf_dir):
    found = hashes.own_content(_content(spark, sf_dir)[2])
    runs = F.transform(F.filter("content", lambda x: x["kind"] == "run"), lambda x: x["text"])
    return found.select("identity", F.size(F.filter("content", lambda x: x["kind"] == "run")).cast("long").alias("n_parts"), F.sha2(F.array_join(runs, "|"), 256).alias("runs"))


def _level(prefix: str, below: str) -> str:
    return f"SELECT o.identity, o.parent, o.doc_ord, sha256(unhex(hex({_frames(repr(prefix), 'o.own_hash')}) || coalesce(string_agg(hex({_frame('c.h')}), '' ORDER BY c.doc_ord), ''))) AS h FROM own o LEFT JOIN {below} c ON c.parent = o.identity GROUP BY o.identity, o.parent, o.doc_ord, o.own_hash"


NO_BELOW = "(SELECT '' AS parent, '' AS h, 0 AS doc_ord WHERE FALSE)"


@query(twin("SELECT identity, h AS subtree_hash FROM l2", "edges", pieces=PIECES, own=OWN, l0=_level("subtree", NO_BELOW), l1=_level("subtree", "l0"), l2=_level("subtree", "l1")))
def subtree_hash(spark, sf_dir):
    nodes, _, parts = _content(spark, sf_dir)
    return hashes.subtree_hash(nodes, parts)


def _effective(below: str) -> str:
    kids = f"SELECT parent AS identity, string_agg(hex({_frame('h')}), '' ORDER BY doc_ord) AS k FROM {below} WHERE parent IS NOT NULL GROUP BY parent"
    pairs = f"SELECT d.source AS identity, string_agg(hex({_frames('d.target', chr(39) + '0' + chr(39), 'b.h')}), '' ORDER BY d.target) AS p FROM deps d JOIN {below} b ON d.target = b.identity GROUP BY d.source"
    digest = lambda c: f"sha256(unhex(coalesce({c}, '')))"
    return f"SELECT o.identity, o.parent, o.doc_ord, sha256({_frames(chr(39) + 'effective' + chr(39), 'o.own_hash', digest('k'), digest('p'))}) AS h FROM own o LEFT JOIN ({kids}) USING (identity) LEFT JOIN ({pairs}) USING (identity)"


@query(twin("SELECT identity, h AS effective_hash FROM e4", "edges", pieces=PIECES, own=OWN, deps="SELECT source, target FROM edges WHERE kind IN ('depends', 'embeds') AND source NOT LIKE 'orders/%'",
    e00="SELECT identity, parent, doc_ord, '' AS h FROM own", e0=_effective("e00"), e1=_effective("e0"), e2=_effective("e1"), e3=_effective("e2"), e4=_effective("e3")))
def effective_hash(spark, sf_dir):
    return hashes.effective_hash(*_content(spark, sf_dir))


META = f"""
  SELECT n.identity, sha256({_frames("'metadata'", "sha256(unhex(coalesce(t, '')))", "coalesce(coverage, '')", "sha256(unhex(coalesce(array_to_string([hex(" + _frame("x") + ") FOR x IN list_sort(tags)], ''), '')))")}) AS metadata_hash
  FROM nodes n LEFT JOIN (SELECT source AS identity, string_agg(hex({_frames("target", "'0'")}), '' ORDER BY target) AS t FROM edges WHERE kind = 'depends' GROUP BY source) USING (identity)"""


@query(twin(META, "edges"))
def metadata_hash(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    return hashes.metadata_hash(work.nodes, work.edges)


@query("SELECT CAST(0 AS BIGINT) AS n_cycles")
def cycles(spark, sf_dir):
    """The projected graph has layers, so there is none; tests hold graphs with cycles."""
    edges = project(spark, sf_dir, code=False).edges
    return graph.cycles(edges).agg(F.count("*").alias("n_cycles"))


@query("""
SELECT kind, count(*) AS n FROM (
  SELECT 'duplicate-id' AS kind, l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
) GROUP BY kind""")
def v_duplicate_id(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem")
    places = line.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("string").alias("id"), F.col("l_partkey").cast("string").alias("place"))
    return validation.duplicate_id(places).groupBy(F.col("code").alias("kind")).agg(F.count("*").alias("n"))


@query(twin("SELECT identity AS location FROM nodes WHERE doc_ord % 11 = 5 AND depth = 2", "nodes"))
def v_structural_id(spark, sf_dir):
    own = tables.nodes(spark, sf_dir)
    faulty = own.withColumn("id", F.when((F.col("doc_ord") % 11 == 5) & (F.col("depth") == 2), F.concat(F.lit("x"), "id")).otherwise(F.col("id")))
    return validation.structural_id(faulty).select(F.element_at("locations", 1).alias("location"))


@query("SELECT CAST(doc_id AS VARCHAR) AS location FROM documents WHERE regexp_matches(string_split(text, chr(10))[1], '[#\"''`{}<>,\\t\\x0b\\f\\r ]') OR regexp_matches(string_split(text, chr(10))[1], '[.]($|[.])') OR starts_with(string_split(text, chr(10))[1], '.') OR regexp_matches(string_split(text, chr(10))[1], '[\\x00-\\x1f\\x7f]') OR string_split(text, chr(10))[1] = ''")
def v_segment(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    named = docs.select(F.col("doc_id").cast("string").alias("identity"), F.lit(False).alias("is_root"), F.substring_index("text", "\n", 1).alias("id"))
    return validation.invalid_segment(named).select(F.element_at("locations", 1).alias("location"))


@query(twin("SELECT CASE kind WHEN 'depends' THEN 'unknown-dependency' WHEN 'embeds' THEN 'unknown-text-target' ELSE 'unknown-ts-reference' END AS code, source, target || '~' AS target FROM edges WHERE kind <> 'contains' AND target LIKE '%3'", "edges"))
def v_unknown_dependency(spark, sf_dir):
    refs = tables.references(spark, sf_dir)
    shifted = refs.withColumn("target", F.when(F.endswith("target", F.lit("3")), F.concat("target", F.lit("~"))).otherwise(F.col("target")))
    found = validation.unknown_targets(shifted, tables.nodes(spark, sf_dir))
    return found.select("code", F.col("locations")[0].alias("source"), F.col("locations")[1].alias("target"))


@query("SELECT DISTINCT 'parts/' || p_brand || '.mdx' AS location FROM part WHERE contains(p_brand, '#')")
def v_invalid_path(spark, sf_dir):
    paths = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), "p_brand", F.lit(".mdx")).alias("path")).distinct()
    good = tables.nodes(spark, sf_dir).select("path").distinct()
    return validation.invalid_path(paths.unionByName(good)).select(F.element_at("locations", 1).alias("location"))


@query("""
SELECT DISTINCT 'out/' || o_orderkey || '.md' AS path FROM orders
WHERE o_orderkey % 17 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 30) AND o_custkey % 2 = 0""")
def orphan_paths(spark, sf_dir):
    order, line = tables.table(spark, sf_dir, "orders"), tables.table(spark, sf_dir, "lineitem")
    path = lambda c: F.concat(F.lit("out/"), F.col(c).cast("string"), F.lit(".md")).alias("path")
    old = order.filter("o_orderkey % 17 = 0").select(path("o_orderkey"))
    return validation.orphans(old, line.filter("l_quantity >= 30").select(path("l_orderkey")).distinct(), order.filter("o_custkey % 2 <> 0").select(path("o_orderkey")))


@query("""
SELECT path, CASE WHEN a IS NULL THEN 'missing' WHEN b IS NULL THEN 'orphan' ELSE 'differs' END AS state FROM (
  SELECT 'out/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 <> 0 THEN sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) END AS a, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS b FROM documents
) WHERE a IS DISTINCT FROM b""")
def stale_diff(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit(".md")))
    old = docs.filter("doc_id % 7 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return validation.stale(old, docs.filter("doc_id % 11 <> 0").select("path", F.sha2("text", 256).alias("hash")))


@query("SELECT 'out/' || s_suppkey AS location FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)")
def path_conflicts(spark, sf_dir):
    derived = tables.table(spark, sf_dir, "supplier").select(F.concat(F.lit("out/"), F.col("s_suppkey").cast("string")).alias("path"))
    sources = tables.table(spark, sf_dir, "customer").select(F.concat(F.lit("out/"), F.col("c_custkey").cast("string"), F.lit("/index.mdx")).alias("path"))
    return validation.path_conflicts(derived, sources).select(F.element_at("locations", 1).alias("location"))


@query("SELECT doc_id, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+$')) AS line FROM documents) GROUP BY doc_id")
def lines_split(spark, sf_dir):
    found = text.lines(tables.table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"))


@query("""
SELECT conv_id AS doc, coalesce(string_agg(line, '' ORDER BY turn), '') AS text FROM (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE text || chr(10) END AS line FROM conversations
) GROUP BY conv_id""")
def drop_rule(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "doc")
    kind = F.when(F.col("role") == "system", "removal").when(F.col("role") == "assistant", "embedding").otherwise("content")
    shown = turns.select("doc", (F.col("turn") * 2).alias("ord"), kind.alias("kind"), "text", F.when(F.col("role") == "assistant", F.col("text")).alias("expansion"))
    ends = turns.select("doc", (F.col("turn") * 2 + 1).alias("ord"), F.lit("content").alias("kind"), F.lit("\n").alias("text"), F.lit(None).cast("string").alias("expansion"))
    return text.compiled(shown.unionByName(ends))


@query(twin("SELECT n.identity, string_agg(d.own_text, chr(10) ORDER BY d.doc_ord) AS text FROM (SELECT identity, ancestor FROM anc UNION ALL SELECT identity, identity FROM nodes) a JOIN nodes d ON a.identity = d.identity JOIN nodes n ON n.identity = a.ancestor GROUP BY n.identity", "anc"))
def subtree_text(spark, sf_dir):
    return text.subtree_text(tables.nodes(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN replace(substring(text, 1, 1000) || '…', '*/', '*\\/') ELSE replace(text, '*/', '*\\/') END AS comment FROM documents")
def doc_comment(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", scalars.doc_comment(F.col("text")).alias("comment"))


@query("SELECT p_partkey, list_sort(list_distinct([x FOR x IN string_split_regex(p_type || ' ' || p_name, '[ \\t\\n]+') IF x <> ''])) AS tags FROM part")
def split_tags(spark, sf_dir):
    return tables.table(spark, sf_dir, "part").select("p_partkey", scalars.split_tags(F.concat("p_type", F.lit(" "), "p_name")).alias("tags"))


@query(twin("SELECT \"from\", \"to\" FROM (SELECT identity AS \"from\", path || '#' || CASE WHEN id = 'n12' THEN 'moved' ELSE 'moved' || substring(id, 4) END AS \"to\" FROM nodes WHERE path = 'geo/ASIA.mdx' AND (id = 'n12' OR starts_with(id, 'n12.')))", "nodes"))
def rename_mapping(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    return text.rename(work.nodes, work.edges, "geo/ASIA.mdx", "n12", "moved")[0]


@query(twin("SELECT kind, regexp_replace(source, '^geo/ASIA\\.mdx#n12(\\.|$)', 'geo/ASIA.mdx#moved\\1') AS source, regexp_replace(target, '^geo/ASIA\\.mdx#n12(\\.|$)', 'geo/ASIA.mdx#moved\\1') AS target FROM edges WHERE kind IN ('contains', 'depends')", "edges"))
def rename_edges(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    return text.rename(work.nodes, work.edges.filter("kind IN ('contains', 'depends')"), "geo/ASIA.mdx", "n12", "moved")[2]


@query(twin("SELECT identity, string_agg(text, '' ORDER BY c, place, name) AS text FROM pieces GROUP BY identity", "edges", pieces=PIECES))
def own_text(spark, sf_dir):
    return hashes.own_text(_content(spark, sf_dir)[2])


@query(twin("SELECT path, len(list(identity)) AS n, list(identity ORDER BY doc_ord, identity)[2] AS second FROM nodes GROUP BY path HAVING count(*) > 1", "nodes"))
def view(spark, sf_dir):
    shown = availability.view(project(spark, sf_dir)).filter(F.size("sections") > 1)
    return shown.select("path", F.size("sections").cast("long").alias("n"), F.element_at("sections", 2)["identity"].alias("second"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_linenumber AS VARCHAR) AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1")
def defined_identities(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem")
    return availability.defined(line.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("string").alias("id")))


@query(twin("SELECT DISTINCT 'parts/' || replace(p_brand, '#', '_') || '.mdx' AS path FROM part WHERE p_brand = 'Brand#7' UNION SELECT 'sup.mdx'"))
def expansion_files(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    edges = work.edges.filter("kind IN ('contains', 'embeds')")
    return availability.expansion_files(work.nodes, edges, ["parts/Brand_7.mdx"])


@query(twin("""
SELECT p AS identity FROM (SELECT source AS p FROM edges WHERE kind = 'embeds' AND target = 'sup.mdx#s3' AND source LIKE 'parts/%'
  UNION SELECT split_part(source, '#', 1) FROM edges WHERE kind = 'embeds' AND target = 'sup.mdx#s3' AND source LIKE 'parts/%' UNION SELECT 'sup.mdx#s3' UNION SELECT 'sup.mdx')""", "edges"))
def text_unavailable(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    edges = work.edges.filter("kind IN ('contains', 'embeds')")
    return availability.text_unavailable(work.nodes, edges, work.nodes.filter("identity = 'sup.mdx#s3'"))


@query("""
SELECT 'out/' || (doc_id + 5) || '.md' AS path, 'added' AS change FROM documents WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'out/' || doc_id || '.md', 'removed' FROM documents WHERE doc_id - 5 NOT IN (SELECT doc_id FROM documents)""")
def derived_delta(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    path = lambda c: docs.select(F.concat(F.lit("out/"), c.cast("string"), F.lit(".md")).alias("path"))
    return mutations.derived_delta(path(F.col("doc_id")), path(F.col("doc_id") + 5))


@query(twin("SELECT regexp_replace(path, '\\.mdx$', '') || s AS path, path AS source FROM (SELECT DISTINCT path FROM nodes) CROSS JOIN (VALUES ('.gen.js'), ('.gen.d.ts'), ('.gen.d.ts.map')) t(s)", "nodes"))
def derived_paths(spark, sf_dir):
    return availability.derived_paths(tables.nodes(spark, sf_dir).select("path").distinct())


@query(twin("SELECT identity AS \"from\", 'moved/all.mdx' || CASE WHEN id IS NULL THEN '' ELSE '#' || id END AS \"to\" FROM nodes WHERE path = 'sup.mdx'", "nodes"))
def move_file_mapping(spark, sf_dir):
    return mutations.file_mapping(tables.nodes(spark, sf_dir), "sup.mdx", "moved/all.mdx")


@query(twin("SELECT CASE WHEN path = 'geo/ASIA.mdx' AND (id = 'n12' OR starts_with(id, 'n12.')) THEN 'sup.mdx#far' || substring(id, 4) ELSE identity END AS identity, CASE WHEN path = 'geo/ASIA.mdx' AND id = 'n12' THEN 'sup.mdx' WHEN path = 'geo/ASIA.mdx' AND starts_with(id, 'n12.') THEN 'sup.mdx#far' ELSE parent END AS parent FROM nodes", "nodes"))
def move_section_nodes(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    return mutations.rewrite(work, mutations.section_mapping(work.nodes, "geo/ASIA.mdx", "n12", "sup.mdx", "far")).nodes.select("identity", "parent")


@query(twin("SELECT 'refused-id-collision' AS code, 'sup.mdx#s1' AS identity UNION ALL SELECT 'refused-id-collision', identity FROM nodes WHERE FALSE", "nodes"))
def refusals(spark, sf_dir):
    work = project(spark, sf_dir, code=False)
    mapping = mutations.section_mapping(work.nodes, "geo/ASIA.mdx", "n12", "sup.mdx", "s1")
    return mutations.refusals(work, mapping, "geo/ASIA.mdx", "n12", "sup.mdx", "s1")


@query("SELECT code, location, count(*) OVER () AS n FROM (SELECT DISTINCT 'invalid-source-path' AS code, 'parts/' || p_brand || '.mdx' AS location FROM part)")
def finding_set(spark, sf_dir):
    paths = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("parts/"), "p_brand", F.lit(".mdx")).alias("path"))
    found = validation.finding_set(validation.invalid_path(paths))
    return found.select("code", F.element_at("locations", 1).alias("location")).crossJoin(F.broadcast(found.agg(F.count("*").alias("n"))))
