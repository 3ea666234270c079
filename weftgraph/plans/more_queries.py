"""Queries over sessions, journals, cycles, reports, ranges and scalars of the projected workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import globs, scalars
from weftgraph.operators import availability, changes, graph, hashes, journal, mutations, review, sessions, text, validation
from weftgraph.operators import coverage as cover
from weftgraph.plans.graph_queries import SUPPLIERS, WITNESS
from weftgraph.plans.twins import twin
from weftgraph.plans.version_queries import K, VISITED, analysis, vsql
from weftgraph.schema import Workspace, checkpoint
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


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


# listings and ranges


@query(twin("""
SELECT path, coalesce(list(id ORDER BY doc_ord) FILTER (id IS NOT NULL AND identity NOT IN (SELECT target FROM edges WHERE kind <> 'contains')), CAST([] AS VARCHAR[])) AS ids FROM nodes GROUP BY path""", "edges"))
def ids_unreferenced_by_file(spark, sf_dir):
    """Files all of whose ids are referenced keep a row without any."""
    work = project(spark, sf_dir)
    return graph.ids(work.nodes, work.nodes.select("path"), work.edges)


@query(twin("""
SELECT o.file, o.start, o."end", o.target, coalesce(n.doc_ord, -1) AS from_start FROM occurrences o LEFT JOIN (SELECT identity, l_linenumber * 100 AS doc_ord FROM units WHERE l_linenumber < 4) n ON o.source = n.identity
WHERE regexp_matches(o.file, '^orders/[^/]*7\\.ts$')""", "occurrences"))
def occurrences_with_ranges(spark, sf_dir):
    unit = tables.units(spark, sf_dir).filter("l_linenumber < 4").select("identity", (F.col("l_linenumber") * 100).alias("start"), (F.col("l_linenumber") * 100 + 9).alias("end"))
    found = graph.occurrences(tables.occurrences(spark, sf_dir), unit, file="orders/*7.ts")
    return found.select("file", "start", "end", "target", F.coalesce("source_range.start", F.lit(-1)).alias("from_start"))


@query(twin("""
SELECT a.path, a."offset", u.identity, o.target FROM (SELECT path, CAST(l_linenumber * 1000 + n * 10 + 3 AS BIGINT) AS "offset", identity FROM units) a
JOIN units u ON u.identity = a.identity LEFT JOIN occurrences o ON o.file = a.path AND o.start <= a."offset" AND a."offset" < o."end" """, "occurrences"))
def at_occurrence(spark, sf_dir):
    """Each order line's place: the innermost unit there, and the reference."""
    unit = tables.units(spark, sf_dir)
    start = (F.col("l_linenumber") * 1000 + F.col("n") * 10).cast("long")
    spans = unit.select("path", "identity", start.alias("start"), (start + 10).alias("end"), F.lit(1).alias("depth"))
    spans = spans.unionByName(unit.select("path", F.col("path").alias("identity"), F.lit(0).cast("long").alias("start"), F.lit(1 << 40).alias("end"), F.lit(0).alias("depth")).distinct())
    found = text.at(spans, tables.occurrences(spark, sf_dir), unit.select("path", (start + 3).alias("offset")))
    return found.select("path", "offset", "identity", F.col("occurrence.target").alias("target"))


@query(twin("""
SELECT role, count(*) AS n FROM (SELECT DISTINCT path, 'spec' AS role FROM nodes UNION ALL SELECT DISTINCT 'orders/' || o_orderkey || '.ts', 'code' FROM orders
UNION ALL SELECT DISTINCT regexp_replace(path, '\\.mdx$', '') || s, 'derived' FROM nodes CROSS JOIN (VALUES ('.gen.js'), ('.gen.d.ts'), ('.gen.d.ts.map')) t(s)
UNION ALL SELECT DISTINCT regexp_replace(path, '\\.mdx$', '') || '.gen.js', 'recorded' FROM nodes WHERE path LIKE 'parts/%') GROUP BY role""", "nodes"))
def inventory_roles(spark, sf_dir):
    own = tables.nodes(spark, sf_dir).select("path").distinct()
    code = _t(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"))
    sources = own.select("path", F.lit("spec").alias("kind")).unionByName(code.select("path", F.lit("code").alias("kind")))
    derived = availability.derived_paths(own)
    recorded = derived.filter(F.startswith("path", F.lit("parts/")) & F.endswith("path", F.lit(".gen.js")))
    return availability.inventory(sources, derived, recorded).groupBy("role").agg(F.count("*").alias("n"))


@query(vsql("SELECT identity, CASE WHEN presence = 'deleted' THEN parent_before ELSE parent_now END AS parent FROM rec"))
def link_parent(spark, sf_dir):
    return review.link_parent(analysis(spark, sf_dir))


@query(vsql("SELECT DISTINCT s.identity FROM seen s", **VISITED))
def visited(spark, sf_dir):
    return review.visited(analysis(spark, sf_dir))


# gates and reports


@query(twin("""
SELECT 'suppliers' AS profile, count(*) FILTER (NOT is_root) AS required, count(*) FILTER (NOT is_root AND b.path IS NULL) AS uncovered, count(*) FILTER (is_root) AS ignored, count(*) FILTER (NOT is_root AND b.path IS NULL) = 0 AS passed
FROM nodes n LEFT JOIN (SELECT e.target AS identity, min(list_append(w.path, e.target)) AS path FROM edges e JOIN w ON e.source = w.identity WHERE e.kind = 'embeds' GROUP BY e.target) b ON n.identity = b.identity WHERE n.path = 'sup.mdx'""", "edges", w=WITNESS))
def coverage_check(spark, sf_dir):
    return cover.check(cover.coverage(project(spark, sf_dir, code=False), SUPPLIERS), "suppliers")


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def first_wins(spark, sf_dir):
    order = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return changes.first_wins(order, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(vsql("""SELECT section, category, count(*) AS n FROM (
  SELECT 'requirement' AS section, 'changed' AS category, identity FROM rec WHERE changed UNION ALL SELECT 'requirement', 'metadata-changed', identity FROM rec WHERE metadata_changed
  UNION ALL SELECT DISTINCT 'requirement', 'descendant-changed', identity FROM dc UNION ALL SELECT DISTINCT 'requirement', 'upstream-changed', identity FROM uc WHERE identity <> cause
  UNION ALL SELECT DISTINCT 'code', 'direct', source FROM ie WHERE target IN (SELECT identity FROM sub)
  UNION ALL SELECT DISTINCT 'code', 'transitive', source FROM ie WHERE target IN (SELECT identity FROM eff) AND target NOT IN (SELECT identity FROM sub)) GROUP BY section, category"""))
def impact_report(spark, sf_dir):
    """No two levels of the projection collapse, so every node has an entry of its own."""
    return changes.impact_report(analysis(spark, sf_dir, code=True)).groupBy("section", "category").agg(F.count("*").alias("n"))


# the journal


RENAMED = """SELECT identity AS was, CASE WHEN path = 'geo/ASIA.mdx' AND (id = 'n12' OR starts_with(id, 'n12.')) THEN 'geo/ASIA.mdx#moved' || substring(id, 4) ELSE identity END AS identity, path, id, depth FROM nodes"""


@query(twin(f"""
SELECT identity, 'changed' AS category FROM ren WHERE path = 'geo/ASIA.mdx' AND depth = 2 AND {K.format('was')} % 23 = 4
UNION ALL SELECT DISTINCT u.identity, 'descendant-changed' FROM ren r JOIN anc a ON a.identity = r.was JOIN ren u ON u.was = a.ancestor WHERE r.path = 'geo/ASIA.mdx' AND r.depth = 2 AND {K.format('r.was')} % 23 = 4""", "anc", ren=RENAMED))
def journaled_rename(spark, sf_dir):
    """A section and all below it are renamed, by a journaled entry, and some of its file's texts change: the rename itself is no change."""
    work = project(spark, sf_dir, code=False)
    nodes = checkpoint(work.nodes.filter("path = 'geo/ASIA.mdx'"))
    before = Workspace(nodes, work.locations, tables.contains(nodes), work.occurrences)
    mapping, renamed, edges = text.rename(before.nodes, before.edges, "geo/ASIA.mdx", "n12", "moved")
    edited = (F.col("depth") == 2) & (F.regexp_extract("identity", r"(\d+)$", 1).try_cast("long") % 23 == 4)
    now = Workspace(checkpoint(renamed.withColumn("own_text", F.when(edited, F.concat("own_text", F.lit("!"))).otherwise(F.col("own_text")))), work.locations, checkpoint(edges), work.occurrences)
    log = checkpoint(mapping.select(F.lit(0).alias("seq"), "from", "to"))
    found = changes.analyse(before, now, log, 0)
    return changes.named(found, changes.categories(found).select("identity", "category"), "identity")


@query("""
SELECT row_number() OVER (ORDER BY user_id) - 1 AS seq, 'rename' AS op, 'f.mdx#u' || user_id AS "from", 'f.mdx#v' || user_id AS "to", 2 AS n FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 = 0""")
def parse_journal(spark, sf_dir):
    """Of four users' lines one is good; the others have a space, a pair too few, and one of another root."""
    return journal.parse(_lines(spark, sf_dir))[0].select("seq", "op", "from", "to", F.size("mapping").alias("n"))


@query("""
SELECT 'journal-error' AS code, user_id AS line, CASE user_id % 4 WHEN 1 THEN 'is not in canonical form' WHEN 2 THEN 'does not map the operated-on identity' ELSE 'maps what the operation does not affect' END AS problem
FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 <> 0""")
def journal_findings(spark, sf_dir):
    return journal.parse(_lines(spark, sf_dir))[1]


def _lines(spark, sf_dir) -> DataFrame:
    users = _t(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id").cast("string")
    a, b = F.concat(F.lit("f.mdx#u"), u), F.concat(F.lit("f.mdx#v"), u)
    pair = lambda x, y: F.struct(x.alias("from"), y.alias("to"))
    root, kid, odd = pair(a, b), pair(F.concat(a, F.lit(".k")), F.concat(b, F.lit(".k"))), pair(F.concat(a, F.lit(".k")), F.concat(b, F.lit(".l")))
    mapping = F.when(F.col("user_id") % 4 == 2, F.array(kid)).when(F.col("user_id") % 4 == 3, F.array(root, odd)).otherwise(F.array(root, kid))
    line = journal.serialize(F.lit("rename"), a, b, mapping)
    return users.select(F.col("user_id").alias("line"), F.when(F.col("user_id") % 4 == 1, F.replace(line, F.lit(","), F.lit(", "))).otherwise(line).alias("text"))


@query("""
SELECT CAST(2 AS BIGINT) AS line, '{"op":"move-file","from":"a.mdx","to":"b.mdx","mapping":[' || string_agg('{"from":"' || f || '","to":"b.mdx' || substring(f, 6) || '"}', ',' ORDER BY f) || ']}' AS text FROM (
  SELECT 'a.mdx' AS f UNION ALL SELECT DISTINCT 'a.mdx#u' || user_id FROM events)""")
def append_journal(spark, sf_dir):
    users = _t(spark, sf_dir, "events").select(F.concat(F.lit("a.mdx#u"), F.col("user_id").cast("string")).alias("from")).distinct()
    both = users.unionByName(spark.range(1).select(F.lit("a.mdx").alias("from")))
    mapping = both.select("from", F.concat(F.lit("b.mdx"), F.substr("from", F.lit(6))).alias("to"))
    prior = spark.range(1).select(F.lit(1).cast("long").alias("line"), F.lit("first").alias("text"))
    return journal.append(prior, journal.entry("move-file", "a.mdx", "b.mdx", mapping)).filter("line = 2")


# cycles and other findings


@query(twin("""SELECT 'cycle' AS code, [p, 'sup.mdx#s' || k, p] AS locations FROM (
  SELECT s_suppkey AS k, (SELECT min(source) FROM edges e WHERE e.kind = 'embeds' AND e.source LIKE 'parts/%' AND e.target = 'sup.mdx#s' || s_suppkey) AS p FROM supplier WHERE s_suppkey = 1) WHERE p IS NOT NULL""", "edges"))
def cycle_findings(spark, sf_dir):
    """The first supplier is made to depend on the least part that embeds it."""
    work = project(spark, sf_dir, code=False)
    edges = checkpoint(work.edges)
    back = edges.filter("kind = 'embeds' AND target = 'sup.mdx#s1'").groupBy(F.col("target").alias("source")).agg(F.min("source").alias("target")).select(F.lit("depends").alias("kind"), "source", "target")
    return validation.cycle_findings(edges.unionByName(back), work.nodes)


@query("""
SELECT 'cycle' AS code, list_append(list('geo/' || r_name || '.mdx' ORDER BY (r_regionkey - f + n) % n), arg_min('geo/' || r_name || '.mdx', r_name)) AS locations
FROM (SELECT *, (SELECT count(*) FROM region) AS n, (SELECT arg_min(r_regionkey, r_name) FROM region) AS f FROM region)""")
def import_cycles(spark, sf_dir):
    """Each region's file imports that of the next region, and the last one the first."""
    region = _t(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("geo/"), "r_name", F.lit(".mdx")).alias("path"))
    after = region.select(F.col("r_regionkey").alias("k"), F.col("path").alias("file"))
    n = region.count()
    return validation.import_cycle_findings(region.join(after, (F.col("r_regionkey") + 1) % n == F.col("k")).select("path", "file"))


@query("SELECT 'invalid-import' AS code, 'd' || doc_id AS path, 'X' AS name FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def invalid_imports(spark, sf_dir):
    """Every third document imports what is no source, every fifth one name twice."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"))
    file = F.when(F.col("doc_id") % 3 == 0, F.concat("path", F.lit("?"))).otherwise(F.col("path"))
    imports = docs.select("path", F.lit("X").alias("name"), file.alias("file"), "doc_id")
    twice = imports.unionByName(imports.filter("doc_id % 5 = 0")).drop("doc_id")
    return validation.invalid_import(twice, docs.select("path")).select("code", F.col("locations")[0].alias("path"), F.col("locations")[1].alias("name"))


@query(twin("SELECT 'cross-module-text' AS code, source, target FROM edges WHERE kind = 'embeds' AND source LIKE 'parts/%'", "edges"))
def foreign_text(spark, sf_dir):
    """Parts call the text function of their own module with a supplier's node."""
    calls = project(spark, sf_dir, code=False).edges.filter("kind IN ('embeds', 'contains')").select("source", scalars.identity_path(F.col("source")).alias("module"), "target")
    return validation.foreign_text(calls).select("code", F.col("locations")[0].alias("source"), F.col("locations")[1].alias("target"))


@query("""
SELECT code, location, CASE code WHEN 'missing-id' THEN 0 WHEN 'cycle' THEN 8 WHEN 'invalid-source-path' THEN 18 WHEN 'refused-moved-import' THEN 36 ELSE 37 END AS rank, CASE code WHEN 'configuration-error' THEN 2 ELSE 1 END AS exit
FROM (SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN 'missing-id' WHEN 1 THEN 'cycle' WHEN 2 THEN 'invalid-source-path' WHEN 3 THEN 'refused-moved-import' END AS code, 'p' || l_partkey AS location FROM lineitem)""")
def finding_ranks(spark, sf_dir):
    n = F.col("l_linenumber") % 5
    code = F.when(n == 0, "missing-id").when(n == 1, "cycle").when(n == 2, "invalid-source-path").when(n == 3, "refused-moved-import")
    found = _t(spark, sf_dir, "lineitem").select(code.alias("code"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("locations"))
    return validation.finding_set(found).select("code", F.col("locations")[0].alias("location"), scalars.code_ordinal(F.col("code")).alias("rank"), scalars.exit_class(F.col("code")).alias("exit"))


@query(twin("""
SELECT code, identity FROM (
  SELECT 'refused-id-collision' AS code, identity, 'geo/ASIA.mdx#n12.c' AS p FROM nodes n WHERE path = 'geo/ASIA.mdx' AND id = 'n8'
  UNION ALL SELECT 'refused-missing-target-parent', 'geo/ASIA.mdx#gone', '' FROM region WHERE r_name = 'ASIA')""", "nodes"))
def refusals_of_moves(spark, sf_dir):
    """A section renamed to a sibling's id, and one moved below a section that is not there."""
    work = project(spark, sf_dir, code=False)
    onto = mutations.refusals(work, mutations.section_mapping(work.nodes, "geo/ASIA.mdx", "n12", "geo/ASIA.mdx", "n8"), "geo/ASIA.mdx", "n12", "geo/ASIA.mdx", "n8")
    lost = mutations.refusals(work, mutations.section_mapping(work.nodes, "geo/ASIA.mdx", "n12", "geo/ASIA.mdx", "gone.n12"), "geo/ASIA.mdx", "n12", "geo/ASIA.mdx", "gone.n12")
    return onto.unionByName(lost)


@query("""SELECT 'refused-destination-exists' AS code, 'geo/' || r_name || '.mdx' AS identity FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'refused-invalid-destination', 'geo/a#b.mdx' FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'refused-identity-unchanged', 'sup.mdx' FROM region WHERE r_name = 'ASIA'""")
def refusals_of_file_moves(spark, sf_dir):
    """The suppliers' file onto a region's, to a path with a barred character, and onto itself."""
    work = project(spark, sf_dir, code=False)
    work = Workspace(checkpoint(work.nodes), None, checkpoint(work.edges), None)
    found = [mutations.file_refusals(work, "sup.mdx", new, ["**/*.mdx"]) for new in ("geo/ASIA.mdx", "geo/a#b.mdx", "sup.mdx")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT 'out/' || conv_id || '.md' AS path, sha256(coalesce(string_agg(CASE WHEN role = 'system' THEN NULL ELSE text || chr(10) END, '' ORDER BY turn), '')) AS sha256 FROM conversations GROUP BY conv_id")
def emit_markdown(spark, sf_dir):
    """Turns as pieces: what the system says is removed, with its line."""
    turns = _t(spark, sf_dir, "conversations").withColumn("doc", F.concat(F.col("conv_id").cast("string"), F.lit(".mdx")))
    kind = F.when(F.col("role") == "system", "removal").otherwise("content")
    none = F.lit(None).cast("string").alias("expansion")
    shown = turns.select("doc", (F.col("turn") * 2).alias("ord"), kind.alias("kind"), "text", none)
    ends = turns.select("doc", (F.col("turn") * 2 + 1).alias("ord"), F.lit("content").alias("kind"), F.lit("\n").alias("text"), none)
    return text.emit_markdown(shown.unionByName(ends), "out").select("path", "sha256")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'empty path' WHEN 1 THEN 'white space' WHEN 2 THEN 'empty segment' WHEN 3 THEN 'empty' END AS problem FROM part""")
def node_spelling(spark, sf_dir):
    n = F.col("p_partkey") % 5
    id = F.when(n == 1, F.lit("#a b")).when(n == 2, F.lit("#a..b")).when(n == 3, F.lit("#")).otherwise(F.lit("#a.b"))
    spelled = F.concat(F.when(n == 0, F.lit("")).otherwise(F.lit("parts.mdx")), id)
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.spelling_problem(spelled).alias("problem"))


@query(twin("SELECT 'unknown-text-target' AS code, source FROM edges WHERE kind = 'embeds' AND source LIKE 'parts/Brand_7.mdx#%'", "edges"))
def consulted_domain(spark, sf_dir):
    """Every part's embeddings are taken for faults; an answer that draws on one brand's file has its own."""
    work = project(spark, sf_dir, code=False)
    faults = work.edges.filter("kind = 'embeds'").select(F.lit("unknown-text-target").alias("code"), F.array("source").alias("locations"))
    drawn = work.nodes.filter(globs.matches(F.col("path"), "parts/Brand_7.mdx"))
    return availability.consulted(drawn, faults).select("code", F.col("locations")[0].alias("source"))


@query("SELECT 'weftgraph' AS name, '0.2' AS version, sha256(unhex('0000000000000005') || encode('cycle')) AS cycle_digest")
def version(spark, sf_dir):
    return availability.version(spark).withColumn("cycle_digest", hashes.cycle_digest())


# review sessions


def _session(spark, sf_dir) -> tuple[changes.Analysis, DataFrame]:
    found = analysis(spark, sf_dir)
    return found, checkpoint(sessions.create("baseline-1", review.path_blocks(found), review.path_blocked_by(found)))


NO_CODE = {**VISITED, "items": VISITED["items"].split("UNION ALL SELECT 'code-impact'")[0]}


@query(vsql("""SELECT 'baseline-1' AS session, kind, scope, 'unresolved' AS status, CASE WHEN kind = 'parent-consistency' THEN (SELECT count(DISTINCT branch) FROM branch b WHERE b.scope = i.scope) ELSE 0 END AS n_blockers FROM items i""", **NO_CODE))
def session_create(spark, sf_dir):
    return _session(spark, sf_dir)[1].select("session", "kind", "scope", "status", F.size("blocked_by").cast("long").alias("n_blockers"))


@query(vsql("SELECT 'baseline-1' AS session, count(*) AS items, count(*) FILTER (length(scope) % 3 <> 0) AS \"open\" FROM items", **NO_CODE))
def session_list(spark, sf_dir):
    items = _session(spark, sf_dir)[1]
    return sessions.listing(items.withColumn("status", F.when(F.length("scope") % 3 == 0, "skipped").otherwise(F.col("status"))))


@query(vsql("SELECT count(*) FILTER (length(scope) % 3 <> 0) AS unresolved, 0 AS updated, 0 AS \"no-change\", count(*) FILTER (length(scope) % 3 = 0) AS skipped, 0 AS invalidated FROM items", **NO_CODE))
def session_status(spark, sf_dir):
    items = _session(spark, sf_dir)[1]
    return sessions.status(items.withColumn("status", F.when(F.length("scope") % 3 == 0, "skipped").otherwise(F.col("status"))), "baseline-1")


@query(vsql("""SELECT '{"context":[' || array_to_string([ '"' || x || '"' FOR x IN context], ',') || '],"kind":"' || kind || '","origin":[' || array_to_string([ '"' || x || '"' FOR x IN origin], ',') || '],"scope":"' || scope || '","status":"unresolved"}' AS item FROM items""", **NO_CODE))
def session_export(spark, sf_dir):
    """The items' JSON without their ids, which are digests."""
    shown = sessions.export(_session(spark, sf_dir)[1])
    plain = F.regexp_replace(F.regexp_replace("json", r'"blockedBy":\[[^\]]*\],', ""), r'"id":"[^"]*",', "")
    return shown.select(plain.alias("item"))


ROLES = """
  SELECT kind, scope, node, string_agg(DISTINCT names, ',' ORDER BY names) AS names FROM (
    SELECT kind, scope, scope AS node, unnest(CASE kind WHEN 'subtree-coherence' THEN ['metadata_hash', 'subtree_hash'] WHEN 'metadata-consistency' THEN ['metadata_hash'] ELSE ['metadata_hash', 'own_hash'] END) AS names FROM items
    UNION ALL SELECT kind, scope, unnest(context), CASE WHEN kind IN ('parent-consistency', 'dependency-consistency') THEN 'subtree_hash' END FROM items
    UNION ALL SELECT kind, scope, unnest(origin), NULL FROM items) GROUP BY kind, scope, node"""


@query(vsql("SELECT kind, scope, node, node IN (SELECT identity FROM nc) AS present, CASE WHEN node IN (SELECT identity FROM nc) THEN coalesce(names, '') END AS names FROM roles", **NO_CODE, roles=ROLES))
def recorded_state(spark, sf_dir):
    """What is recorded of each item's nodes; the digests themselves are compared in the queries of hashes."""
    found, items = _session(spark, sf_dir)
    now = found.now
    every = hashes.own_hash(now.nodes, now.parts).join(hashes.subtree_hash(now.nodes, now.parts), "identity").join(hashes.metadata_hash(now.nodes, now.edges), "identity").withColumn("effective_hash", F.lit(""))
    state = sessions.recorded_state(items, every).join(items.select("session", "id", "kind", "scope"), ["session", "id"])
    return state.select("kind", "scope", "node", "present", F.array_join(F.map_keys("hashes"), ",").alias("names"))


@query(twin("""SELECT identity AS scope FROM nodes WHERE (parent = 'geo/ASIA.mdx#n12' AND doc_ord % 2 = 0)
OR (identity IN ('geo/ASIA.mdx', 'geo/ASIA.mdx#n12') AND EXISTS (SELECT 1 FROM nodes c WHERE c.parent = 'geo/ASIA.mdx#n12' AND c.doc_ord % 2 = 0))""", "nodes"))
def session_invalidated(spark, sf_dir):
    """An audit's items after every second customer of a nation has new text: those, the nation, and the region, by their subtree hashes."""
    nodes = checkpoint(tables.nodes(spark, sf_dir).filter("path = 'geo/ASIA.mdx'"))
    items = sessions.create("audit", review.audit(Workspace(nodes, None, None, None)).drop("blocked_by", "context")).withColumn("status", F.lit("no-change"))
    edited = (F.col("parent") == "geo/ASIA.mdx#n12") & (F.col("doc_ord") % 2 == 0)
    now = nodes.withColumn("own_text", F.when(edited, F.concat("own_text", F.lit("!"))).otherwise(F.col("own_text")))
    none = spark.createDataFrame([], "kind string, source string, target string")
    every = lambda n: hashes.own_hash(n).join(hashes.subtree_hash(n), "identity").join(hashes.metadata_hash(n, none), "identity").withColumn("effective_hash", F.lit(""))
    then, after = (checkpoint(sessions.recorded_state(items, every(n))) for n in (nodes, now))
    return sessions.invalidated(items, then, after).join(items, ["session", "id"]).select("scope")


@query(vsql("""
SELECT r.identity, b.coverage AS coverage_before, c.coverage AS coverage_after, len(coalesce(b.targets, [])) AS d_before, len(coalesce(c.targets, [])) AS d_after FROM rec r JOIN sb b ON b.identity = r.identity JOIN sc c ON c.identity = r.identity WHERE r.metadata_changed"""))
def metadata_pairs(spark, sf_dir):
    found = sessions.metadata_pairs(analysis(spark, sf_dir))
    size = lambda c: F.size(f"{c}.d").cast("long").alias(f"d_{c}")
    return found.select("identity", F.col("before.coverage").alias("coverage_before"), F.col("after.coverage").alias("coverage_after"), size("before"), size("after"))


# scalars


@query("SELECT doc_id, strlen(substring(text, 1, least(length(text), 100))) AS bytes, least(length(text), 100) AS units FROM documents")
def offset_map(spark, sf_dir):
    """The documents hold no character beyond the basic plane, so UTF-16 units are characters; tests hold others."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.least(F.length("text"), F.lit(100)).alias("units"))
    docs = docs.withColumn("bytes", scalars.byte_offset(F.col("text"), F.col("units")))
    return docs.select("doc_id", F.col("bytes").cast("long").alias("bytes"), scalars.utf16_index(F.col("text"), F.col("bytes")).cast("long").alias("units"))


@query("SELECT CAST(c_custkey % 9 AS BIGINT) AS position, c_name || ':x' AS identity, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1, 2")
def canonical_codec(spark, sf_dir):
    """Encoded and read back; every fourth encoding is spoiled by a leading zero."""
    customer = _t(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(":x")).alias("identity"), (F.col("c_custkey") % 9).cast("long").alias("position"), "c_custkey")
    coded = customer.select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("0"), scalars.encode_canonical(F.col("identity"), F.col("position") + 1))).otherwise(scalars.encode_canonical(F.col("identity"), F.col("position"))).alias("c"))
    return coded.select(scalars.parse_canonical(F.col("c")).alias("p")).filter("p IS NOT NULL").groupBy("p.position", "p.identity").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '{\"bytes\":\"ff' || lower(hex(encode(p_name))) || '\"}' ELSE '\"' || p_name || '\"' END AS path, CASE WHEN p_partkey % 5 = 0 THEN 'ff' ELSE '' END || lower(hex(encode(p_name))) AS key FROM part")
def path_json(spark, sf_dir):
    raw = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.col("p_name").cast("binary"))
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.path_json(raw).alias("path"), scalars.path_key(raw).alias("key"))


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"key\":' || p_partkey || ',\"size\":null}' AS json, p_partkey % 3 <> 0 AS valid FROM part")
def emit_json(spark, sf_dir):
    made = scalars.canonical_json(key=F.col("p_partkey").cast("string"), brand=scalars.json_string(F.col("p_brand")), size=F.lit(None).cast("string"))
    spoiled = F.when(F.col("p_partkey") % 3 == 0, F.substring(made, F.lit(1), F.length(made) - 1)).otherwise(made)
    return _t(spark, sf_dir, "part").select("p_partkey", made.alias("json"), scalars.json_valid(spoiled).alias("valid"))


@query("""
SELECT DISTINCT folder, folder = 'specs' OR regexp_matches(folder, '^specs/[0-9]*1$') AS within, folder <> 'src' AND NOT contains(folder, '/.') AS deep FROM (
  SELECT unnest(['specs', 'src', 'specs/' || p_size, 'specs/' || p_size || '/x', 'specs/.' || p_size]) AS folder FROM part)""")
def may_match_within(spark, sf_dir):
    size = F.col("p_size").cast("string")
    folders = _t(spark, sf_dir, "part").select(F.explode(F.array(F.lit("specs"), F.lit("src"), F.concat(F.lit("specs/"), size), F.concat(F.lit("specs/"), size, F.lit("/x")), F.concat(F.lit("specs/."), size))).alias("folder")).distinct()
    return folders.select("folder", globs.may_match_within(F.col("folder"), "specs/*1/*.mdx").alias("within"), globs.may_match_within(F.col("folder"), "specs/**/*.mdx").alias("deep"))


@query("SELECT doc_id, strlen(text) AS n_bytes, regexp_full_match(text, '[\\t\\n\\x0B\\f\\r ]*') AS blank, list_sort(list_distinct(string_split(lang || ',' || source || ',' || lang, ','))) AS names FROM documents")
def text_scalars(spark, sf_dir):
    names = scalars.byte_set(F.split(F.concat_ws(",", "lang", "source", "lang"), ","))
    return _t(spark, sf_dir, "documents").select("doc_id", scalars.utf8_length(F.col("text")).cast("long").alias("n_bytes"), scalars.whitespace_only(F.col("text")).alias("blank"), names.alias("names"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b/' || p_size || '.mdx' WHEN 1 THEN 'a/' || p_size || '.mdx' WHEN 2 THEN NULL ELSE NULL END AS file FROM part""")
def resolve_specifier(spark, sf_dir):
    """From a/b/c.mdx: beside it, one folder up, out of the root, and no relative form."""
    n, name = F.col("p_partkey") % 4, F.concat(F.col("p_size").cast("string"), F.lit(".mdx"))
    given = F.when(n == 0, F.concat(F.lit("./"), name)).when(n == 1, F.concat(F.lit("../x/../"), name)).when(n == 2, F.concat(F.lit("../../../"), name)).otherwise(name)
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.resolve_specifier(F.lit("a/b/c.mdx"), given).alias("file"))
