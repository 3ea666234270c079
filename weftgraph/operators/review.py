"""Review items derived from an analysis, and the state of review sessions.

Items are rows (kind, scope, context, origin); ``blocked_by`` is its own
relation (kind, scope, by_kind, by_scope). Sets are nested only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import changes, graph
from weftgraph.schema import Workspace, checkpoint

#: Kinds in their order among items of equal depth (fixed values).
KINDS = ("subtree-coherence", "metadata-consistency", "dependency-consistency", "parent-consistency", "code-impact")
RESOLVED = ("updated", "no-change", "skipped")


def item_id(kind: Column, scope: Column) -> Column:
    return F.concat(F.lit("r"), F.substring(F.sha2(F.concat_ws("\0", kind, scope), 256), 1, 16))


def _set(column) -> Column:
    return F.array_sort(F.collect_set(column))


def link_parent(analysis: changes.Analysis) -> DataFrame:
    """(identity, parent): the current parent, or of a deleted node that of the baseline."""
    return analysis.records.select("identity", F.when(F.col("presence") == "deleted", F.col("parent_before")).otherwise(F.col("parent_now")).alias("parent"))


@changes.once
def _above(analysis: changes.Analysis) -> DataFrame:
    """(identity, ancestor, distance) by link parents, which follow the ids."""
    deleted = analysis.records.filter("presence = 'deleted'").select("identity")
    own = ("identity", "ancestor", "distance")
    return changes.ancestors_of(analysis, "now").select(*own).unionByName(changes.ancestors_of(analysis, "before").select(*own).join(deleted, "identity", "left_semi").select(*own))


@changes.once
def visited(analysis: changes.Analysis) -> DataFrame:
    """Changed nodes without a changed ancestor."""
    changed = analysis.records.filter("changed").select("identity")
    below = _above(analysis).join(changed.withColumnRenamed("identity", "ancestor"), "ancestor", "left_semi").select("identity").distinct()
    return changed.join(below, "identity", "left_anti")


def path_blocks(analysis: changes.Analysis) -> DataFrame:
    """(kind, scope, context, origin) of a baseline session."""
    up = _above(analysis)
    changed = analysis.records.filter("changed").select("identity")
    seen = visited(analysis)
    tops = seen.select(F.col("identity").alias("scope"))
    origin = up.select(F.col("ancestor").alias("scope"), "identity").join(changed, "identity").join(tops, "scope", "left_semi")
    origin = origin.unionByName(tops.select("scope", F.col("scope").alias("identity"))).groupBy("scope").agg(_set("identity").alias("origin"))
    chain = up.join(seen, "identity", "left_semi").groupBy(F.col("identity").alias("scope")).agg(_set("ancestor").alias("context"))
    none = F.array().cast("array<string>")
    items = origin.join(chain, "scope", "left").select(F.lit(KINDS[0]).alias("kind"), "scope", F.coalesce("context", none).alias("context"), "origin")
    items = items.unionByName(_parent_items(up, seen, changed)).unionByName(_metadata_items(analysis)).unionByName(_dependency_items(analysis))
    return items if analysis.now.locations is None else items.unionByName(_code_items(analysis))


def branches(up: DataFrame, seen: DataFrame) -> DataFrame:
    """(scope, branch): each proper, non-root ancestor of a visited node with its child on the way there."""
    way = up.join(seen, "identity", "left_semi")
    step = way.select("identity", F.col("ancestor").alias("branch"), "distance").unionByName(seen.select("identity", F.col("identity").alias("branch"), F.lit(0).alias("distance")))
    on = way.select("identity", F.col("ancestor").alias("scope"), (F.col("distance") - 1).alias("distance")).filter(F.contains("scope", F.lit("#")))
    return on.join(step, ["identity", "distance"]).select("scope", "branch").distinct()


def _parent_items(up: DataFrame, seen: DataFrame, changed: DataFrame) -> DataFrame:
    under = branches(up, seen).groupBy("scope").agg(_set("branch").alias("context"))
    origin = up.select(F.col("ancestor").alias("scope"), "identity").join(changed, "identity").groupBy("scope").agg(_set("identity").alias("origin"))
    return under.join(origin, "scope").select(F.lit(KINDS[3]).alias("kind"), "scope", "context", "origin")


def _metadata_items(analysis: changes.Analysis) -> DataFrame:
    own = checkpoint(analysis.records.filter("metadata_changed").select(F.col("identity").alias("scope")))
    pick = lambda w: changes.dependencies(w).filter("kind = 'depends'").select(F.col("source").alias("scope"), "target").join(own, "scope", "left_semi").distinct()
    before, now = pick(analysis.before), pick(analysis.now)
    moved = before.exceptAll(now).unionByName(now.exceptAll(before)).groupBy("scope").agg(_set("target").alias("context"))
    return own.join(moved, "scope", "left").select(F.lit(KINDS[1]).alias("kind"), "scope", F.coalesce("context", F.array().cast("array<string>")).alias("context"), F.array("scope").alias("origin"))


@changes.once
def _causes(analysis: changes.Analysis) -> DataFrame:
    """(identity, cause) of all categories; a node's own metadata counts only where its d targets changed."""
    own = analysis.records.filter("changed OR (metadata_changed AND deps_changed)").select("identity", F.col("identity").alias("cause"))
    return own.unionByName(changes.descendant_changed(analysis)).unionByName(changes.upstream_changed(analysis)).distinct()


def _dependency_items(analysis: changes.Analysis) -> DataFrame:
    hit = changes.effective_dependencies(analysis).join(analysis.both().withColumnRenamed("identity", "target"), "target", "left_semi")
    return _with_origin(analysis, hit, KINDS[2])


def _code_items(analysis: changes.Analysis) -> DataFrame:
    return _with_origin(analysis, changes.impactful_edges(analysis).select(F.col("source").alias("scope"), "target").distinct(), KINDS[4])


def _with_origin(analysis: changes.Analysis, hit: DataFrame, kind: str) -> DataFrame:
    """Items of (scope, target); the causes of a target are gathered once for each target, then united by scope."""
    causes = _causes(analysis).groupBy(F.col("identity").alias("target")).agg(F.collect_set("cause").alias("causes"))
    both = hit.join(causes, "target", "left").groupBy("scope")
    return both.agg(_set("target").alias("context"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("causes")))).alias("origin")).select(F.lit(kind).alias("kind"), "scope", "context", "origin")


def path_blocked_by(analysis: changes.Analysis) -> DataFrame:
    """Parent items wait for the items of their changed branches."""
    seen = visited(analysis)
    on = branches(_above(analysis), seen).join(seen.select(F.col("identity").alias("branch"), F.lit(KINDS[0]).alias("first")), "branch", "left")
    return on.select(F.lit(KINDS[3]).alias("kind"), "scope", F.coalesce("first", F.lit(KINDS[3])).alias("by_kind"), F.col("branch").alias("by_scope"))


def audit(work: Workspace) -> DataFrame:
    """One item for each node, its ancestors as context, and its children's items to wait for."""
    up = graph.ancestors(work.nodes).groupBy(F.col("identity").alias("scope")).agg(_set("ancestor").alias("context"))
    kids = work.nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("scope")).agg(_set("identity").alias("blocked_by"))
    none = F.array().cast("array<string>")
    every = work.nodes.select(F.col("identity").alias("scope")).join(up, "scope", "left").join(kids, "scope", "left")
    return every.select(F.lit(KINDS[0]).alias("kind"), "scope", F.coalesce("context", none).alias("context"), F.coalesce("blocked_by", none).alias("blocked_by"))


def coverage_items(covered: DataFrame) -> DataFrame:
    """One item for each uncovered node."""
    return covered.filter("status = 'uncovered'").select(F.lit("coverage").alias("kind"), F.col("identity").alias("scope"))


def ordered(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add item_ord: depth from the deepest, kind, file, document order; absent scopes after present ones; code last by identity."""
    code = F.col("kind") == KINDS[4]
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    place = nodes.select(F.col("identity").alias("scope"), "doc_ord")
    depth = F.when(F.contains("scope", F.lit("#")), F.size(F.split(F.substring_index("scope", "#", -1), r"\."))).otherwise(F.lit(0))
    keyed = items.join(place, "scope", "left").select(*items.columns, code.alias("_code"), F.when(~code, -depth).alias("_depth"), F.when(~code, rank).alias("_rank"), F.when(~code, F.substring_index("scope", "#", 1)).alias("_file"), F.col("doc_ord").alias("_ord"))
    keys = ["_code", "_depth", "_rank", "_file", F.col("_ord").asc_nulls_last(), "scope"]
    return total_order(keyed, keys, "item_ord").drop("_code", "_depth", "_rank", "_file", "_ord")


def total_order(rows: DataFrame, keys: list, name: str) -> DataFrame:
    """Number rows from 1 in a total order, without one task for all: sorted ranges, then each range's offset."""
    laid = checkpoint(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = laid.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return laid.join(F.broadcast(before.drop("n")), "_part").withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def blocked(items: DataFrame, waits: DataFrame) -> DataFrame:
    """Add ``blocked``: some item to wait for is unresolved. items: (id, status, ...), waits: (id, by)."""
    open_ = items.filter(~F.col("status").isin(*RESOLVED)).select(F.col("id").alias("by"))
    held = waits.join(open_, "by", "left_semi").select("id").distinct().withColumn("blocked", F.lit(True))
    return items.join(held, "id", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def next_item(items: DataFrame, waits: DataFrame) -> DataFrame:
    """The first unblocked item that needs review."""
    return blocked(items, waits).filter(~F.col("blocked") & ~F.col("status").isin(*RESOLVED)).orderBy("item_ord").limit(1)


def invalidated(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(id): items of which a recorded hash, presence or context differs. recorded: (id, node, role, hash); now: (node, hash); a null hash is an absent node."""
    both = recorded.join(now.withColumnRenamed("hash", "hash_now"), "node", "left")
    return both.filter(~F.col("hash").eqNullSafe(F.col("hash_now"))).select("id").distinct()


def totals(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("n"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Re-derivation: generated items take over id, status and note of those of equal kind and scope; others remain."""
    both = old.alias("o").join(new.alias("n"), ["kind", "scope"], "full_outer")
    made = F.coalesce("o.id", item_id(F.col("kind"), F.col("scope")))
    return both.select("kind", "scope", made.alias("id"), F.coalesce("o.status", F.lit("pending")).alias("status"), F.coalesce("n.context", "o.context").alias("context"), F.col("n.context").isNotNull().alias("generated"))


def resolve(items: DataFrame, waits: DataFrame, id: str, status: str) -> DataFrame:
    """Items with the status of one replaced; a blocked or unknown item is refused."""
    if status not in RESOLVED:
        raise ValueError(f"no status to resolve with: {status}")
    row = blocked(items, waits).filter(F.col("id") == id).select("blocked").first()
    if row is None or row[0]:
        raise ValueError("unknown item" if row is None else "the item is blocked")
    return items.withColumn("status", F.when(F.col("id") == id, F.lit(status)).otherwise(F.col("status")))


def split(work: Workspace, scope: str) -> DataFrame:
    """What a subtree item is decomposed into: one for each child subtree, and the parent item that waits for them."""
    kids = work.nodes.filter(F.col("parent") == scope).select(F.lit(KINDS[0]).alias("kind"), F.col("identity").alias("scope"))
    return kids.unionByName(work.nodes.filter(F.col("identity") == scope).select(F.lit(KINDS[3]).alias("kind"), F.col("identity").alias("scope")))
