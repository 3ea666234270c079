"""Review sessions as relations: creation, recorded state, invalidation, reads, invariants, files.

A session's items are rows (session, id, kind, scope, context, origin, status,
note, blocked_by), and the state recorded for each is rows (session, id, node,
present, hashes). Nothing of a session reaches the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.scalars import json_string
from weftgraph.operators import changes, graph, review

#: Statuses, and those that need review (fixed values).
STATUSES = ("unresolved", "updated", "no-change", "skipped", "invalidated")
OPEN = ("unresolved", "invalidated")
#: Hashes that matter, by item kind and by a node's role in it (fixed values).
RELEVANT = {
    "subtree-coherence": {"scope": ("subtree_hash", "metadata_hash")},
    "parent-consistency": {"scope": ("own_hash", "metadata_hash"), "context": ("subtree_hash",)},
    "dependency-consistency": {"scope": ("own_hash", "metadata_hash"), "context": ("subtree_hash",)},
    "metadata-consistency": {"scope": ("metadata_hash",)},
    "code-impact": {"target": ("subtree_hash", "effective_hash")},
    "uncovered-requirement": {"scope": ("subtree_hash", "metadata_hash")},
}
HASHES = ("own_hash", "subtree_hash", "effective_hash", "metadata_hash")
NAME = r"[A-Za-z0-9_-][A-Za-z0-9._-]*"

ITEMS = "session string, id string, kind string, scope string, context array<string>, origin array<string>, status string, note string, blocked_by array<string>"


def create(name: str, items: DataFrame, blocked_by: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Items of a new session, all unresolved, from generated ones (kind, scope, context, origin) and (kind, scope, by_kind, by_scope).

    A name that is not valid, or that differs from an existing session's
    (session) only by the case of letters, is refused.
    """
    if not re.fullmatch(NAME, name):
        raise ValueError(f"not a session name: {name!r}")
    if existing is not None and not existing.filter(F.lower("session") == name.lower()).isEmpty():
        raise ValueError(f"a session of that name exists: {name!r}")
    own = items.select("kind", "scope", *[F.col(c) if c in items.columns else F.array().cast("array<string>").alias(c) for c in ("context", "origin")])
    id = review.item_id(F.col("kind"), F.col("scope"))
    if blocked_by is not None:
        waits = blocked_by.groupBy("kind", "scope").agg(F.array_sort(F.collect_set(review.item_id(F.col("by_kind"), F.col("by_scope")))).alias("blocked_by"))
        own = own.join(waits, ["kind", "scope"], "left")
    else:
        own = own.withColumn("blocked_by", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    return own.select(F.lit(name).alias("session"), id.alias("id"), "kind", "scope", "context", "origin", F.lit("unresolved").alias("status"), F.lit(None).cast("string").alias("note"), F.coalesce("blocked_by", none).alias("blocked_by"))


def roles(items: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(session, id, node, names): each node of an item, and the hashes that matter of it, all its roles together.

    ``targets``: (scope, node) of the impact edges of code locations.
    """
    role = lambda nodes, name: F.transform(nodes, lambda x: F.struct(x.alias("node"), F.lit(name).alias("role")))
    every = items.select("session", "id", "kind", F.explode(F.concat(role(F.array("scope"), "scope"), role(F.col("context"), "context"), role(F.col("origin"), "origin"))).alias("r"))
    every = every.select("session", "id", "kind", "r.node", "r.role")
    if targets is not None:
        code = items.filter("kind = 'code-impact'").join(targets, "scope").select("session", "id", "kind", "node", F.lit("target").alias("role"))
        every = every.unionByName(code)
    names = F.array().cast("array<string>")
    for kind, by in RELEVANT.items():
        for name, hashes in by.items():
            names = F.when((F.col("kind") == kind) & (F.col("role") == name), F.array(*map(F.lit, hashes))).otherwise(names)
    return every.withColumn("names", names).groupBy("session", "id", "node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


def recorded_state(items: DataFrame, hashes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(session, id, node, present, hashes): what is recorded of an item; hashes: (identity, own_hash, ...); absent nodes have none."""
    now = hashes.select(F.col("identity").alias("node"), F.map_from_arrays(F.array(*map(F.lit, HASHES)), F.array(*HASHES)).alias("h"))
    found = roles(items, targets).join(now, "node", "left")
    own = F.when(F.col("h").isNotNull(), F.map_from_arrays(F.col("names"), F.transform("names", lambda n: F.col("h")[n])))
    return found.select("session", "id", "node", F.col("h").isNotNull().alias("present"), own.alias("hashes"))


def invalidated(items: DataFrame, recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(session, id) of resolved items whose state differs from what was recorded: a hash, a presence, or the set of nodes."""
    key = lambda s: F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node", "present", F.array_sort(F.map_entries("hashes")).alias("h"))))), 256).alias(s)
    both = recorded.groupBy("session", "id").agg(key("then")).join(now.groupBy("session", "id").agg(key("now")), ["session", "id"], "left")
    differs = both.filter(~F.col("then").eqNullSafe(F.col("now"))).select("session", "id")
    return items.filter(~F.col("status").isin(*OPEN)).join(differs, ["session", "id"], "left_semi").select("session", "id")


def listing(items: DataFrame) -> DataFrame:
    """(session, items, open): all sessions with how much is left to review."""
    return items.groupBy("session").agg(F.count("*").alias("items"), F.count_if(F.col("status").isin(*OPEN)).alias("open"))


def status(items: DataFrame, name: str) -> DataFrame:
    """Items by status of one session, all statuses in order, with 0 for none."""
    own = items.filter(F.col("session") == name)
    return own.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def show(items: DataFrame, name: str, id: str) -> DataFrame:
    return items.filter((F.col("session") == name) & (F.col("id") == id))


def export(items: DataFrame) -> DataFrame:
    """(session, id, json): each item as JSON without spaces, keys in order."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ","), F.lit("]"))
    keys: dict[str, Column] = {"blockedBy": listed(F.col("blocked_by")), "context": listed(F.col("context")), "id": json_string(F.col("id")), "kind": json_string(F.col("kind")), "origin": listed(F.col("origin")), "scope": json_string(F.col("scope")), "status": json_string(F.col("status"))}
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in keys.items()], F.when(F.col("note").isNotNull(), F.concat(F.lit('"note":'), json_string(F.col("note")))))
    return items.select("session", "id", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def resolve(items: DataFrame, name: str, id: str, status: str, note: str | None = None) -> DataFrame:
    """Items after one is resolved; a blocked or unknown item, or a status that resolves nothing, is refused."""
    own = items.filter(F.col("session") == name)
    waits = own.select("id", F.explode("blocked_by").alias("by"))
    review.resolve(own.select("id", "status"), waits, id, status)  # refuses
    mine = (F.col("session") == name) & (F.col("id") == id)
    return items.withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status"))).withColumn("note", F.when(mine, F.lit(note)).otherwise(F.col("note")))


def faults(items: DataFrame) -> DataFrame:
    """(code, session, problem): invariants that a stored session breaks."""
    bad = lambda rows, problem: rows.select(F.lit("corrupt-session").alias("code"), "session", F.lit(problem).alias("problem"))
    waits = items.select("session", "id", F.explode("blocked_by").alias("by"))
    lost = waits.join(items.select("session", F.col("id").alias("by")), ["session", "by"], "left_anti")
    named = lambda c: F.concat_ws("\0", "session", c)
    circular = graph.cyclic_core(waits.select(named("id").alias("source"), named("by").alias("target"))).select(F.substring_index("source", "\0", 1).alias("session"))
    found = [
        bad(items.filter(~F.col("status").isin(*STATUSES)), "a status is unknown"),
        bad(items.groupBy("session", "id").count().filter("count > 1"), "an id is there twice"),
        bad(lost, "a blocker is not in the session"),
        bad(circular, "an item waits for itself"),
        bad(items.filter(F.col("id").isNull() | F.col("kind").isNull() | F.col("scope").isNull() | ~F.col("session").rlike(rf"\A{NAME}\z")), "a field is missing or malformed"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def write(items: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each session."""
    items.write.mode("overwrite").partitionBy("session").json(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    names = [f.split(" ")[0] for f in ITEMS.split(", ")]
    return spark.read.schema(ITEMS).json(folder).select(*names)


def metadata_pairs(analysis: changes.Analysis) -> DataFrame:
    """(identity, before, after): d targets, coverage and tags of nodes whose metadata changed; null where a node is not."""

    def side(work, name: str) -> DataFrame:
        d = work.edges.filter("kind = 'depends'").groupBy(F.col("source").alias("identity")).agg(F.array_sort(F.collect_set("target")).alias("d"))
        none = F.array().cast("array<string>")
        return work.nodes.join(d, "identity", "left").select("identity", F.struct(F.coalesce("d", none).alias("d"), "coverage", "tags").alias(name))

    own = analysis.records.filter("metadata_changed").select("identity")
    return own.join(side(analysis.before, "before"), "identity", "left").join(side(analysis.now, "after"), "identity", "left")
