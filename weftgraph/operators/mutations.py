"""Renames and moves over the relations: mappings, rewritten workspace, refusals, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import globs, scalars
from weftgraph.operators import availability, graph, validation
from weftgraph.schema import Workspace


def section_mapping(nodes: DataFrame, path: str, old: str, to_path: str, new: str) -> DataFrame:
    """(from, to) of a subtree by prefix replacement, in the same file or another."""
    own = nodes.filter(F.col("path") == path)
    made = F.concat(F.lit(to_path + "#"), scalars.replace_id_prefix(F.col("id"), old, new))
    return own.select(F.col("identity").alias("from"), made.alias("to")).filter("to IS NOT NULL")


def file_mapping(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """(from, to) of all nodes of a file: only the path changes."""
    own = nodes.filter(F.col("path") == old)
    return own.select(F.col("identity").alias("from"), F.when(F.col("id").isNull(), F.lit(new)).otherwise(F.concat(F.lit(new + "#"), "id")).alias("to"))


def rewrite(work: Workspace, mapping: DataFrame) -> Workspace:
    """Nodes and edges under their new identities. A moved section becomes the last child of its parent."""

    def renamed(frame: DataFrame, *columns: str) -> DataFrame:
        out = frame
        for c in columns:
            out = out.join(mapping.select(F.col("from").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        return out.select(*frame.columns)

    moved = mapping.select(F.col("to").alias("identity"), F.col("from").alias("was"))
    nodes = renamed(work.nodes, "identity").join(moved, "identity", "left")
    path, id = scalars.identity_path(F.col("identity")), scalars.identity_id(F.col("identity"))
    up = F.when(id.isNull(), F.lit(None).cast("string")).when(scalars.parent_id(id).isNull(), path).otherwise(F.concat(path, F.lit("#"), scalars.parent_id(id)))
    changed = F.col("was").isNotNull()
    same_file = scalars.identity_path(F.col("was")) == path
    last = F.lit(1 << 40).cast("long")
    nodes = nodes.select(
        "identity", F.when(changed, path).otherwise(F.col("path")).alias("path"), F.when(changed, id).otherwise(F.col("id")).alias("id"), "is_root",
        F.when(changed, up).otherwise(F.col("parent")).alias("parent"), F.when(changed & ~F.col("is_root"), F.size(F.split(id, r"\."))).otherwise(F.col("depth")).alias("depth"),
        F.when(changed & ~same_file & ~F.col("is_root"), F.col("doc_ord") + last).otherwise(F.col("doc_ord")).alias("doc_ord"), "coverage", "tags", "own_text",
    )
    edges = renamed(work.edges.filter("kind <> 'contains'"), "source", "target")
    tree = nodes.filter("parent IS NOT NULL").select(F.lit("contains").alias("kind"), F.col("parent").alias("source"), F.col("identity").alias("target"))
    return Workspace(nodes, work.locations, tree.unionByName(edges), work.occurrences)


def refusals(work: Workspace, mapping: DataFrame, path: str, old: str, to_path: str, new: str) -> DataFrame:
    """(code, identity): every reason against a section's rename or move, together."""
    spark = work.nodes.sparkSession
    one = spark.range(1).select(F.lit(f"{to_path}#{new}").alias("identity"), F.lit(new).alias("id"))
    invalid = one.filter(scalars.id_problem(F.col("id")).isNotNull()).select(F.lit("refused-invalid-id").alias("code"), "identity")
    same = one.filter(F.lit((path, old) == (to_path, new))).select(F.lit("refused-identity-unchanged").alias("code"), "identity")
    rest = work.nodes.join(mapping.select(F.col("from").alias("identity")), "identity", "left_anti")
    taken = rest.join(mapping.select(F.col("to").alias("identity")), "identity", "left_semi").select(F.lit("refused-id-collision").alias("code"), "identity")
    parent = new.rpartition(".")[0]
    target = f"{to_path}#{parent}" if parent else to_path
    missing = one.join(rest.filter(F.col("identity") == target).select(F.lit(True).alias("there")), F.lit(True), "left").filter("there IS NULL")
    code = "refused-missing-target-parent" if path != to_path or old.rpartition(".")[0] != parent else "refused-structural-parent"
    return invalid.unionByName(same).unionByName(taken).unionByName(missing.select(F.lit(code).alias("code"), F.lit(target).alias("identity")))


def file_refusals(work: Workspace, old: str, new: str, spec_groups: list[str], code: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """(code, identity): every reason against a file's move, together.

    The destination must be another path than the old one, of no file, matched
    by the globs of specs and free of barred characters; no file derived from it
    may lie where a source, of specs or ``code`` (path), is; and the moved
    references must close no cycle.
    """
    one = work.nodes.sparkSession.range(1).select(F.lit(new).alias("path"))
    named = lambda rows, reason: rows.select(F.lit(reason).alias("code"), F.col("path").alias("identity"))
    sources = work.nodes.select("path").distinct()
    rest = sources.filter(F.col("path") != old)
    every = rest if code is None else rest.unionByName(code.select("path"))
    derived = availability.derived_paths(one, out).select("path")
    bad = ~globs.matches_any(F.col("path"), spec_groups) | F.col("path").rlike(validation.BARRED_PATH) | ~F.endswith("path", F.lit(".mdx"))
    found = named(one.filter(F.lit(old == new)), "refused-identity-unchanged").unionByName(named(rest.filter(F.col("path") == new), "refused-destination-exists"))
    found = found.unionByName(named(one.filter(bad), "refused-invalid-destination")).unionByName(named(derived.join(every, "path", "left_semi"), "refused-exposed-derived-file"))
    turning = would_cycle(work, file_mapping(work.nodes, old, new)).select(F.lit("refused-cycle").alias("code"), F.element_at("cycle", 1).alias("identity"))
    return found.unionByName(turning).distinct()


def would_cycle(work: Workspace, mapping: DataFrame) -> DataFrame:
    """Dependency cycles of the rewritten workspace, containment included."""
    after = rewrite(work, mapping)
    return graph.cycles(after.edges.filter(F.col("kind").isin("contains", "depends", "embeds")).join(after.nodes.select(F.col("identity").alias("source")), "source", "left_semi"))


def derived_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): derived files that an operation adds or removes."""
    added = now.select("path").join(before.select("path"), "path", "left_anti").select("path", F.lit("added").alias("change"))
    return added.unionByName(before.select("path").join(now.select("path"), "path", "left_anti").select("path", F.lit("removed").alias("change")))
