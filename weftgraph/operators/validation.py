"""Relational validation conditions: findings (code, locations) with every jointly faulty construct in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalars
from weftgraph.operators import graph

#: Characters that no source path may hold, besides those of invalid UTF-8 (fixed values).
BARRED_PATH = r"[#\x{FFFD}\x00-\x1F\x7F]"


def _finding(rows: DataFrame, code: str, *locations: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.array_sort(F.array(*locations)).alias("locations"))


def missing_id(nodes: DataFrame) -> DataFrame:
    return _finding(nodes.filter("NOT is_root AND id IS NULL"), "missing-id", "identity")


def structural_id(nodes: DataFrame) -> DataFrame:
    """A child's id is its parent's and one more segment; at the top, a single segment."""
    above = nodes.select(F.col("identity").alias("parent"), F.col("id").alias("parent_id"))
    bad = nodes.filter("id IS NOT NULL").join(above, "parent", "left").filter(~scalars.parent_id(F.col("id")).eqNullSafe(F.col("parent_id")))
    return _finding(bad, "invalid-structural-id", "identity")


def duplicate_id(places: DataFrame) -> DataFrame:
    """places: (path, id, place)."""
    same = places.filter("id IS NOT NULL").groupBy("path", "id").agg(F.array_sort(F.collect_list("place")).alias("locations"), F.count("*").alias("n"))
    return same.filter("n > 1").select(F.lit("duplicate-id").alias("code"), "locations")


def invalid_segment(nodes: DataFrame) -> DataFrame:
    return _finding(nodes.filter(~F.col("is_root") & F.col("id").isNotNull() & scalars.id_problem(F.col("id")).isNotNull()), "invalid-segment-or-tag", "identity")


def invalid_tag(nodes: DataFrame) -> DataFrame:
    return _finding(nodes.filter(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: scalars.id_problem(t).isNotNull())), "invalid-segment-or-tag", "identity")


#: Condition of a reference whose target does not resolve, by edge kind (fixed values).
UNKNOWN = {"depends": "unknown-dependency", "embeds": "unknown-text-target", "references": "unknown-ts-reference"}


def unknown_targets(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (kind, source, target) without a target node; one finding for each."""
    lost = references.join(nodes.select(F.col("identity").alias("target")), "target", "left_anti")
    code = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in UNKNOWN.items()])
    return lost.select(code.alias("code"), F.array("source", "target").alias("locations"))


def invalid_path(paths: DataFrame) -> DataFrame:
    return _finding(paths.filter(F.col("path").rlike(BARRED_PATH) | ~F.is_valid_utf8("path") | ~F.endswith("path", F.lit(".mdx"))), "invalid-source-path", "path")


def both_kinds(sources: DataFrame) -> DataFrame:
    """Files (path, kind) that groups of both kinds claim."""
    return _finding(sources.groupBy("path").agg(F.count_distinct("kind").alias("n")).filter("n > 1"), "configuration-error", "path")


def path_conflicts(derived: DataFrame, sources: DataFrame) -> DataFrame:
    """Derived paths that are a folder of another derived path or source."""
    every = derived.select("path").unionByName(sources.select("path")).distinct()
    steps = F.split("path", "/")
    folders = every.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.when(k < F.size(steps), F.array_join(F.slice(steps, F.lit(1), k), "/")))).alias("path")).distinct()
    return _finding(derived.select("path").distinct().join(folders, "path", "left_semi"), "obstructed-write-path", "path")


def stale(recorded: DataFrame, built: DataFrame) -> DataFrame:
    """(path, state): recorded outputs that differ from what a build gives, are missing, or are orphans."""
    both = recorded.alias("r").join(built.alias("b"), "path", "full_outer")
    state = F.when(F.col("b.hash").isNull(), "orphan").when(F.col("r.hash").isNull(), "missing").when(F.col("r.hash") != F.col("b.hash"), "differs")
    return both.select("path", state.alias("state")).filter("state IS NOT NULL")


def orphans(recorded: DataFrame, generated: DataFrame, sources: DataFrame) -> DataFrame:
    return recorded.select("path").join(generated.select("path"), "path", "left_anti").join(sources.select("path"), "path", "left_anti").distinct()


def cycle_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One finding for each elementary cycle of containment, dependency and embedding among requirement nodes; its locations are the closed walk, in order."""
    own = edges.filter(F.col("kind").isin("contains", "depends", "embeds")).join(nodes.select(F.col("identity").alias("source")), "source", "left_semi")
    return graph.cycles(own).select(F.lit("cycle").alias("code"), F.col("cycle").alias("locations"))


def import_cycle_findings(imports: DataFrame) -> DataFrame:
    """One finding for each elementary cycle of (path, file) imports, unused ones too."""
    steps = imports.filter("file IS NOT NULL").select(F.col("path").alias("source"), F.col("file").alias("target"))
    return graph.cycles(steps).select(F.lit("cycle").alias("code"), F.col("cycle").alias("locations"))


def foreign_text(calls: DataFrame) -> DataFrame:
    """Calls (source, module, target) of one module's ``text`` with a node of another; the edge stands."""
    foreign = calls.filter(scalars.identity_path(F.col("target")) != F.col("module"))
    return foreign.select(F.lit("cross-module-text").alias("code"), F.array("source", "target").alias("locations"))


def invalid_import(imports: DataFrame, sources: DataFrame) -> DataFrame:
    """Imports (path, name, file) of what is no source, or of a name that another import of the file has."""
    lost = imports.join(sources.select(F.col("path").alias("file")).distinct(), "file", "left_anti").select(F.lit("invalid-import").alias("code"), F.array("path", "name").alias("locations"))
    twice = imports.groupBy("path", "name").count().filter("count > 1").select(F.lit("invalid-import").alias("code"), F.array("path", "name").alias("locations"))
    return lost.unionByName(twice).distinct()


def finding_set(findings: DataFrame) -> DataFrame:
    """Findings (code, locations), equal ones once, in order: by the code's rank, then by locations one after the other, a shorter list first."""
    return findings.distinct().orderBy(scalars.code_ordinal(F.col("code")), "locations")
