"""Coverage of a target set from a boundary set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import globs
from weftgraph.operators import graph
from weftgraph.schema import DEPENDENCY_KINDS, Workspace, checkpoint

#: Reasons for which a target is ignored, in their fixed order.
REASONS = ("root node", 'coverage="none"', "non-leaf", "lacking tags")


@dataclass(frozen=True)
class Profile:
    target: tuple[str, ...]
    boundary: tuple[str, ...]
    boundary_kind: str = "code"
    mode: str = "transitive"
    targets: str = "leaves"
    target_tags: tuple[str, ...] | None = None
    edge_kinds: tuple[str, ...] = DEPENDENCY_KINDS


def judged(work: Workspace, profile: Profile) -> DataFrame:
    """Nodes of the target group with all reasons to ignore them."""
    group = work.nodes.filter(globs.matches_any(F.col("path"), list(profile.target)))
    inner = work.nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("identity")).distinct().withColumn("inner", F.lit(True))
    group = group.join(inner, "identity", "left")
    tagged = F.lit(True) if profile.target_tags is None else F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, profile.target_tags))), F.lit(False))
    tests = (F.col("is_root"), F.coalesce(F.col("coverage") == "none", F.lit(False)), F.col("inner").isNotNull() & F.lit(profile.targets == "leaves"), ~tagged)
    return group.withColumn("reasons", F.array_compact(F.array(*[F.when(t, r) for t, r in zip(tests, REASONS, strict=True)]))).drop("inner")


def boundary(work: Workspace, profile: Profile) -> DataFrame:
    own = work.locations if profile.boundary_kind == "code" else work.nodes.filter("NOT is_root")
    return own.filter(globs.matches_any(F.col("path"), list(profile.boundary))).select("identity")


def adjacency(work: Workspace, profile: Profile) -> DataFrame:
    """Edges of the profile's kinds that touch no root; a root's identity is a path without an id."""
    edges = work.edges.filter(F.col("kind").isin(*profile.edge_kinds))
    roots = work.nodes.filter("is_root").select("identity")
    for end in ("source", "target"):
        edges = edges.join(roots.withColumnRenamed("identity", end), end, "left_anti")
    return edges.select("source", "target")


def coverage(work: Workspace, profile: Profile) -> DataFrame:
    """(identity, status, path, reasons) of the whole target group; status covered, uncovered or ignored."""
    found = graph.witnesses(adjacency(work, profile), checkpoint(boundary(work, profile)), first_hop_only=profile.mode == "direct")
    status = F.when(F.size("reasons") > 0, "ignored").when(F.col("path_").isNotNull(), "covered").otherwise("uncovered")
    every = judged(work, profile).join(found.withColumnRenamed("path", "path_"), "identity", "left").withColumn("status", status)
    return every.select("identity", "status", F.when(F.col("status") == "covered", F.col("path_")).alias("path"), "reasons")


def check(covered: DataFrame, name: str) -> DataFrame:
    """(profile, required, uncovered, ignored, passed): the gate of one profile, which fails if a required node is uncovered."""
    n = lambda *status: F.count_if(F.col("status").isin(*status))
    return covered.agg(n("covered", "uncovered").alias("required"), n("uncovered").alias("uncovered"), n("ignored").alias("ignored")).select(F.lit(name).alias("profile"), "*", (F.col("uncovered") == 0).alias("passed"))
