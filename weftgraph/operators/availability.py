"""What can be answered over faulty sources, and whole-workspace views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import globs, scalars
from weftgraph.operators import changes, graph
from weftgraph.schema import Workspace, checkpoint


VERSION = "0.2"


def text_unavailable(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Nodes (identity) whose text expands, somewhere, what does not resolve or what comes back to itself.

    ``unresolved``: (identity) of nodes with an embedding without a target.
    """
    embeds = edges.filter("kind = 'embeds'").join(nodes.select(F.col("identity").alias("source")), "source", "left_semi")
    steps = checkpoint(edges.filter("kind = 'contains'").unionByName(embeds).select("source", "target"))
    core = graph.cyclic_core(steps)
    seeds = unresolved.select("identity").unionByName(core.select(F.col("source").alias("identity")))
    up = steps.select(F.col("source").alias("identity"), F.col("target").alias("below"))
    return changes.spread(seeds.select("identity", F.lit("").alias("cause")).distinct(), checkpoint(up)).select("identity")


def expansion_files(nodes: DataFrame, edges: DataFrame, paths: list[str]) -> DataFrame:
    """(path) of the files that the texts of some files expand from, those files included."""
    embeds = edges.filter("kind = 'embeds'").join(nodes.select(F.col("identity").alias("source")), "source", "left_semi")
    steps = edges.filter("kind = 'contains'").unionByName(embeds)
    roots = nodes.filter(F.col("path").isin(*paths) & F.col("is_root"))
    reached = graph.bfs(steps, roots).select("identity")
    return reached.join(nodes.select("identity", "path"), "identity").select("path").distinct()


def import_cycles(imports: DataFrame) -> DataFrame:
    """Elementary cycles of (path, file) imports; one that imports itself is a cycle of one."""
    return graph.cycles(imports.select(F.col("path").alias("source"), F.col("file").alias("target")).filter("target IS NOT NULL"))


def defined(places: DataFrame) -> DataFrame:
    """Sections (path, id) that define an identity: of a unique id, each of whose prefixes is a unique id of the file too."""
    unique = places.filter("id IS NOT NULL").groupBy("path", "id").count().filter("count = 1").select("path", "id")
    segments = F.split("id", r"\.")
    chain = unique.select("path", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "."))).alias("prefix"))
    lost = chain.join(unique.withColumnRenamed("id", "prefix"), ["path", "prefix"], "left_anti").select("path", "id").distinct()
    return unique.join(lost, ["path", "id"], "left_anti")


def accompanying(findings: DataFrame, glob: str | None) -> DataFrame:
    """Findings (code, path, ...) of the files that an answer draws on."""
    return findings if glob is None else findings.filter(globs.matches(F.col("path"), glob))


def version(spark) -> DataFrame:
    """(name, version): one row."""
    return spark.range(1).select(F.lit("weftgraph").alias("name"), F.lit(VERSION).alias("version"))


def consulted(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (code, locations) of which some location lies in a file (path) that an answer draws on."""
    # rows are known by their files: a number given to each would be another one whenever the rows come in another order
    placed = findings.withColumn("_files", F.transform("locations", scalars.identity_path))
    files = placed.select("_files").distinct().select("_files", F.explode("_files").alias("path"))
    hit = files.join(paths.select("path").distinct(), "path", "left_semi").select("_files").distinct()
    return placed.join(hit, "_files", "left_semi").select(*findings.columns)


def view(work: Workspace) -> DataFrame:
    """(path, sections): the sections of each document in order, with their depth, tags and coverage."""
    own = work.nodes.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("doc_ord", "identity", "depth", "coverage", "tags"))).alias("s"))
    return own.select("path", F.transform("s", lambda x: x.dropFields("doc_ord")).alias("sections"))


def inventory(sources: DataFrame, derived: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, role): sources by kind, and derived and recorded paths."""
    return sources.select("path", F.col("kind").alias("role")).unionByName(derived.select("path", F.lit("derived").alias("role"))).unionByName(recorded.select("path", F.lit("recorded").alias("role"))).distinct()


def derived_paths(documents: DataFrame, out: str | None = None, marker: str = ".gen") -> DataFrame:
    """(path, source): what a build writes for each document; ``marker`` is in the name of all but Markdown."""
    module = F.regexp_replace("path", r"\.mdx$", "")
    made = [F.concat(module, F.lit(marker + s)) for s in (".js", ".d.ts", ".d.ts.map")]
    if out is not None:
        made.append(F.concat(F.lit(out.rstrip("/") + "/"), module, F.lit(".md")))
    return documents.select(F.explode(F.array(*made)).alias("path"), F.col("path").alias("source"))
