"""Own, subtree, effective and metadata hashes, of identities that are already canonical.

``changes`` gives nodes their canonical identities first, so the position that
goes with each is constant here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalars import digest, digest_all, frame, frame_all
from weftgraph.operators import graph

START = "0"  # journal position of an identity that no entry ends


def cycle_digest():
    """What stands for the hash of a node that is being computed already, in an invalid graph."""
    return digest(F.lit("cycle"))


def plain_parts(nodes: DataFrame, edges: DataFrame | None = None, own: bool = False, after_child=None, after_embed: str = "") -> DataFrame:
    """Parts of nodes whose content is not known any closer: the text, then what is embedded by identity, then the children in order, an empty run after each.

    own: the edges are known to be of these nodes. after_child (of the child's
    row) and after_embed: the text of the runs behind, where they have one.
    """
    ord = lambda kind, place, name, half: F.struct(F.lit(kind).alias("a"), place.cast("long").alias("b"), name.cast("string").alias("c"), F.lit(half).alias("d")).alias("ord")
    run = nodes.select("identity", ord(0, F.lit(0), F.lit(""), 0), F.lit("run").alias("kind"), F.coalesce("own_text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("target"))
    kids = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("identity"), F.lit("child").alias("kind"), F.col("doc_ord").alias("place"), F.col("identity").alias("name"), F.coalesce(F.lit("") if after_child is None else after_child, F.lit("")).alias("after"))
    if edges is not None:
        embeds = edges.filter("kind = 'embeds'")
        embeds = embeds if own else embeds.join(nodes.select(F.col("identity").alias("source")), "source", "left_semi")
        kids = kids.unionByName(embeds.select(F.col("source").alias("identity"), F.lit("embed").alias("kind"), F.lit(0).cast("long").alias("place"), F.col("target").alias("name"), F.lit(after_embed).alias("after")))
    at = F.when(F.col("kind") == "embed", 1).otherwise(2)
    both = lambda half, kind, text, target: F.struct(F.struct(at.alias("a"), F.col("place").alias("b"), F.col("name").alias("c"), F.lit(half).alias("d")).alias("ord"), kind.alias("kind"), text.cast("string").alias("text"), target.cast("string").alias("target"))
    pair = F.explode(F.array(both(0, F.col("kind"), F.lit(None), F.col("name")), both(1, F.lit("run"), F.col("after"), F.lit(None)))).alias("p")
    return run.unionByName(kids.select("identity", pair).select("identity", "p.*"))


def own_hash(nodes: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(identity, own_hash): runs, children and embeddings in order; an embedding without a target counts as such."""
    parts = plain_parts(nodes) if parts is None else parts
    reference = F.concat(frame(F.col("kind")), frame(F.col("target")), frame(F.lit(START)))
    piece = F.when(F.col("kind") == "run", F.concat(frame(F.lit("run")), frame(F.coalesce("text", F.lit(""))))).when(F.col("target").isNull(), frame(F.lit("embed-unresolved"))).otherwise(reference)
    # sorted by the aggregate itself: a comparison by a lambda, and hexadecimal digits of every piece, cost more than all else
    whole = parts.select("identity", "ord", piece.alias("piece")).groupBy("identity").agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY ord)").alias("p"))
    every = nodes.select("identity").join(whole, "identity", "left")
    return every.select("identity", F.sha2(F.concat(frame(F.lit("own")), F.coalesce("p", F.lit(b""))), 256).alias("own_hash"))


def _sums(*columns) -> list:
    """Aggregates that are equal for equal bags of rows, and for others by a chance of about 2^-128: sums of the halves of two 64-bit hashes."""
    marked = [x for c in columns for x in (F.isnull(c), F.col(c))]  # a null would leave a hash as it is
    hashed = [F.xxhash64(F.lit(salt), *marked) for salt in (1, 2)]
    return [F.sum(half).alias(f"s{k}{j}") for k, h in enumerate(hashed) for j, half in enumerate((h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)))]


def content_sums(parts: DataFrame) -> DataFrame:
    """(identity, content): equal for nodes whose parts are the same; their own hashes are equal then. It is summed where the rows are, not sorted."""
    found = parts.groupBy("identity").agg(*_sums("ord", "kind", "text", "target"))
    return found.select("identity", F.struct(*[c for c in found.columns if c != "identity"]).alias("content"))


def dependency_sums(own: DataFrame) -> DataFrame:
    """(identity, deps): equal for nodes whose dependency edges (kind, source, target) are the same."""
    found = own.groupBy(F.col("source").alias("identity")).agg(*_sums("kind", "target"))
    return found.select("identity", F.struct(*[c for c in found.columns if c != "identity"]).alias("deps"))


def own_text(parts: DataFrame) -> DataFrame:
    """(identity, text): a node's runs joined where its children and embeddings were."""
    runs = parts.filter("kind = 'run'").groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("runs"))
    return runs.select("identity", F.array_join(F.transform("runs", lambda r: F.coalesce(r["text"], F.lit(""))), "").alias("text"))


def own_content(parts: DataFrame) -> DataFrame:
    """(identity, content): the parts of a node in order, as an array of (kind, text, target)."""
    every = parts.groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "target"))).alias("p"))
    return every.select("identity", F.transform("p", lambda x: x.dropFields("ord")).alias("content"))


def subtree_hash(nodes: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(identity, subtree_hash), bottom up by level of the id tree."""
    needs = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("identity"), F.col("identity").alias("need"), "doc_ord")
    rank = lambda found: F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["doc_ord"], x["value"]))), lambda x: x["value"])
    combine = lambda due: due.select("identity", F.sha2(F.concat(frame(F.lit("subtree")), frame(F.col("own_hash")), frame_all(rank("found"))), 256).alias("value"))
    return graph.evaluate(own_hash(nodes, parts), needs, combine).withColumnRenamed("value", "subtree_hash")


def effective_hash(nodes: DataFrame, edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(identity, effective_hash) over the tree and the dependency edges among requirement nodes; one pair for each edge."""
    tree = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("identity"), F.col("identity").alias("need"), "doc_ord", F.lit(True).alias("child"))
    deps = edges.filter(F.col("kind").isin("depends", "embeds")).join(nodes.select(F.col("identity").alias("source")), "source", "left_semi")
    deps = deps.select(F.col("source").alias("identity"), F.col("target").alias("need"), F.lit(0).cast("long").alias("doc_ord"), F.lit(False).alias("child"))
    needs = tree.unionByName(deps).withColumn("name", F.col("need"))

    def combine(due: DataFrame) -> DataFrame:
        kids = F.array_sort(F.transform(F.filter("found", lambda x: x["child"]), lambda x: F.struct(x["doc_ord"], x["value"])))
        pairs = F.array_sort(F.transform(F.filter("found", lambda x: ~x["child"]), lambda x: F.struct(x["name"], x["value"])))
        flat = F.flatten(F.transform(pairs, lambda x: F.array(x["name"], F.lit(START), x["value"])))
        return due.select("identity", digest(F.lit("effective"), F.col("own_hash"), digest_all(F.transform(kids, lambda x: x["value"])), digest_all(flat)).alias("value"))

    return graph.evaluate(own_hash(nodes, plain_parts(nodes, edges) if parts is None else parts), needs, combine).withColumnRenamed("value", "effective_hash")


def metadata_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(identity, metadata_hash): d targets, coverage and tags."""
    targets = edges.filter("kind = 'depends'").groupBy(F.col("source").alias("identity")).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    every = nodes.join(targets, "identity", "left")
    none = F.array().cast("array<string>")
    flat = F.flatten(F.transform(F.coalesce("targets", none), lambda t: F.array(t, F.lit(START))))
    tags = F.array_sort(F.coalesce("tags", none))
    return every.select("identity", digest(F.lit("metadata"), digest_all(flat), F.coalesce("coverage", F.lit("")), digest_all(tags)).alias("metadata_hash"))
