"""Texts of documents from their pieces.

A document is rows (doc, ord, kind, text, expansion): content, removals and
embeddings. Constructs are taken out; a line that had something other than
white space and is left with white space only, by removals alone, is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalars import split_lines, whitespace_only


def lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line_no, line) with terminators."""
    return docs.select(id, F.posexplode(split_lines(F.col(text)))).select(id, (F.col("pos") + 1).cast("long").alias("line_no"), F.col("col").alias("line"))


def _lines_left(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of pieces (doc, ord, k, line, kind, shown), and the lines (doc, line, left) that stay."""
    cut = F.when(F.col("kind") == "content", split_lines(F.col("text"))).otherwise(F.array("text"))
    parts = pieces.select("doc", "ord", "kind", "expansion", F.posexplode(cut).alias("k", "part"))
    order = Window.partitionBy("doc").orderBy("ord", "k")
    ends = (F.col("kind") == "content") & F.col("part").rlike(r"(?:\r\n|\n|\r)\z")
    placed = parts.withColumn("line", F.coalesce(F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    show = F.when(F.col("kind") == "content", F.col("part")).when(F.col("kind") == "embedding", F.coalesce("expansion", F.lit(""))).otherwise(F.lit(""))
    placed = placed.withColumn("shown", show)
    per = placed.groupBy("doc", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "k", "shown"))), lambda x: x["shown"]), "").alias("left"),
        F.bool_or(F.col("kind") != "content").alias("cut"),
        F.bool_or((F.col("kind") == "embedding") & (F.coalesce("expansion", F.lit("")) != "")).alias("expanded"),
    )
    return placed, per.filter(~(F.col("cut") & ~F.col("expanded") & whitespace_only(F.col("left")))).select("doc", "line", "left")


def shown(pieces: DataFrame) -> DataFrame:
    """(doc, ord, k, text): what is left of each part of a content piece, cut at its terminators; nothing of lines that are dropped."""
    placed, kept = _lines_left(pieces)
    own = placed.filter("kind = 'content'").join(kept.select("doc", "line", F.lit(True).alias("stays")), ["doc", "line"], "left")
    return own.select("doc", "ord", "k", F.when(F.col("stays"), F.col("shown")).otherwise(F.lit("")).alias("text"))


def compiled(pieces: DataFrame) -> DataFrame:
    """(doc, text): lines in order, without those that removals left empty.

    A piece of content is cut at its terminators; a construct belongs whole to
    the line it starts on, and one that spans lines merges them.
    """
    _, kept = _lines_left(pieces)
    joined = kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "left"))), lambda x: x["left"]), "").alias("text"))
    return pieces.select("doc").distinct().join(joined, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))


def emit_markdown(pieces: DataFrame, out: str) -> DataFrame:
    """(path, text, sha256): the Markdown of each document (doc, a path), below a folder."""
    made = compiled(pieces)
    path = F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace("doc", r"\.mdx$", ""), F.lit(".md"))
    return made.select(path.alias("path"), "text", F.sha2("text", 256).alias("sha256"))


def subtree_text(nodes: DataFrame) -> DataFrame:
    """(identity, text): the own text of a node, then those below it in document order, one to a line. No recursion: each text goes to its ancestors by id prefix."""
    from weftgraph.operators.graph import ancestors

    up = ancestors(nodes).select("identity", "ancestor").unionByName(nodes.select("identity", F.col("identity").alias("ancestor")))
    own = up.join(nodes.select("identity", "doc_ord", "own_text"), "identity")
    below = own.groupBy(F.col("ancestor").alias("identity")).agg(F.array_sort(F.collect_list(F.struct("doc_ord", "own_text"))).alias("t"))
    return below.select("identity", F.array_join(F.transform("t", lambda x: x["own_text"]), "\n").alias("text"))


def innermost(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, offset, identity): the deepest span (path, identity, start, end, depth) that holds each offset (path, offset).

    Spans of one depth of a file do not overlap, so of each depth only the last
    one that starts up to an offset can hold it: no offset meets all spans.
    """
    spans = spans.filter(F.col("start") < F.col("end"))
    asked = offsets.select("path", "offset").distinct().join(spans.select("path", "depth").distinct(), "path")
    asked = asked.select("path", "depth", F.col("offset").cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("string").alias("identity"))
    held = spans.select("path", "depth", F.col("start").cast("long").alias("at"), F.lit(0).alias("side"), F.col("end").cast("long").alias("end"), "identity")
    before = Window.partitionBy("path", "depth").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("side") == 0, F.struct("end", "identity")), ignorenulls=True).over(before)
    inside = asked.unionByName(held).withColumn("last", last).filter((F.col("side") == 1) & (F.col("at") < F.col("last.end")))
    found = inside.groupBy("path", "at").agg(F.max_by("last.identity", "depth").alias("identity"))
    return found.select("path", F.col("at").cast(offsets.schema["offset"].dataType).alias("offset"), "identity")


def at(spans: DataFrame, occurrences: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, offset, identity, occurrence): the innermost span of each offset, and the occurrence (file, start, end, kind, target) that holds it, if one does; of several the shortest."""
    asked = offsets.withColumnRenamed("path", "file")
    hit = asked.join(occurrences.select("file", "start", "end", "kind", "target"), "file").filter((F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end")))
    least = hit.groupBy(F.col("file").alias("path"), "offset").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "start", "end", "kind", "target")).alias("o"))
    return innermost(spans, offsets).join(least, ["path", "offset"], "left").select("path", "offset", "identity", F.col("o").dropFields("n").alias("occurrence"))


def apply_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts (id, text) with non-overlapping edits (id, start, end, replacement) in code points, in place."""
    given = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    step = lambda s, e: F.struct(e["end"].cast("long").alias("at"), F.concat(s["done"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (e["start"] - s["at"]).cast("int")), e["replacement"]).alias("done"))
    finish = lambda s: F.concat(s["done"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text")))
    every = texts.join(given, "id", "left")
    return every.select("id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(F.aggregate("edits", start, step, finish)).alias("text"))


def rename(nodes: DataFrame, edges: DataFrame, path: str, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mapping (from, to), nodes and edges after an id prefix is replaced in one file."""
    from weftgraph.functions.scalars import replace_id_prefix

    own = nodes.filter(F.col("path") == path)
    moved = own.select(F.col("identity").alias("from"), F.concat(F.lit(path + "#"), replace_id_prefix(F.col("id"), old, new)).alias("to")).filter("to IS NOT NULL")
    out = nodes
    for c in ("identity", "parent"):
        out = out.join(moved.select(F.col("from").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    out = out.withColumn("id", F.when(F.col("path") == path, F.coalesce(replace_id_prefix(F.col("id"), old, new), "id")).otherwise(F.col("id"))).select(*nodes.columns)
    kept = edges
    for c in ("source", "target"):
        kept = kept.join(moved.select(F.col("from").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return moved, out, kept.select(*edges.columns)
