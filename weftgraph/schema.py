"""Relations of a workspace: a requirement graph as DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REQUIREMENTS = T.StructType([
    T.StructField("identity", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("id", T.StringType()),
    T.StructField("is_root", T.BooleanType(), False),
    T.StructField("parent", T.StringType()),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("doc_ord", T.LongType(), False),
    T.StructField("coverage", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("own_text", T.StringType()),
])
LOCATIONS = T.StructType([T.StructField("identity", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("unit", T.StringType())])
EDGES = T.StructType([T.StructField(c, T.StringType(), False) for c in ("kind", "source", "target")])
OCCURRENCES = T.StructType([
    T.StructField("file", T.StringType(), False),
    T.StructField("start", T.LongType(), False),
    T.StructField("end", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType(), False),
])

#: A node's content: runs of text, and between them its children and embeddings; it begins and ends with a run. ``ord`` is of any type that orders.
PART_KINDS = ("run", "child", "embed")

#: Dependency kinds, in their fixed order.
DEPENDENCY_KINDS = ("depends", "embeds", "references")


@dataclass(frozen=True)
class Workspace:
    """nodes: REQUIREMENTS, locations: LOCATIONS, edges: EDGES as a set, occurrences: OCCURRENCES as a bag.

    parts: (identity, ord, kind, text, target), see PART_KINDS; without them,
    a node's text comes first, then what it embeds, then its children.
    own, code: the dependency edges of requirement nodes and those of locations,
    where they are tables of their own; else they are told apart by their sources.
    """

    nodes: DataFrame
    locations: DataFrame
    edges: DataFrame
    occurrences: DataFrame
    parts: DataFrame | None = None
    own: DataFrame | None = None
    code: DataFrame | None = None


_written: list[tuple[DataFrame, str]] = []


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-graph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the folder that all executors share, and read them again.

    Unlike a checkpoint of the rows' RDD, the table keeps its size, which
    joins are planned by, and none of the plan's constraints. ``clear`` removes
    what was written.
    """
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _written.append((kept, path))
    return kept


def clear() -> None:
    """Remove all tables that ``checkpoint`` has written in this process; frames that read them end with it."""
    while _written:
        df, path = _written.pop()
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
