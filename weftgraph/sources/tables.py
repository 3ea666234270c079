"""Projection of the relational tables onto a workspace.

Regions are documents, nations their sections and customers those of nations;
brands are documents of parts, and suppliers one more; orders are code files
whose units are the order lines. Customers depend on the parts they ordered,
parts embed their suppliers, and order lines reference parts and embed suppliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators import hashes
from weftgraph.schema import Workspace

FAR = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brand_path(brand: Column) -> Column:
    return F.concat(F.lit("parts/"), F.replace(brand, F.lit("#"), F.lit("_")), F.lit(".mdx"))


def _text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(value).cast("string")


def _node(rows: DataFrame, path: Column, id=None, parent=None, depth: int = 0, ord=-1, coverage=None, tags=None, text=None) -> DataFrame:
    id = None if id is None else id
    return rows.select(
        (path if id is None else F.concat(path, F.lit("#"), id)).alias("identity"),
        path.alias("path"),
        _text(id).alias("id"),
        F.lit(id is None).alias("is_root"),
        _text(parent).alias("parent"),
        F.lit(depth).alias("depth"),
        (ord if isinstance(ord, Column) else F.lit(ord)).cast("long").alias("doc_ord"),
        _text(coverage).alias("coverage"),
        (tags if tags is not None else F.lit(None)).cast("array<string>").alias("tags"),
        _text(text).alias("own_text"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    none = F.array().cast("array<string>")
    region, nation, customer, part, supplier = map(t, ("region", "nation", "customer", "part", "supplier"))
    geo = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).withColumn("geo", F.concat(F.lit("geo/"), "r_name", F.lit(".mdx")))
    n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    people = customer.join(F.broadcast(geo), customer["c_nationkey"] == geo["n_nationkey"])
    c = F.concat(n, F.lit(".c"), F.col("c_custkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    s = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    sup = F.lit("sup.mdx")
    kept = F.when(F.col("p_size") % 7 == 0, "none").otherwise("required")
    words = F.array_sort(F.array_distinct(F.split("p_type", " ")))
    parts = [
        _node(region, F.concat(F.lit("geo/"), "r_name", F.lit(".mdx")), text=F.col("r_name")),
        _node(geo, F.col("geo"), n, F.col("geo"), 1, F.col("n_nationkey").cast("long") * FAR, "required", none, F.col("n_name")),
        _node(people, F.col("geo"), c, F.concat("geo", F.lit("#"), n), 2, F.col("n_nationkey").cast("long") * FAR + F.col("c_custkey") + 1, "required", F.array("c_mktsegment"), F.col("c_name")),
        _node(part.select("p_brand").distinct(), brand_path(F.col("p_brand")), text=F.col("p_brand")),
        _node(part, brand_path(F.col("p_brand")), p, brand_path(F.col("p_brand")), 1, F.col("p_partkey") + 1, kept, words, F.col("p_name")),
        _node(supplier.limit(1), sup, text="suppliers"),
        _node(supplier, sup, s, sup, 1, F.col("s_suppkey") + 1, "required", none, F.col("s_name")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their unit identity: repeated chains get ``@N`` from the second on, in the order of all columns."""
    line = table(spark, sf_dir, "lineitem").select(*LINE)
    number = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE[2:]))
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("@"), F.col("n").cast("string"))).otherwise(F.lit(""))
    path = F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit(".ts"))
    unit = F.concat(F.lit("l"), F.col("l_linenumber").cast("string"), suffix)
    return line.withColumn("n", number).withColumn("path", path).withColumn("unit", unit).withColumn("identity", F.concat("path", F.lit("#"), "unit"))


def part_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.concat(brand_path(F.col("p_brand")), F.lit("#p"), F.col("p_partkey").cast("string")).alias("part"))


def customer_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    geo = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
    named = customer.join(F.broadcast(geo), customer["c_nationkey"] == geo["n_nationkey"])
    return named.select("c_custkey", F.concat(F.lit("geo/"), "r_name", F.lit(".mdx#n"), F.col("n_nationkey").cast("string"), F.lit(".c"), F.col("c_custkey").cast("string")).alias("customer"))


def supplier_identity() -> Column:
    return F.concat(F.lit("sup.mdx#s"), F.col("l_suppkey").cast("string"))


def references(spark: SparkSession, sf_dir: str, code: bool = True) -> DataFrame:
    """The dependency-kind edges (kind, source, target), those of code on demand."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # ids are made for distinct key pairs only, which lie by the key that is joined next
    bought = line.join(order, line["l_orderkey"] == order["o_orderkey"]).select("o_custkey", "l_partkey").repartition("o_custkey").distinct()
    parts, people = part_identity(spark, sf_dir), customer_identity(spark, sf_dir)
    depends = bought.join(people, bought["o_custkey"] == people["c_custkey"]).join(parts, F.col("l_partkey") == parts["p_partkey"])
    supplied = line.select("l_partkey", "l_suppkey").repartition("l_partkey").distinct().join(parts, F.col("l_partkey") == parts["p_partkey"])
    own = (
        depends.select(F.lit("depends").alias("kind"), F.col("customer").alias("source"), F.col("part").alias("target"))
        .unionByName(supplied.select(F.lit("embeds").alias("kind"), F.col("part").alias("source"), supplier_identity().alias("target")))
    )
    return own.unionByName(code_references(spark, sf_dir)) if code else own


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit, parts = units(spark, sf_dir), part_identity(spark, sf_dir)
    named = unit.join(parts, unit["l_partkey"] == parts["p_partkey"])
    both = F.explode(F.array(F.struct(F.lit("references").alias("kind"), F.col("part").alias("target")), F.struct(F.lit("embeds").alias("kind"), supplier_identity().alias("target"))))
    return named.select("identity", both.alias("e")).select("e.kind", F.col("identity").alias("source"), "e.target")


def parts(nodes_: DataFrame, edges: DataFrame, own: bool = False) -> DataFrame:
    """Content of the projected documents: after a child its first tag, after an embedding a slash. own: the edges are of these nodes only."""
    return hashes.plain_parts(nodes_, edges, own, F.get("tags", F.lit(0)), "/")


def contains(nodes_: DataFrame) -> DataFrame:
    return nodes_.filter("parent IS NOT NULL").select(F.lit("contains").alias("kind"), F.col("parent").alias("source"), F.col("identity").alias("target"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per order line and part: a position is the line's number and place among lines of that number."""
    unit, parts = units(spark, sf_dir), part_identity(spark, sf_dir)
    start = (F.col("l_linenumber") * 1000 + F.col("n") * 10).cast("long")
    named = unit.join(parts, unit["l_partkey"] == parts["p_partkey"])
    return named.select(F.col("path").alias("file"), start.alias("start"), (start + 9).alias("end"), F.lit("references").alias("kind"), F.col("identity").alias("source"), F.col("part").alias("target"))


def project(spark: SparkSession, sf_dir: str, code: bool = True) -> Workspace:
    """The workspace; without code, only the documents' nodes and edges, which is all that searches and hashes among them need."""
    own = nodes(spark, sf_dir)
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("path"))
    places = files.select(F.col("path").alias("identity"), "path", F.lit(None).cast("string").alias("unit")).unionByName(units(spark, sf_dir).select("identity", "path", "unit"))
    return Workspace(own, places, contains(own).unionByName(references(spark, sf_dir, code)), occurrences(spark, sf_dir))
