"""GraphML with all attributes, written and read in the cluster.

Every column of nodes and edges but their ids is an attribute: its key and type come from the schema, nested values are
JSON texts without outer brackets, and null is no data element. A graph's lines are written in order; one too long for a file
goes on in the next, and files joined in the order of their names are the document. An element is a line, so they are read
in parallel, wherever they are split. Characters that XML doesn't have are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.merging import as_text

#: GraphML's names of types, and Spark's; everything else is a string.
KINDS = {"boolean": "boolean", "int": "int", "bigint": "long", "float": "float", "double": "double"}
NODE, EDGE = ("graph_id", "node", "node_seq"), ("graph_id", "u", "v", "edge_seq")


def escaped(x: Column) -> Column:
    x = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return F.coalesce(x, F.lit(""))


def _keys(df: DataFrame, ids: tuple[str, ...], what: str, first: int) -> list[tuple[str, T.StructField, str]]:
    """(key, field, line) of a table's attributes, in the order of the schema."""
    out = []
    for n, field in enumerate((f for f in df.schema.fields if f.name not in ids), first):
        name = field.name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        out.append((f"d{n}", field, f'<key id="d{n}" for="{what}" attr.name="{name}" attr.type="{KINDS.get(field.dataType.simpleString(), "string")}"/>'))
    return out


def _data(keys: list[tuple[str, T.StructField, str]]) -> Column:
    nested = (T.ArrayType, T.MapType, T.StructType)
    text = lambda f: as_text(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")
    return F.concat(F.lit(""), *(F.when(F.col(f"`{f.name}`").isNull(), "").otherwise(F.concat(F.lit(f'<data key="{k}">'), escaped(text(f)), F.lit("</data>"))) for k, f, _ in keys))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, kind, seq, line): each graph's lines; kind and seq order them. seq is node_seq and edge_seq."""
    own, arms = _keys(nodes, NODE, "node", 0), _keys(edges, EDGE, "edge", len([c for c in nodes.columns if c not in NODE]))
    order = lambda df, c: df.schema[c].dataType
    none = F.lit(None).cast(order(nodes, "node_seq"))
    quoted = lambda c: F.concat(F.lit('"'), escaped(F.col(c).cast("string")), F.lit('"'))
    head = "\n".join(['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(line for *_, line in own + arms), '<graph edgedefault="directed">'])
    graphs = nodes.select("graph_id").unionByName(edges.select("graph_id")).distinct()
    out = graphs.select("graph_id", F.lit(0).alias("kind"), none.alias("seq"), F.lit(head).alias("line"))
    out = out.unionByName(nodes.select("graph_id", F.lit(1).alias("kind"), F.col("node_seq").alias("seq"), F.concat(F.lit("<node id="), quoted("node"), F.lit(">"), _data(own), F.lit("</node>")).alias("line")))
    out = out.unionByName(edges.select("graph_id", F.lit(2).alias("kind"), F.col("edge_seq").cast(order(nodes, "node_seq")).alias("seq"), F.concat(F.lit("<edge source="), quoted("u"), F.lit(" target="), quoted("v"), F.lit(">"), _data(arms), F.lit("</edge>")).alias("line")))
    return out.unionByName(graphs.select("graph_id", F.lit(3).alias("kind"), none.alias("seq"), F.lit("</graph></graphml>").alias("line")))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder a graph below path, graph_id=..., with its lines in the order of its files."""
    order = ("graph_id", "kind", "seq", "line")
    lines = graphml(nodes, edges).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("graph_id", "line").write.mode("overwrite").partitionBy("graph_id").text(path)


def _elements(spark: SparkSession, path: str, tag: str, attributes: tuple[str, ...], lines: bool) -> DataFrame:
    data = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())]))
    fields = [*(T.StructField(f"_{a}", T.StringType()) for a in attributes), *([T.StructField("data", data)] if tag != "key" else [])]
    graph = T.StructField("graph_id", T.StringType())
    if not lines:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(T.StructType([*fields, graph])).load(path)
    text = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), graph])).text(path).where(F.startswith("value", F.lit(f"<{tag} ")))
    kept = {"rowTag": tag, "ignoreSurroundingSpaces": "false"}
    return text.select(F.from_xml("value", T.StructType(fields), kept).alias("x"), "graph_id").select("x.*", "graph_id")


def read_graphml(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, ...) and edges (graph_id, u, v, ...) with a typed column for each attribute that the files declare.

    lines: files of ``write_graphml``, an element a line, which Spark splits anywhere; other writers' files are whole documents.
    """
    keys = _elements(spark, path, "key", ("id", "for", "attr.name", "attr.type"), lines).select(F.col("_id").alias("key"), F.col("_for").alias("what"), F.col("`_attr.name`").alias("name"), F.col("`_attr.type`").alias("kind")).distinct()
    told = [r for r in keys.where("key is not null").collect()]  # the attributes' names
    if len({r["key"] for r in told}) < len(told):
        raise ValueError("graphs below one path must declare the same keys")

    def columns(df: DataFrame, what: str) -> list[Column]:
        held = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], F.coalesce(d["_VALUE"], F.lit("")))))
        return [F.try_element_at(held, F.lit(r["key"])).cast({"long": "bigint"}.get(r["kind"], r["kind"])).alias(r["name"]) for r in sorted(told, key=lambda r: (len(r["key"]), r["key"])) if r["what"] == what]

    node, edge = _elements(spark, path, "node", ("id",), lines), _elements(spark, path, "edge", ("source", "target"), lines)
    return node.select("graph_id", F.col("_id").alias("node"), *columns(node, "node")), edge.select("graph_id", F.col("_source").alias("u"), F.col("_target").alias("v"), *columns(edge, "edge"))
