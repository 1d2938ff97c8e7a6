"""Many graphs as one: attributes of nodes and edges folded in the order of the graphs.

Attributes are a map of names to texts (lists and maps as JSON without its outer brackets). Of graphs merged in order a
later one's value of a name wins, names that it lacks stay, and a node or edge keeps the place of its first graph. The fold
is an aggregate by (node, name), so a node of very many graphs is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import batches_of, roots

LISTS = ("answer_chunk_ids", "source_sentences")


def as_text(x: Column) -> Column:
    """A list or map as JSON without the brackets around it."""
    return F.regexp_replace(F.to_json(x), r"^[\[\]]+|[\[\]]+$", "")


def _attributes(triplets: DataFrame, *more: tuple[str, Column]) -> Column:
    """All attributes that a fact gives: lists it doesn't have are empty."""
    lists = [(n, as_text(F.col(n)) if n in triplets.columns else F.lit("")) for n in LISTS]
    own = [("metadata", F.coalesce(as_text(F.col("metadata")), F.lit("{}"))), *lists, *more]
    return F.map_from_arrays(F.array(*(F.lit(n) for n, _ in own)), F.array(*(F.coalesce(v, F.lit("")) for _, v in own)))


def attributed(triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, node_seq, attributes) and edges (graph_id, u, v, edge_seq, attributes) of each graph.

    A node has the attributes of the fact that brought it first: as a head its metadata, as a tail the lists, too. An
    edge has those of its last fact.
    """
    plain = F.map_filter("all", lambda k, _: k == "metadata")
    rows = triplets.withColumn("all", _attributes(triplets))
    ends = rows.select("graph_id", F.col("entity_1").alias("node"), (F.col("seq") * 2).alias("node_seq"), plain.alias("attributes")).unionByName(
        rows.select("graph_id", F.col("entity_2").alias("node"), (F.col("seq") * 2 + 1).alias("node_seq"), F.col("all").alias("attributes"))
    )
    node = ends.groupBy("graph_id", "node").agg(F.min("node_seq").alias("node_seq"), F.min_by("attributes", "node_seq").alias("attributes"))
    own = _attributes(triplets, ("label", F.col("relation")), ("triplet_id", F.col("triplet_id")))
    facts = triplets.select("graph_id", F.col("entity_1").alias("u"), F.col("entity_2").alias("v"), "seq", own.alias("attributes"))
    return node, facts.groupBy("graph_id", "u", "v").agg(F.min("seq").alias("edge_seq"), F.max_by("attributes", "seq").alias("attributes"))


def folded(rows: DataFrame, keys: Sequence[str], order: str, place: str) -> DataFrame:
    """(keys, place, attributes) of rows that repeat their keys once a graph; place becomes (order, place) of the first."""
    parts = rows.select(*keys, F.struct(F.col(order).alias("graph"), F.col(place).alias("at")).alias(place), order, F.explode_outer("attributes").alias("_name", "_value"))
    named = parts.groupBy(*keys, "_name").agg(F.max_by("_value", order).alias("_value"), F.min(place).alias(place))
    held = F.filter(F.array_sort(F.collect_list(F.struct("_name", "_value"))), lambda x: x["_name"].isNotNull())  # one a name
    return named.groupBy(*keys).agg(F.min(place).alias(place), F.map_from_entries(held).alias("attributes"))


def merged(nodes: DataFrame, edges: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graphs of each group as one. groups: graph_id, merged_id, graph_seq, the order in which graphs are merged."""
    node = folded(nodes.join(groups, "graph_id"), ["merged_id", "node"], "graph_seq", "node_seq").withColumnRenamed("merged_id", "graph_id")
    edge = folded(edges.join(groups, "graph_id"), ["merged_id", "u", "v"], "graph_seq", "edge_seq").withColumnRenamed("merged_id", "graph_id")
    return node, edge


def with_center(nodes: DataFrame, edges: DataFrame, groups: DataFrame, center: str, label: str) -> tuple[DataFrame, DataFrame]:
    """merged, with an edge from the root of each graph to a node center, which comes after all others."""
    text = lambda **x: F.map_from_arrays(F.array(*map(F.lit, x)), F.array(*map(F.lit, x.values())))
    last = groups.groupBy("merged_id").agg((F.max("graph_seq") + 1).alias("graph_seq"))
    tops = roots(edges, nodes).join(groups, "graph_id").select("merged_id", F.col("node").alias("u"), F.col("graph_seq").alias("edge_seq"))
    hub = last.select("merged_id", F.lit(center).alias("node"), F.lit(0).cast("long").alias("node_seq"), "graph_seq", text(type="general").alias("attributes"))
    arms = tops.join(last, "merged_id").select("merged_id", "u", F.lit(center).alias("v"), F.col("edge_seq").cast("long"), "graph_seq", text(label=label, type="general_connection").alias("attributes"))
    node = folded(nodes.join(groups, "graph_id").drop("graph_id").unionByName(hub), ["merged_id", "node"], "graph_seq", "node_seq")
    edge = folded(edges.join(groups, "graph_id").drop("graph_id").unionByName(arms), ["merged_id", "u", "v"], "graph_seq", "edge_seq")
    return node.withColumnRenamed("merged_id", "graph_id"), edge.withColumnRenamed("merged_id", "graph_id")


def sector_groups(graphs: DataFrame, companies: DataFrame, size: int = 4, prefix: str = "finance_") -> DataFrame:
    """(graph_id, merged_id, graph_seq) of the companies that have a graph, in batches of a sector, as ``merged`` takes them.

    companies: graph_id, sector, seq. A sector of more than one batch numbers them. Companies without a sector (null) and of sector
    Unknown are left out; an empty sector's name is a name.
    """
    known = companies.where("sector is not null and sector <> 'Unknown'").join(graphs.select("graph_id").distinct(), "graph_id", "left_semi")
    dealt = batches_of(known, ["sector"], "seq", size)
    mark = F.when(F.col("suffix") == "", "").otherwise(F.concat(F.lit("_batch"), "suffix"))
    return dealt.select("graph_id", F.concat(F.lit(prefix), F.replace("sector", F.lit(" "), F.lit("_")), mark).alias("merged_id"), F.col("seq").alias("graph_seq"))
