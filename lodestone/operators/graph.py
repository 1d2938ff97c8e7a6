"""Attributed directed graphs from triplets, and path patterns as joins.

triplets: graph_id, entity_1, relation, entity_2, triplet_id, answer_chunk_id, source_sentence, metadata, seq, with
seq the order of arrival. A graph has one edge for a pair of nodes: the last triplet's label wins, the first place
stays. Everything is keyed by graph_id, so graphs never mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_n
from lodestone.operators.tables import last_wins

HOP = ("entity_1", "relation", "entity_2", "triplet_id", "answer_chunk_id", "source_sentence")


def nodes(triplets: DataFrame) -> DataFrame:
    """(graph_id, node, node_seq, metadata): heads before tails of one triplet, the first attributes win."""
    ends = triplets.select("graph_id", F.col("entity_1").alias("node"), (F.col("seq") * 2).alias("node_seq"), "metadata").unionByName(
        triplets.select("graph_id", F.col("entity_2").alias("node"), (F.col("seq") * 2 + 1).alias("node_seq"), "metadata")
    )
    return ends.groupBy("graph_id", "node").agg(F.min("node_seq").alias("node_seq"), F.min_by("metadata", "node_seq").alias("metadata"))


def edges(triplets: DataFrame) -> DataFrame:
    """(graph_id, u, v, label, triplet_id, edge_seq): one edge a pair, the last label and the first place."""
    rows = triplets.select("graph_id", F.col("entity_1").alias("u"), F.col("entity_2").alias("v"), "relation", "triplet_id", "seq")
    last = F.max_by(F.struct("relation", "triplet_id"), "seq")
    return rows.groupBy("graph_id", "u", "v").agg(last.alias("last"), F.min("seq").alias("edge_seq")).select("graph_id", "u", "v", F.col("last.relation").alias("label"), "last.triplet_id", "edge_seq")


def ordered_edges(triplets: DataFrame) -> DataFrame:
    """edges with u_seq, the head's first appearance: edge order is (u_seq, edge_seq)."""
    heads = nodes(triplets).select("graph_id", F.col("node").alias("u"), F.col("node_seq").alias("u_seq"))
    return edges(triplets).join(heads, ["graph_id", "u"])


def degrees(edge: DataFrame) -> DataFrame:
    """(graph_id, node, out_degree, in_degree)."""
    ends = edge.select("graph_id", F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edge.select("graph_id", F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("graph_id", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def roots(edge: DataFrame, node: DataFrame, count: int = 1) -> DataFrame:
    """The count nodes of each graph with most out-edges, the earlier of equals."""
    placed = degrees(edge).join(node, ["graph_id", "node"])
    return top_n(placed, ["graph_id"], [F.desc("out_degree"), F.col("node_seq")], F.col("node"), count).select("graph_id", "node", "out_degree", "rank")


def with_hub(edge: DataFrame, node: DataFrame, hub: str, label: str, merged: str) -> DataFrame:
    """The edges of all graphs as one, with an edge from each graph's root to the hub; later graphs' edges win. ``merging`` has attributes, too."""
    tops = roots(edge, node).where("rank = 1").select(F.lit(merged).alias("graph_id"), F.col("node").alias("u"), F.lit(hub).alias("v"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("triplet_id"))
    own = last_wins(edge.select("u", "v", "label", "triplet_id", F.struct("graph_id", "edge_seq").alias("seq")), ["u", "v"], "seq")
    return own.select(F.lit(merged).alias("graph_id"), "u", "v", "label", "triplet_id").unionByName(tops.distinct())


def batches_of(df: DataFrame, keys: Sequence[str], order: str, size: int = 4) -> DataFrame:
    """df with batch, and suffix: the batch's number where its group has more than one batch."""
    own = Window.partitionBy(*keys)
    placed = df.withColumn("batch", F.floor((F.row_number().over(own.orderBy(order)) - 1) / size))
    return placed.withColumn("suffix", F.when(F.count("*").over(own) > size, F.concat(F.lit("_"), (F.col("batch") + 1).cast("string"))).otherwise(""))


def valid_edges(triplets: DataFrame, edge: DataFrame | None = None, fields: Sequence[str] = HOP) -> DataFrame:
    """Edges whose (head, label, tail) is a triplet, the last of equals, as hops of these fields in edge order.

    Without edge, those of the triplets are meant: a pair's last triplet is the last of its label, too, and nothing is looked up.
    """
    own = ["entity_1", "relation", "entity_2"]
    if edge is None:
        last = F.max_by(F.struct("relation", F.struct(*fields).alias("hop")), "seq")
        rows = triplets.groupBy("graph_id", F.col("entity_1").alias("u"), F.col("entity_2").alias("v")).agg(last.alias("last"), F.min("seq").alias("edge_seq"))
        heads = nodes(triplets).select("graph_id", F.col("node").alias("u"), F.col("node_seq").alias("u_seq"))
        hops = rows.where("v is not null and last.relation is not null").select("graph_id", "u", "v", "edge_seq", "last.hop").join(heads, ["graph_id", "u"])
        return hops.select("graph_id", "u", "v", "u_seq", "edge_seq", "hop")
    known = last_wins(triplets.select("graph_id", *own, *(c for c in fields if c not in own), "seq"), ["graph_id", *own], "seq").drop("seq")
    keys = (F.col("u") == F.col("entity_1")) & (F.col("label") == F.col("relation")) & (F.col("v") == F.col("entity_2"))
    hops = edge.drop("triplet_id").withColumnRenamed("graph_id", "_graph").join(known, (F.col("_graph") == F.col("graph_id")) & keys)
    return hops.select("graph_id", "u", "v", "u_seq", "edge_seq", F.struct(*fields).alias("hop"))


def slim(valid: DataFrame, *fields: str) -> DataFrame:
    """valid with hops of these fields only: patterns shuffle whole hops."""
    return valid.withColumn("hop", F.struct(*(F.col("hop")[c].alias(c) for c in fields)))


def _paths(df: DataFrame, pattern: str, hops: Sequence[Column]) -> DataFrame:
    path = F.array(*hops)
    return df.select("graph_id", F.lit(pattern).alias("pattern"), path.alias("path"), F.sha1(F.array_join(path["triplet_id"], ",")).alias("path_sha1"))


def single_hop(valid: DataFrame, edge: DataFrame) -> DataFrame:
    """Hops into a node without out-edges whose only in-edge they are."""
    leaf = degrees(edge).where("out_degree = 0 and in_degree = 1").select("graph_id", F.col("node").alias("v"))
    return _paths(valid.join(leaf, ["graph_id", "v"], "left_semi"), "single_hop", [F.col("hop")])


def chains(valid: DataFrame, longest: int = 3) -> DataFrame:
    """Walks of 2 to longest hops; nodes may repeat, equal walks of a graph count once."""
    step = valid.select("graph_id", F.col("u").alias("at"), F.col("v").alias("next"), F.col("hop").alias("more"))
    now, out = valid.select("graph_id", F.array("hop").alias("hops"), F.col("v").alias("end")), None
    for n in range(2, longest + 1):
        now = now.withColumnRenamed("graph_id", "g").join(step, (F.col("g") == F.col("graph_id")) & (F.col("end") == F.col("at"))).select("graph_id", F.concat("hops", F.array("more")).alias("hops"), F.col("next").alias("end"))
        found = _paths(now, "chained_multi_hop", [F.col("hops")[i] for i in range(n)])
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["graph_id", "path_sha1"])


def stars(valid: DataFrame, most: int = 4) -> DataFrame:
    """Combinations of 2 to most of each root's first most hops, in their order."""
    own = Window.partitionBy("graph_id", "u").orderBy("edge_seq")
    arms = valid.withColumn("n", F.row_number().over(own)).where(F.col("n") <= most)
    listed = arms.groupBy("graph_id", "u").agg(F.array_sort(F.collect_list(F.struct("n", "hop"))).alias("arms"))  # at most most of them
    hop = lambda i: F.get("arms", F.lit(i))["hop"]
    ways = [F.when(F.size("arms") > way[-1], F.array(*map(hop, way))) for n in range(2, most + 1) for way in combinations(range(most), n)]
    found = listed.select("graph_id", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("path"))
    ids = F.sha1(F.array_join(F.transform("path", lambda h: h["triplet_id"]), ","))
    return found.select("graph_id", F.lit("star_shaped").alias("pattern"), "path", ids.alias("path_sha1")).dropDuplicates(["graph_id", "path_sha1"])


#: Hops on each side of a square of pairs.
SIDE = 2048


def inverted_stars(valid: DataFrame) -> DataFrame:
    """Pairs of hops into one node, in edge order. The pairs are the result: a node of n heads has n(n-1)/2; ``sampling.sampled_pairs`` draws from them unlisted.

    A node's hops are dealt to blocks, and pairs are made in squares of two blocks, a task for some millions. Hops are
    shuffled, pairs aren't: if each hop of a graph has a triplet id of its own, no two of its paths are equal. Only the
    paths of other graphs are compared. Counts of pairs are read first.
    """
    own = valid.groupBy("graph_id", F.col("hop.triplet_id").alias("id")).agg(F.count("*").alias("m"))
    odd = own.where("id is null or m > 1 or contains(id, ',')").select("graph_id").distinct().withColumn("odd", F.lit(True))
    tails = valid.groupBy("graph_id", "v").agg(F.count("*").alias("heads")).where("heads > 1")
    tails = tails.join(odd, "graph_id", "left").select("graph_id", "v", "heads", F.coalesce("odd", F.lit(False)).alias("odd"))
    total, some_odd = tails.agg(F.sum(F.expr("heads * (heads - 1) div 2")), F.max("odd")).first()
    blocks = F.ceil(F.col("heads") / SIDE).cast("int")
    hops = valid.drop("u").join(tails, ["graph_id", "v"]).select("graph_id", "v", "odd", F.struct("u_seq", "edge_seq").alias("place"), "hop", blocks.alias("g"), F.pmod(F.xxhash64("u_seq", "edge_seq"), blocks).cast("int").alias("mine"))
    keys = ["graph_id", "v", "x", "y"]
    a = hops.select("graph_id", "v", "odd", F.col("place").alias("first"), F.col("hop").alias("one"), F.col("mine").alias("x"), F.explode(F.sequence("mine", F.col("g") - 1)).alias("y"))
    b = hops.select("graph_id", "v", F.col("place").alias("second"), F.col("hop").alias("other"), F.explode(F.sequence(F.lit(0), "mine")).alias("x"), F.col("mine").alias("y"))
    tasks = -(-2 * (total or 0) // SIDE**2)
    if tasks > 2:
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys)
    made = a.join(b, keys).where("first < second or (x < y and first > second)")
    pairs = made.select("graph_id", "odd", *(F.when(F.expr("first < second"), F.col(m)).otherwise(F.col(n)).alias(c) for c, m, n in (("hop_a", "one", "other"), ("hop_b", "other", "one"))))
    hop = [F.col("hop_a"), F.col("hop_b")]
    if not some_odd:
        return _paths(pairs, "inverted_star_shaped", hop)
    return _paths(pairs.where("not odd"), "inverted_star_shaped", hop).unionByName(pair_paths(pairs.where("odd")))


def pair_paths(pairs: DataFrame) -> DataFrame:
    """The paths of pairs (graph_id, hop_a, hop_b), equal ones of a graph once."""
    return _paths(pairs, "inverted_star_shaped", [F.col("hop_a"), F.col("hop_b")]).dropDuplicates(["graph_id", "path_sha1"])


def cycles(valid: DataFrame, longest: int | None = None) -> DataFrame:
    """Simple cycles of 3 hops or more, each from its least node: until no walk is left, or up to longest hops."""
    valid = valid.persist()  # every round reads it
    step = valid.select("graph_id", F.col("u").alias("at"), F.col("v").alias("next"), F.col("hop").alias("more"))
    now = valid.where("v > u").select("graph_id", F.col("u").alias("start"), F.array("u", "v").alias("seen"), F.array("hop").alias("hops"), F.col("v").alias("end"))
    out, n = None, 1
    while longest is None or n < longest:
        n += 1
        grown = now.withColumnRenamed("graph_id", "g").join(step, (F.col("g") == F.col("graph_id")) & (F.col("end") == F.col("at"))).where("next >= start")
        grown = grown.select("graph_id", "start", "seen", F.concat("hops", F.array("more")).alias("hops"), F.col("next").alias("end"))
        if n > 2:
            found = _paths(grown.where("end = start"), "cycle_path", [F.col("hops")[i] for i in range(n)])
            out = found if out is None else out.unionByName(found)
        now = grown.where("end <> start and not array_contains(seen, end)").withColumn("seen", F.concat("seen", F.array("end"))).persist()
        if n > 2 and now.isEmpty():
            break
    return out


def distinct_chunks(paths: DataFrame) -> DataFrame:
    """Paths whose hops lie in different chunks."""
    ids = F.transform("path", lambda h: h["answer_chunk_id"])
    return paths.where(F.size(F.array_distinct(ids)) == F.size(ids))


def across_graphs(paths: DataFrame) -> DataFrame:
    """Paths that recur in several graphs once, under the least graph."""
    return paths.groupBy("pattern", "path_sha1").agg(F.min_by(F.struct("graph_id", "path"), "graph_id").alias("row")).select("row.graph_id", "pattern", "row.path", "path_sha1")


def pivots(path: Column, pattern: Column) -> Column:
    """Chains: the tails of all but the last hop; stars: the root; inverted stars: the shared tail."""
    return (
        F.when(pattern == "chained_multi_hop", F.transform(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), lambda h: h["entity_2"]))
        .when(pattern == "star_shaped", F.array(path[0]["entity_1"]))
        .when(pattern == "inverted_star_shaped", F.array(path[0]["entity_2"]))
        .otherwise(F.array().cast("array<string>"))
    )


def question_holds(question: Column, answer: Column, pivot: Column, multi_hop: Column) -> Column:
    """Question and answer aren't empty; of several hops, the question holds neither the answer nor a pivot."""
    leaks = F.contains(question, answer) | F.exists(pivot, lambda p: F.contains(question, p))
    return F.coalesce((question != "") & (answer != "") & ~(multi_hop & leaks), F.lit(False))


def gate(scores: Column, above: int = 2) -> Column:
    """Every dimension's score is above the bound."""
    return F.forall(F.map_values(scores), lambda x: x > above)
