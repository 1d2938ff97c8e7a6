"""Samples of patterns: of listed ones by hash, of pairs by drawing their numbers from the counted space.

The pairs of a node of n heads are n(n-1)/2, so they are counted, not listed: numbers are drawn without repetition by
a keyed permutation, and only the nodes and the two hops that a drawn number stands for are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import order_key
from lodestone.operators.graph import pair_paths
from lodestone.operators.ranking import hash_bucket, hash_ranked, hash_sample, running

ROUNDS = 4


def permuted(number: Column, half: int, seed: int = 42) -> Column:
    """The image of a number below 4^half under a seeded permutation of these numbers: a Feistel network over two halves of its bits."""
    mask = (1 << half) - 1
    left, right = F.shiftright(number, half), number.bitwiseAND(mask)
    for r in range(ROUNDS):
        mixed = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}|{r}|"), right.cast("string"))), 1, 8), 16, 10).cast("long").bitwiseAND(mask)
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, half) + right


def drawn(spark: SparkSession, total: int, limit: int, seed: int = 42) -> DataFrame:
    """(number): limit different numbers below total, each set of them as likely as any other; all numbers if there are no more."""
    if total <= limit:
        return spark.range(total).toDF("number")
    half = next(h for h in range(1, 32) if 4**h >= total)  # at least a quarter of the images are below total, where total > 1
    size = 8 * limit + 1024
    while True:
        size = min(size, 4**half)
        images = spark.range(size).select("id", permuted(F.col("id"), half, seed).alias("number")).where(F.col("number") < total)
        if size == 4**half or images.count() >= limit:
            return images.orderBy("id").limit(limit).select("number")
        size *= 2


def sampled_pairs(valid: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """At most limit pairs of hops into one node, uniformly from all of them, as paths of ``graph.inverted_stars``.

    A node's hops are numbered in hash order by buckets, so a node of very many heads is no task of its own. A pair's
    number q within its node stands for the hops i < j with q = j(j-1)/2 + i.
    """
    spark = valid.sparkSession
    tails = valid.groupBy("graph_id", "v").agg(F.count("*").alias("heads")).where("heads > 1").withColumn("pairs", F.expr("heads * (heads - 1) div 2"))
    total = tails.agg(F.sum("pairs")).first()[0] or 0
    order = order_key(F.concat_ws("|", "graph_id", "v"), seed)
    placed = running(tails, [], order, hash_bucket(order), {"upto": F.col("pairs")}).withColumn("low", F.col("upto") - F.col("pairs"))
    width = max(1, -(-total // max(1, limit)))
    spans = placed.select("graph_id", "v", "low", "upto", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(upto - 1) div {width}"))).alias("slot"))
    numbers = drawn(spark, total, limit, seed).withColumn("slot", F.expr(f"number div {width}"))
    hits = spans.join(numbers, "slot").where("number >= low and number < upto").withColumn("q", F.col("number") - F.col("low"))
    guess = hits.withColumn("j", F.floor((1 + F.sqrt(1 + 8 * F.col("q"))) / 2))  # right but for the root's rounding
    right = guess.withColumn("j", F.expr("j - if(j * (j - 1) div 2 > q, 1, 0) + if(j * (j + 1) div 2 <= q, 1, 0)"))
    chosen = right.select("graph_id", "v", "number", (F.col("j") + 1).alias("j"), F.expr("q - j * (j - 1) div 2 + 1").alias("i"))
    hops = hash_ranked(valid.join(chosen.select("graph_id", "v").distinct(), ["graph_id", "v"], "left_semi"), ["graph_id", "v"], F.col("u"), seed)
    end = lambda n: hops.select("graph_id", "v", F.col("rank").alias(n), F.struct("u_seq", "edge_seq", "hop").alias(f"hop_{n}"))
    pairs = chosen.join(end("i"), ["graph_id", "v", "i"]).join(end("j"), ["graph_id", "v", "j"])
    return pair_paths(pairs.select("graph_id", F.least("hop_i", "hop_j")["hop"].alias("hop_a"), F.greatest("hop_i", "hop_j")["hop"].alias("hop_b")))


def sampled_paths(paths: DataFrame, limit: int = 30_000, seed: int = 42) -> DataFrame:
    """At most limit paths of each pattern, in a seeded order of their hashes."""
    return hash_sample(paths, ["pattern"], F.col("path_sha1"), limit, seed)
