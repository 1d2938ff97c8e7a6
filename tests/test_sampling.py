import time
from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import graph as g
from lodestone.operators import sampling


def star(spark, heads, graph="g", node="hub"):
    """heads hops into one node."""
    x = F.concat(F.lit(f"{graph}{node}"), F.col("id").cast("string"))
    hop = F.struct(x.alias("entity_1"), F.lit("r").alias("relation"), F.lit(node).alias("entity_2"), F.concat(F.lit("t"), x).alias("triplet_id"), F.lit("c").alias("answer_chunk_id"), F.lit("").alias("source_sentence"))
    return spark.range(heads).select(F.lit(graph).alias("graph_id"), x.alias("u"), F.lit(node).alias("v"), F.col("id").alias("u_seq"), (F.col("id") * 7 % 1000003).alias("edge_seq"), hop.alias("hop"))


def keys(paths):
    return [(r["graph_id"], ",".join(h["triplet_id"] for h in r["path"])) for r in paths.collect()]


def test_numbers_are_a_permutation(spark):
    for half in (1, 2, 3, 5):
        got = [r[0] for r in spark.range(4**half).select(sampling.permuted(F.col("id"), half, 7)).collect()]
        assert sorted(got) == list(range(4**half))
    for total, limit in ((0, 5), (1, 5), (5, 5), (6, 5), (1000, 999), (1000, 10), (10**12, 300)):
        got = [r[0] for r in sampling.drawn(spark, total, limit).collect()]
        assert len(got) == len(set(got)) == min(total, limit) and all(0 <= x < total for x in got)


def test_all_pairs_where_the_limit_allows(spark):
    valid = star(spark, 9).unionByName(star(spark, 4, node="b")).unionByName(star(spark, 3, graph="h")).unionByName(star(spark, 1, node="alone"))
    every = keys(g.inverted_stars(valid))
    assert len(every) == 36 + 6 + 3
    assert sorted(keys(sampling.sampled_pairs(valid, 100))) == sorted(every)
    some = keys(sampling.sampled_pairs(valid, 20))
    assert len(set(some)) == 20 and set(some) <= set(every)
    assert sorted(some) == sorted(keys(sampling.sampled_pairs(valid.repartition(3), 20)))
    assert sampling.sampled_pairs(valid.limit(0), 5).count() == 0


def test_pairs_are_drawn_uniformly(spark):
    valid = star(spark, 7).unionByName(star(spark, 4, node="b")).cache()
    held = Counter(x for seed in range(5) for x in keys(sampling.sampled_pairs(valid, 9, seed)))
    assert sum(held.values()) == 45 and len(held) >= 17  # of 27 pairs
    assert max(held.values()) <= 6


def test_a_tail_of_a_million_heads(spark):
    began = time.time()
    found = sampling.sampled_pairs(star(spark, 1_000_000), 30_000)
    rows = found.select(F.col("path")[0]["triplet_id"].alias("a"), F.col("path")[1]["triplet_id"].alias("b")).collect()
    assert len(rows) == 30_000 == len({(r["a"], r["b"]) for r in rows}) and time.time() - began < 60
    number = lambda x: int(x[5:])
    assert all(number(r["a"]) < number(r["b"]) for r in rows)
    low = sum(number(r["a"]) < 500_000 for r in rows)
    assert 0.72 < low / 30_000 < 0.78  # the lesser of two of a million is in the lower half three times of four


def test_paths_of_each_pattern(spark):
    paths = spark.createDataFrame([("a", f"{k:03d}") for k in range(50)] + [("b", f"{k}") for k in range(3)], "pattern string, path_sha1 string")
    assert Counter(r["pattern"] for r in sampling.sampled_paths(paths, 10).collect()) == {"a": 10, "b": 3}
