import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import graph as g
from lodestone.operators.relations import canonical, leaders

SCHEMA = "graph_id string, entity_1 string, relation string, entity_2 string, triplet_id string, answer_chunk_id string, source_sentence string, metadata map<string,string>, seq long"


def facts(spark, rows, graph="g"):
    return spark.createDataFrame([(graph, a, r, b, f"t{i}", f"c{i % 3}", "", {}, i) for i, (a, r, b) in enumerate(rows)], SCHEMA)


def ids(paths):
    return sorted(",".join(h["triplet_id"] for h in r["path"]) for r in paths.collect())


def mined(spark, rows):
    t = facts(spark, rows)
    edge = g.ordered_edges(t)
    return g.valid_edges(t, edge), edge


def test_last_label_wins_and_hides_the_first_triplet(spark):
    t = facts(spark, [("a", "x", "b"), ("a", "y", "b"), ("b", "z", "c")])
    assert sorted((r["u"], r["v"], r["label"], r["triplet_id"]) for r in g.edges(t).collect()) == [("a", "b", "y", "t1"), ("b", "c", "z", "t2")]
    valid, _ = mined(spark, [("a", "x", "b"), ("a", "y", "b"), ("b", "z", "c")])
    assert ids(g.chains(valid)) == ["t1,t2"]


def test_duplicate_keys_take_the_last_triplet(spark):
    valid, edge = mined(spark, [("a", "x", "b"), ("a", "x", "b")])
    assert ids(g.single_hop(valid, edge)) == ["t1"]


def test_single_hop_needs_a_leaf_with_one_edge(spark):
    valid, edge = mined(spark, [("a", "r", "b"), ("a", "r", "c"), ("b", "r", "c"), ("c", "r", "d"), ("e", "r", "f")])
    assert ids(g.single_hop(valid, edge)) == ["t3", "t4"]


def test_chains_may_return(spark):
    valid, _ = mined(spark, [("a", "r", "b"), ("b", "r", "a")])
    assert ids(g.chains(valid)) == ["t0,t1", "t0,t1,t0", "t1,t0", "t1,t0,t1"]


def test_star_sizes(spark):
    for arms, want in ((1, 0), (2, 1), (4, 11), (6, 11)):
        valid, _ = mined(spark, [("root", "r", f"n{i}") for i in range(arms)])
        assert g.stars(valid).count() == want


def test_inverted_star_sizes(spark):
    for heads, want in ((1, 0), (2, 1), (3, 3)):
        valid, _ = mined(spark, [(f"n{i}", "r", "tail") for i in range(heads)])
        assert g.inverted_stars(valid).count() == want


def test_pairs_of_hops_are_not_shuffled(spark, monkeypatch):
    rows = [(f"n{i}", "r", f"tail{i % 2}") for i in range(23)] + [(f"n{i}", "r", "tail0") for i in range(1, 9, 2)]
    valid, _ = mined(spark, rows)
    own = {}
    for k, (_, _, tail) in enumerate(rows):
        own.setdefault(tail, []).append(k)
    heads = {k: int(rows[k][0][1:]) for k in range(len(rows))}
    want = sorted(",".join(f"t{k}" for k in sorted(pair, key=lambda k: (heads[k], k))) for ks in own.values() for pair in itertools.combinations(ks, 2))
    for side in (2048, 3):  # one square a tail; several
        monkeypatch.setattr(g, "SIDE", side)
        paths = g.inverted_stars(valid)
        assert ids(paths) == want
        assert not any("path_sha1" in line for line in paths._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)


def test_pivots_shuffle_chains_and_stars_only(spark):
    from lodestone.plans.catalog_graph import QUERIES

    plan = QUERIES["pivots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(" in line and "path_sha1" in line for line in plan.splitlines()) == 2


def test_pivots_shuffle_only_fields_of_the_result(spark):
    from lodestone.plans.catalog_graph import QUERIES

    todo, kinds = [QUERIES["pivots"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().initialPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            kinds += [node.output().apply(i).dataType().catalogString() for i in range(node.output().size())]
    hops = [k for k in kinds if "triplet_id" in k]
    assert hops and not [k for k in hops if "source_sentence" in k or "relation" in k or "answer_chunk_id" in k]


def test_inverted_star_shuffles_only_ids_of_hops(spark, monkeypatch):
    from lodestone.plans.catalog_graph import QUERIES

    monkeypatch.setattr(g, "SIDE", 4)  # several squares
    todo, kinds = [QUERIES["inverted_star"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().initialPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            kinds += [node.output().apply(i).dataType().catalogString() for i in range(node.output().size())]
    assert {k for k in kinds if "triplet_id" in k} == {"struct<triplet_id:string>"}


def test_edges_of_the_triplets_are_valid_without_a_lookup(spark):
    rows = [("a", "x", "b"), ("a", "y", "b"), ("a", "x", "b"), ("b", "x", "c"), ("b", None, "c"), ("c", None, "d"), ("c", "x", "d"), ("e", "x", None), (None, "x", "e"), ("d", "x", "d"), ("d", "y", "a")]
    t = facts(spark, rows).unionByName(facts(spark, [("a", "x", "b"), ("a", "x", "b")], "h"))
    looked_up = sorted(map(str, g.valid_edges(t, g.ordered_edges(t)).collect()))
    assert sorted(map(str, g.valid_edges(t).collect())) == looked_up and len(looked_up) == 5
    slim = g.valid_edges(t, fields=["triplet_id"])
    assert sorted(map(str, slim.collect())) == sorted(map(str, g.slim(g.valid_edges(t, g.ordered_edges(t)), "triplet_id").collect()))


def test_equal_pairs_of_a_graph_count_once(spark, monkeypatch):
    """Ids that repeat, lack or hold a comma make paths of one name; a graph beside them has none."""
    names = {0: "a", 1: "b", 2: "a", 3: "b", 4: None, 5: "a,b", 6: "c"}
    odd = facts(spark, [(f"n{i}", "r", f"tail{i // 2}") for i in range(8)], "odd")
    named = F.create_map(*(F.lit(x) for i, n in names.items() if n for x in (f"t{i}", n)))
    odd = odd.withColumn("triplet_id", F.when(F.col("triplet_id") == "t4", F.lit(None)).otherwise(F.coalesce(named[F.col("triplet_id")], "triplet_id")))
    t = odd.unionByName(facts(spark, [(f"n{i}", "r", "tail") for i in range(4)], "plain"))
    for side in (2048, 2):
        monkeypatch.setattr(g, "SIDE", side)
        got = [(r["graph_id"], ",".join(h["triplet_id"] for h in r["path"] if h["triplet_id"])) for r in g.inverted_stars(g.valid_edges(t)).collect()]
        plain = [("plain", f"t{i},t{j}") for i, j in itertools.combinations(range(4), 2)]
        assert sorted(got) == sorted([("odd", "a,b"), ("odd", "c,t7"), *plain])


def test_cycles_of_any_length(spark):
    valid, _ = mined(spark, [*((f"n{i}", "r", f"n{(i + 1) % 8}") for i in range(8)), ("n3", "r", "n0"), ("n7", "r", "leaf")])
    assert ids(g.cycles(valid)) == ["t0,t1,t2,t3,t4,t5,t6,t7", "t0,t1,t2,t8"]
    assert ids(g.cycles(valid, 6)) == ["t0,t1,t2,t8"]


def test_cycles_once_each(spark):
    valid, _ = mined(spark, [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("b", "r", "a"), ("a", "r", "a")])
    assert ids(g.cycles(valid)) == ["t0,t1,t2"]


def test_hub_counts_in_degrees_and_never_matches(spark):
    t = facts(spark, [("a", "r", "b"), ("a", "r", "c")])
    hub = g.with_hub(g.edges(t), g.nodes(t), "hub", "holds", "all")
    assert sorted((r["u"], r["v"], r["triplet_id"]) for r in hub.collect()) == [("a", "b", "t0"), ("a", "c", "t1"), ("a", "hub", None)]


def test_graphs_stay_apart_and_can_be_joined(spark):
    t = facts(spark, [("a", "r", "b")], "g1").unionByName(facts(spark, [("b", "r", "c")], "g2"))
    edge = g.ordered_edges(t)
    assert g.chains(g.valid_edges(t, edge)).count() == 0
    both = facts(spark, [("a", "r", "b"), ("b", "r", "c")], "g1").unionByName(facts(spark, [("a", "r", "b"), ("b", "r", "c")], "g2"))
    paths = g.chains(g.valid_edges(both, g.ordered_edges(both)))
    assert paths.count() == 2 and g.across_graphs(paths).count() == 1


def test_pivots_and_validity(spark):
    valid, _ = mined(spark, [("a", "r", "b"), ("b", "r", "c"), ("a", "r", "c")])
    paths = g.chains(valid, 2).unionByName(g.stars(valid)).unionByName(g.inverted_stars(valid))
    got = {r["pattern"]: list(r["p"]) for r in paths.select("pattern", g.pivots(F.col("path"), F.col("pattern")).alias("p")).collect()}
    assert got == {"chained_multi_hop": ["b"], "star_shaped": ["a"], "inverted_star_shaped": ["c"]}
    df = spark.createDataFrame([("q b", "x", True), ("q", "x", True), ("q x", "x", True), ("q x", "x", False), ("", "x", False)], "q string, a string, m boolean")
    assert [r["h"] for r in df.select(g.question_holds(F.col("q"), F.col("a"), F.array(F.lit("b")), F.col("m")).alias("h")).collect()] == [False, True, False, True, False]


def test_blocks_give_what_the_fold_gives(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((160, 4)), 1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x[40:60] = x[3]
    scope = ["big" if i < 110 else None if i < 130 else f"s{i % 7}" for i in range(160)]
    rows = [(scope[i], f"r{i}", x[i].tolist(), 1000 - 3 * i) for i in range(160)] + [("big", "r5", [9.0] * 4, 5000)]
    df = spark.createDataFrame(rows, "scope string, relation string, vector array<double>, seq long")
    want = {}
    for s in set(scope):
        own = [i for i in reversed(range(160)) if scope[i] == s]
        held = []  # one by one, in the order of seq
        for i in own:
            near = [(round(float(x[j] @ x[i]), 9), -n, j) for n, j in enumerate(held)]
            best = max(near, default=(-9, 0, 0))
            if best[0] > 0.7:
                want[s, f"r{i}"] = f"r{best[2]}"
            else:
                held.append(i)
                want[s, f"r{i}"] = f"r{i}"
    for block in (16, 4096):
        got = {(r["scope"], r["relation"]): r["leader"] for r in canonical(df, 0.7, block).collect()}
        assert got == want and 20 < len(set(got.values())) < 140
    assert canonical(df.limit(0)).count() == 0


def test_relations_follow_their_leaders(spark):
    v = np.array([[1.0, 0.0], [0.9, 0.0], [0.95, 0.3], [0.0, 1.0]])
    assert leaders(v, 0.9).tolist() == [0, 1, 0, 3]  # exactly at the bound leads itself
    rows = [("s", f"r{i}", [float(x) for x in v[i]], i) for i in range(4)] + [("s", "r2", [0.0, 0.0], 9)]
    got = {r["relation"]: r["leader"] for r in canonical(spark.createDataFrame(rows, "scope string, relation string, vector array<double>, seq long")).collect()}
    assert got == {"r0": "r0", "r1": "r1", "r2": "r0", "r3": "r3"}


def test_order_of_input_does_not_matter(spark):
    rows = [("a", "r", "b"), ("b", "r", "c"), ("a", "s", "b"), ("a", "r", "c"), ("c", "r", "d")]
    t = facts(spark, rows)
    for order in itertools.islice(itertools.permutations(t.collect()), 0, 120, 60):
        shuffled = spark.createDataFrame(list(order), t.schema)
        assert ids(g.chains(g.valid_edges(shuffled))) == ids(g.chains(g.valid_edges(t)))
