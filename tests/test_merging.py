import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import merging as m
from lodestone.sources.graphml import read_graphml, write_graphml

FACTS = "graph_id string, entity_1 string, relation string, entity_2 string, triplet_id string, answer_chunk_ids array<string>, metadata map<string,string>, seq long"


def facts(spark):
    rows = [
        ("g1", "a", "r1", "b", "t1", ["c1"], {"cik": "1"}, 0),
        ("g1", "b", "r2", "a", "t2", None, {"cik": "1"}, 1),
        ("g1", "a", "r3", "b", "t3", ["c2", "c3"], {"cik": "1"}, 2),
        ("g2", "b", "r4", "c", "t4", [], {"cik": "2", "x": "y"}, 0),
        ("g2", "c", "r5", "b", "t5", ["c9"], {}, 1),
    ]
    return spark.createDataFrame(rows, FACTS)


def told(df, *keys):
    return {tuple(r[k] for k in keys): r["attributes"] for r in df.collect()}


def test_attributes_of_first_facts_and_last_edges(spark):
    node, edge = m.attributed(facts(spark))
    assert told(node, "graph_id", "node") == {
        ("g1", "a"): {"metadata": '{"cik":"1"}'},
        ("g1", "b"): {"metadata": '{"cik":"1"}', "answer_chunk_ids": '"c1"', "source_sentences": ""},
        ("g2", "b"): {"metadata": '{"cik":"2","x":"y"}'},
        ("g2", "c"): {"metadata": '{"cik":"2","x":"y"}', "answer_chunk_ids": "", "source_sentences": ""},
    }
    assert told(edge, "graph_id", "u", "v")["g1", "a", "b"] == {"metadata": '{"cik":"1"}', "answer_chunk_ids": '"c2","c3"', "source_sentences": "", "label": "r3", "triplet_id": "t3"}


def test_later_graphs_update_and_missing_names_stay(spark):
    node, edge = m.attributed(facts(spark))
    groups = spark.createDataFrame([("g1", "all", 0), ("g2", "all", 1)], "graph_id string, merged_id string, graph_seq long")
    nodes, edges = m.merged(node, edge, groups)
    held = told(nodes, "node")
    assert held["b",] == {"metadata": '{"cik":"2","x":"y"}', "answer_chunk_ids": '"c1"', "source_sentences": ""} and len(held) == 3
    back = groups.withColumn("graph_seq", -F.col("graph_seq"))
    assert told(m.merged(node, edge, back)[0], "node")["b",]["metadata"] == '{"cik":"1"}'
    assert [r["node"] for r in nodes.orderBy("node_seq").collect()] == ["a", "b", "c"]
    nodes, edges = m.with_center(node, edge, groups, "c", "of")  # the center is a node already
    assert told(nodes, "node")["c",]["type"] == "general" and "metadata" in told(nodes, "node")["c",]
    arms = told(edges, "u", "v")
    assert arms["b", "c"]["label"] == "of" and arms["b", "c"]["triplet_id"] == "t4" and arms["a", "c"] == {"label": "of", "type": "general_connection"}
    assert m.merged(node.limit(0), edge.limit(0), groups)[0].count() == 0


def test_batches_of_a_sector(spark):
    graphs = spark.createDataFrame([(f"c{k}",) for k in range(11)], "graph_id string")
    rows = [(f"c{k}", "Real Estate" if k < 6 else "" if k < 8 else "Unknown" if k == 8 else None if k == 9 else "Tech", k) for k in range(13)]
    got = {r["graph_id"]: r["merged_id"] for r in m.sector_groups(graphs, spark.createDataFrame(rows, "graph_id string, sector string, seq long")).collect()}
    assert got == {**{f"c{k}": "finance_Real_Estate_batch_1" for k in range(4)}, "c4": "finance_Real_Estate_batch_2", "c5": "finance_Real_Estate_batch_2", "c6": "finance_", "c7": "finance_", "c10": "finance_Tech"}


def test_graphml_keeps_every_attribute(spark, tmp_path):
    odd = 'é <a> & "b"\n\tc\r  '
    nodes = spark.createDataFrame(
        [("g 1", odd, 0, odd, 5, 1.5, True, ["x", odd], {"k": "v"}), ("g 1", "b", 1, None, None, None, None, None, None), ("h/é", "b", 0, "", -(2**60), 0.1, False, [], {})],
        "graph_id string, node string, node_seq long, `a b` string, n long, x double, ok boolean, items array<string>, metadata map<string,string>",
    )
    edges = spark.createDataFrame([("g 1", odd, "b", 0, "l<", 7), ("h/é", "b", "b", 0, None, None)], "graph_id string, u string, v string, edge_seq long, label string, n int")
    path = str(tmp_path / "g")
    write_graphml(nodes, edges, path)
    node, edge = read_graphml(spark, path)
    assert [f.dataType.simpleString() for f in node.schema.fields][2:] == ["string", "bigint", "double", "boolean", "string", "string"]
    got = {(r["graph_id"], r["node"]): tuple(r)[2:] for r in node.collect()}
    assert got["g 1", odd] == (odd, 5, 1.5, True, '"x",' + '"é <a> & \\"b\\"\\n\\tc\\r  "', '{"k":"v"}')
    assert got["g 1", "b"] == (None,) * 6 and got["h/é", "b"] == ("", -(2**60), 0.1, False, "", "{}")
    assert sorted(map(tuple, edge.collect()), key=str) == sorted([("g 1", odd, "b", "l<", 7), ("h/é", "b", "b", None, None)], key=str)
    for folder in Path(path).glob("graph_id=*"):  # a whole document in the order of its files
        root = ET.fromstring("".join(f.read_text() for f in sorted(folder.glob("part-*"))))
        assert len([x for x in root.iter() if x.tag.endswith("}key")]) == 8


def test_graphml_of_many_files(spark, tmp_path):
    nodes = spark.range(5000).select(F.lit("g").alias("graph_id"), F.concat(F.lit("n"), "id").alias("node"), F.col("id").alias("node_seq"), (F.col("id") * 2).alias("twice"))
    edges = nodes.select("graph_id", F.col("node").alias("u"), F.lit("n0").alias("v"), F.col("node_seq").alias("edge_seq"))
    path = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_graphml(nodes, edges, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(path).glob("graph_id=g/part-*"))
    root = ET.fromstring("".join(f.read_text() for f in files))
    assert len(files) > 1 and [x.get("id") for x in root.iter() if x.tag.endswith("}node")] == [f"n{k}" for k in range(5000)]
    node, edge = read_graphml(spark, path)
    assert node.count() == edge.count() == 5000 and node.agg(F.sum("twice")).first()[0] == 4999 * 5000


def test_graphs_with_other_keys_are_told(spark, tmp_path):
    path = tmp_path / "g"
    for name, kind in (("a", "string"), ("b", "long")):
        (path / f"graph_id={name}").mkdir(parents=True)
        (path / f"graph_id={name}" / "part-0").write_text(f'<graphml>\n<key id="d0" for="node" attr.name="x" attr.type="{kind}"/>\n</graphml>')
    one = tmp_path / "h" / "graph_id=a"
    one.mkdir(parents=True)
    (one / "x.graphml").write_text('<graphml>\n  <key id="d0" for="node" attr.name="x" attr.type="long"/>\n <graph>\n  <node id="a">\n   <data key="d0">5</data>\n  </node>\n  <node id="b"/>\n  <edge source="a" target="b"/></graph></graphml>')
    node, edge = read_graphml(spark, str(tmp_path / "h"), lines=False)
    assert sorted(map(tuple, node.collect())) == [("a", "a", 5), ("a", "b", None)] and [tuple(r) for r in edge.collect()] == [("a", "a", "b")]
    with pytest.raises(ValueError, match="same keys"):
        read_graphml(spark, str(path))
