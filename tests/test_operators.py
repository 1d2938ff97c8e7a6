import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation as ev
from lodestone.operators import perturb, retrieval, tables
from lodestone.sources import tables as sources


def test_upsert_keeps_places(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, seq long, v string")
    new = spark.createDataFrame([("b", 9, "z"), ("c", 10, "w")], "k string, seq long, v string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], "seq").collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 10, "w")]


def test_marker_in_the_first_row_leaves_the_last(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, False), ("b", 1, True), ("c", 0, False)], "k string, pos int, m boolean")
    assert sorted((r["k"], r["pos"]) for r in tables.from_marker(df, ["k"], "pos", F.col("m")).collect()) == [("a", 1), ("b", 0), ("b", 1)]


def test_map_union_takes_the_right(spark):
    df = spark.sql("select map('a', 1, 'b', 2) x, map('b', 3) y, cast(null as map<string,int>) z")
    r = df.select(tables.map_union(F.col("x"), F.col("y")).alias("u"), tables.map_union(F.col("x"), F.col("z")).alias("v")).first()
    assert r["u"] == {"a": 1, "b": 3} and r["v"] == {"a": 1, "b": 2}


@pytest.mark.parametrize("metric", retrieval.METRICS)
@pytest.mark.parametrize("block", [4096, 3])
def test_top_k_matches_numpy(spark, metric, block):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(df.where("vec_id < 7"), df, 4, metric, block=block, row_block=25).collect()}
    score = v @ v.T if metric == "dot" else -((v[:, None] - v[None]) ** 2).sum(axis=2) if metric == "l2" else (v @ v.T) / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    for q in range(7):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-round(score[q, i], 6), i))[:4]
        assert [got[q, k] for k in range(1, 5)] == order


def test_top_k_keeps_large_ids_and_needs_no_driver(spark, monkeypatch):
    base = 9007199254740992
    rows = [(base + k, [float(k % 3), 1.0]) for k in range(40)] + [(None, [1.0, 1.0]), (5, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", None)
        found = retrieval.top_k(df.where(f"vec_id <= {base + 1} and vec_id > 5"), df, 3, row_block=7)
    found = found.toPandas()
    assert {q: sorted(g["vec_id"].tolist()) for q, g in found.groupby("query_id")} == {base: [base + 1, base + 2, base + 3], base + 1: [base + 2, base + 5, base + 8]}
    assert len(retrieval.top_k(df.where("vec_id < 0"), df, 3).toPandas()) == 0


def test_candidates_first_accepted_else_first_best(spark):
    rows = [("a", 0, "x", 0.5), ("a", 1, "y", 0.9), ("a", 2, "z", 0.95), ("b", 0, "x", 0.7), ("b", 1, "y", 0.8), ("b", 2, "z", 0.8), ("c", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, attempt int, candidate string, similarity double")
    assert sorted((r["k"], r["candidate"]) for r in perturb.best_candidates(df, ["k"]).collect()) == [("a", "y"), ("b", "y")]
    assert sorted((r["k"], r["candidate"]) for r in perturb.best_candidates(df, ["k"], None).collect()) == [("a", "z"), ("b", "y")]


def test_perturbations_are_seeded_and_small(spark):
    text = "which company  reported the largest increase\nin operating income during the fiscal year."
    rows = [("q1", text), ("q2", None), ("q3", ""), ("q4", "the of a 12 ?!"), ("q5", "Ünïcode, x"), ("q6", " only ")]
    df = spark.createDataFrame(rows, "k string, t string")
    run = lambda seed=42, share=0.1: {r["k"]: r["p"] for r in df.select("k", perturb.character_level(F.col("k"), F.col("t"), seed=seed, share=share).alias("p")).collect()}
    a = run()
    assert a == run() and a["q2"] is None and a["q3"] == "" and a["q4"] == "the of a 12 ?!" and a["q1"] != text and a["q6"] not in (" only ", "")
    changed = [x for x, y in zip(text.split(), a["q1"].split(), strict=True) if x != y]
    assert len(changed) == 1 and changed[0] not in perturb.STOPWORDS and a["q1"].count("  ") == 1 and "\n" in a["q1"]
    assert len({run(seed)["q1"] for seed in range(6)}) > 3
    every = run(share=1.0)["q1"].split()
    assert sum(x != y for x, y in zip(text.split(), every, strict=True)) >= 8 and every[text.split().index("the")] == "the"


def test_slips_are_of_four_kinds(spark):
    letters = {c: set(perturb.neighbours(c)) for c in "abcdefghijklmnopqrstuvwxyz"}
    assert perturb.neighbours("a") == "sqz" and perturb.neighbours("1") == ""
    rows = [(k, "abstract") for k in range(400)]
    got = [r["p"] for r in spark.createDataFrame(rows, "k int, t string").select(perturb.character_level(F.col("k"), F.col("t")).alias("p")).collect()]
    kinds = set()
    for p in got:
        if len(p) == 7:
            assert any("abstract"[:i] + "abstract"[i + 1 :] == p for i in range(8))
            kinds.add("delete")
            continue
        odd = [i for i in range(8) if p[i] != "abstract"[i]]
        if len(odd) == 2:
            assert odd[1] == odd[0] + 1 and sorted(p) == sorted("abstract")
            kinds.add("swap")
        else:
            (i,) = odd
            assert p[i] in letters["abstract"[i]] or p[i] == perturb.HOMOGLYPHS["abstract"[i]]
            kinds.add("keyboard" if p[i] in letters["abstract"[i]] else "homoglyph")
    assert kinds == {"delete", "swap", "keyboard", "homoglyph"}


def test_words_give_way_to_near_ones(spark):
    df = spark.createDataFrame([("q1", 'which  "Company," company? the firm.'), ("q2", None), ("q3", "nothing known here")], "k string, t string")
    near = spark.createDataFrame([("company", ["firm"]), ("firm", ["house", "company"]), ("the", ["that"]), ("known", [])], "word string, options array<string>")
    got = {r["k"]: r["perturbed"] for r in perturb.word_level(df, "k", "t", near, share=1.0).collect()}
    assert got["q1"] in (f'which  "Company," firm? the {w}.' for w in ("house", "company")) and got["q2"] is None and got["q3"] == "nothing known here"
    assert perturb.word_level(df.limit(0), "k", "t", near).count() == 0


def test_items_of_one_record(spark):
    qa = spark.createDataFrame([("r", "q", "a")], "record_id string, question string, answer string")
    variants = spark.createDataFrame([("r", v, "q") for v in ("original", "b", "c", "d", "e")], "record_id string, query_variant string, query string")
    docs = spark.createDataFrame([("r", k, ["x"]) for k in ("truth", "regex", "back")], "record_id string, kind string, docs array<string>")
    found = spark.createDataFrame([("r", n, v, ["x"]) for n in "xyz" for v in ("original", "b", "c", "d", "e")], "record_id string, retriever string, query_variant string, docs array<string>")
    items = ev.work_items(qa, variants, docs, found)
    assert items.count() == 31 and items.select("item_id").distinct().count() == 31
    bare = docs.withColumn("docs", F.array().cast("array<string>"))
    assert ev.work_items(qa, variants, bare, found).count() == 21


def test_metrics_are_means_over_scores(spark):
    rows = [("m", "r", "original", "real-world-docs", n, bool(i % k), True, False, False, "") for n, k in (("a", 2), ("b", 3)) for i in range(k)]
    details = spark.createDataFrame(rows, "model string, record_id string, query_variant string, doc_variant_type string, retriever string, robust boolean, is_correct boolean, returns_no_info boolean, can_answer_without boolean, response_preview string")
    got = {r["metric"]: r["value"] for r in ev.robustness(details).collect()}
    assert got["real_robustness_a"] == 0.5 and got["real_robustness_b"] == 0.666667 and got["real_robustness"] == 0.6
    assert got["query_robustness"] == 0.0 and all(0 <= v <= 1 for v in got.values())


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"chunk_id": "c1", "text": "x", "metadata": {"k": "v"}}, {"chunk_id": "c2", "text": null}]')
    (tmp_path / "b.jsonl").write_text('{"chunk_id": "c3", "text": "y"}\nbroken\n')
    assert [r["chunk_id"] for r in sources.read_records(spark, str(tmp_path / "a.json"), sources.CHUNK).orderBy("chunk_id").collect()] == ["c1", "c2"]
    assert sources.read_records(spark, str(tmp_path / "b.jsonl"), sources.CHUNK, lines=True).where("chunk_id is not null").count() == 1
    assert sources.read_records(spark, str(tmp_path / "none"), sources.CHUNK).count() == 0
    (tmp_path / "blocks.json").write_text('[{"type": "text", "text": "a", "page_idx": 1}, {"type": "table", "table_body": "<table>"}]')
    assert [(r["pos"], r["type"]) for r in sources.read_blocks(spark, str(tmp_path / "blocks.json")).orderBy("pos").collect()] == [(0, "text"), (1, "table")]
    (tmp_path / "index.csv").write_text("0007|Co|10-K|2020-01-01|a.txt|a-index.html\n8|Other|8-K|2020-01-01|b.txt|b-index.html\n")
    rows = sources.read_filing_index(spark, [str(tmp_path / "index.csv")], ["10-K"], ["7"], "https://x/").collect()
    assert [(r["Company"], r["html_index"]) for r in rows] == [("Co", "https://x/a-index.html")]


def test_graph_round_trip(spark, tmp_path):
    from lodestone.operators import graph as g
    from tests.test_graph import facts

    t = facts(spark, [("a", "r<", "b"), ("b", "s", "c")])
    sources.save_graph(g.nodes(t), g.edges(t), str(tmp_path / "g"))
    nodes, edges = sources.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 3 and sorted(r["label"] for r in edges.collect()) == ["r<", "s"]


def test_sentence_deletion_by_pair(spark):
    pairs = spark.createDataFrame([(["c1", "gone"], ["One. "])], "answer_chunk_ids array<string>, source_sentences array<string>")
    chunks = spark.createDataFrame([("c1", "one. Two. ONE. ")], "chunk_id string, text string")
    assert sorted((r["pos"], r["text"]) for r in perturb.without_sentences(pairs, chunks).collect()) == [(0, "Two. "), (1, "")]


def test_word_budget(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "income", "x", "statement", "of"]) for _ in range(rng.randint(0, 40)))) for k in range(50)]
    got = spark.createDataFrame(rows, "k int, t string").select("t", perturb.character_level(F.col("k"), F.col("t")).alias("p")).collect()
    for r in got:
        assert sum(a != b for a, b in zip(r["t"].split(), r["p"].split(), strict=True)) <= max(1, int(0.1 * len(r["t"].split()) + 0.5))
