import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import prompts
from lodestone.functions.text import clean_text, rejoin_headings
from lodestone.operators import backends, filings
from lodestone.operators import records as rec


def test_processed_triplets(spark):
    chunks = spark.createDataFrame([(1, "c0", 0, "First text.\n\nMore of it"), (1, "c1", 1, "Acme sells nails. First text."), (2, "d0", 0, "other")], "doc_id int, chunk_id string, pos int, text string")
    raw = [(1, 5, "p", "ACME Inc.", "Sells ", "Nails", "acme sells NAILS."), (1, 7, "p", "x", "r", "y", "not there"), (1, 9, "p", "x", "r", "y", ""), (1, 11, "p", "A  B", "vends", "z Co.", "first text."), (1, 12, "p", "q", "r", "y", "first text. more"), (2, 1, "q", "x", "r", "y", "acme sells"), (2, 2, "q", "x", "r", "y", None)]
    raw = spark.createDataFrame(raw, "doc_id int, seq int, prefix string, entity_1 string, relation string, entity_2 string, source_sentence string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    names = spark.createDataFrame([(1, "vends", "sells"), (2, "r", "other")], "scope int, relation string, leader string")
    got = [(r["triplet_id"], r["entity_1"], r["relation"], r["entity_2"], r["answer_chunk_id"]) for r in rec.processed_triplets(raw, chunks, names).orderBy("triplet_id").collect()]
    assert got == [("p_triplet_0", "acme", "sells", "nails", "c1"), ("p_triplet_3", "a b", "sells", "z", "c0"), ("p_triplet_4", "q", "r", "y", "c0")]
    assert rec.processed_triplets(raw, chunks.limit(0)).count() == 0
    finance = raw.select(rec.triplet_prefix("finance", F.create_map(F.lit("domain"), F.lit("f"), F.lit("cik"), F.lit("7"))).alias("x")).first()["x"]
    assert finance == "f_7_"


def test_survey_headers_and_captions(spark):
    lines = spark.createDataFrame([("a", 0, "x"), ("a", 1, "OECD Economic Surveys: New Land 2019: part"), ("a", 2, "OECD Economic Surveys: Old 1999"), ("b", 0, "none"), ("c", 0, "OECD Economic Surveys: no year"), ("d", 0, None)], "file string, pos int, text string")
    assert [tuple(r) for r in rec.survey_headers(lines, "file", "pos", "text").collect()] == [("a", "New Land 2019", "2019", "New Land")]
    blocks = [("text", "Table 1"), ("text", "of things"), ("table", None), ("text", "y" * 101), ("text", "short"), ("table", None), ("text", "Table 2"), ("text", "Table 2 again"), ("table", None), ("table", None), ("image", None), ("table", None)]
    df = spark.createDataFrame([("f", i, k, x) for i, (k, x) in enumerate(blocks)], "doc_id string, pos int, type string, text string")
    got = {r["pos"]: r["caption"] for r in rec.caption_above(df, "doc_id", "pos").collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {2: "Table 1 of things", 8: "Table 2 again"}


def test_join_back_and_groups(spark):
    qa = spark.createDataFrame([("r", ["b", "a", "b", "zz"], ["s"]), ("t", [], ["s"]), ("u", None, None), ("v", ["a"], ["other"])], "record_id string, answer_chunk_ids array<string>, source_sentences array<string>")
    texts = spark.createDataFrame([("a", "A"), ("b", "B")], "chunk_id string, text string")
    pairs = spark.createDataFrame([(["b", "a", "b", "zz"], ["s"], ["x", "y"])], "answer_chunk_ids array<string>, source_sentences array<string>, docs array<string>")
    got = {r["record_id"]: (r["back_translation"], r["regex_delete"]) for r in rec.documents_joined_back(qa, texts, pairs).collect()}
    assert got == {"r": (["B", "A", "B"], ["x", "y"]), "t": (None, None), "u": (None, None), "v": (["A"], [])}
    assert rec.spread_over_chunks(qa).count() == 1
    rows = spark.createDataFrame([("f", 1, "k"), ("f", 0, None), ("g", 3, "m"), ("g", 4, "")], "file string, pos int, k string")
    assert {(r["file"], r["group"]) for r in rec.keyed_by_first(rows, "file", "pos", F.col("k")).collect()} == {("f", "unknown"), ("g", "m")}
    assert rec.keyed_by_row(rows, F.col("k")).count() == 2


def test_headings_are_rejoined(spark):
    text = "\nP A R T I\nP ART  2 x\nI T E M 7A. y\nitem 1\nS I G N A T U R E S here\nSIGNATURE ( s )  z\nthe p a r t 1\nITEMS 4\nS I G N A T U R E\n"
    got = spark.createDataFrame([(text,)], "t string").select(rejoin_headings(F.col("t")).alias("t")).first()["t"]
    assert got == "\nPART I\nPART  2 x\nITEM 7A. y\nitem 1\nSIGNATURES here\nSIGNATURE(s)  z\nthe p a r t 1\nITEMS 4\nS I G N A T U R E\n"
    filing = "\nI T E M 1. Business\nsold “things”\n 12 \nmore\nI T E M 2. Properties\nnone\nS I G N A T U R E S \nend"
    df = spark.createDataFrame([("a", "10-K", "2020-01-01", filing), ("b", "10-K", None, None)], "filename string, type string, filing_date string, content string")
    out = {r["filename"]: r["sections"] for r in filings.extracted(df).collect()}
    assert out["a"]["item_1"] == 'ITEM 1. Business\nsold "things"\nmore' and out["a"]["item_2"] == "ITEM 2. Properties\nnone" and out["a"]["SIGNATURE"].startswith("SIGNATURES")
    assert spark.range(1).select(clean_text(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_prompts(spark):
    one = spark.range(1)
    got = one.select(prompts.filled("triplets", count=F.lit(3), metadata=F.lit("{m}"), text=F.lit("T {count}")).alias("x")).first()["x"]
    assert got == prompts.TEMPLATES["triplets"][1].format(count=3, metadata="{m}", text="T {count}")
    assert one.select(prompts.filled("answer", text=F.lit(None), question=F.lit("q")).alias("x")).first()["x"].endswith("Question: q")
    chunks = F.array(F.struct(F.lit("c1").alias("chunk_id"), F.lit("t1").alias("text")), F.struct(F.lit("c2").alias("chunk_id"), F.lit("t2").alias("text")))
    assert one.select(prompts.chunks_listed(chunks).alias("x")).first()["x"] == "Answer Chunk ID: c1:\nt1\n\nAnswer Chunk ID: c2:\nt2"
    path = F.array(F.struct(F.lit("i").alias("triplet_id")))
    assert one.select(prompts.metadata_listed(path, F.array(F.create_map(F.lit("a"), F.lit("b")))).alias("x")).first()["x"] == 'Metadata for triplet i:\n{"a":"b"}'


def test_backends(spark):
    docs = [(d, p, f"c{d}{p}", f"text {d} {p}", {"file": str(d)}) for d in range(3) for p in range(7)]
    chunks = spark.createDataFrame(docs, "doc_id int, pos int, chunk_id string, text string, metadata map<string,string>")

    def extractor():
        def reply(prompts):
            assert len(prompts) <= 100
            out = []
            for x in prompts:
                ids = [line[10:] for line in x.split("\n") if line.startswith("Chunk ID: ")]
                facts = [{"entity_1": i, "relation": "r", "entity_2": "e", "source_sentence": "s"} for i in ids]
                out.append("broken" if "c25" in ids else json.dumps({"triplets": facts}))
            return out

        return reply

    raw = backends.raw_triplets(chunks, extractor, size=3, target=5).collect()
    by_doc = {d: [r["entity_1"] for r in sorted(raw, key=lambda r: r["seq"]) if r["doc_id"] == d] for d in range(3)}
    assert by_doc == {0: [f"c0{p}" for p in range(6)], 1: [f"c1{p}" for p in range(6)], 2: []}
    assert sorted(r["seq"] for r in raw if r["doc_id"] == 0) == list(range(6))

    upper = lambda: lambda texts: [x.upper()[-3:] if "bad" not in x else None for x in texts]
    rows = spark.createDataFrame([(i, f"q{i}" if i else None) for i in range(250)], "id int, prompt string")
    got = {r["id"]: r["reply"] for r in backends.asked(rows, "prompt", upper).collect()}
    assert len(got) == 250 and got[0] is None and got[249] == "249"
    with pytest.raises(Exception, match="1 replies to"):
        backends.asked(rows, "prompt", lambda: lambda texts: ["x"]).collect()

    qa = spark.createDataFrame([(1, "why", "so"), (2, "bad", "no")], "id int, question string, answer string")
    grades = lambda: lambda texts: [json.dumps({"clarity": 4, "answerability": 5, "reasoning": 3, "x": 1}) if "why" in t else '{"clarity": 1}' for t in texts]
    out = {r["id"]: r["scores"] for r in backends.graded(qa, grades).collect()}
    assert out == {1: {"clarity": 4, "answerability": 5, "reasoning": 3}, 2: None}
    assert backends.rewritten(qa, upper, "shorter", 3).count() == 6
    back = {r["text"]: r["back_translation"] for r in backends.translated_back(spark.createDataFrame([("abc",), ("bad",)], "text string"), upper, upper).collect()}
    assert back == {"abc": "ABC", "bad": None}
    items = spark.createDataFrame([("q1", ["d"]), ("q2", [])], "query string, docs array<string>")
    assert sorted(r["response"] for r in backends.answered(items, upper).collect()) == [" Q1", " Q2"]
    vec = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    sim = backends.similarity(spark.createDataFrame([("ab", "abc")], "a string, b string"), "a", "b", vec, "as query: ").first()
    assert sim["similarity"] == 12 * 3 + 1
    assert [r["question"] for r in backends.questions(qa.withColumn("prompt", F.col("question")).drop("question", "answer"), lambda: lambda t: ['{"question": "Q", "answer": "A"}' if x == "why" else "?" for x in t]).orderBy("id").collect()] == ["Q", None]


def test_failed_prompts_are_asked_again(spark):
    calls = []

    def shaky(prompts):
        calls.append(list(prompts))
        if len(calls) == 1:
            raise OSError("busy")
        return [None if len(calls) == 2 and "b" in p or "never" in p else p.upper() for p in prompts]

    assert backends.replies_to(shaky, ["a", "b", "never"], 3, 0.0) == ["A", "B", None]
    assert calls == [["a", "b", "never"], ["a", "b", "never"], ["b", "never"], ["never"]]
    with pytest.raises(OSError):
        backends.replies_to(lambda _: (_ for _ in ()).throw(OSError("gone")), ["a"], 2, 0.0)
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id int, prompt string").coalesce(1)

    def make():
        import threading
        import time

        held, most = [], [0]

        def reply(prompts):
            held.append(threading.get_ident())
            most[0] = max(most[0], len(held))
            time.sleep(0.02)
            held.pop()
            return [str(most[0]) for _ in prompts]

        return reply

    assert max(int(r["reply"]) for r in backends.asked(df, "prompt", make, batch=4, at_once=3).collect()) <= 3
    assert {r["reply"] for r in backends.asked(df, "prompt", make, batch=4).collect()} == {"1"}


def test_facts_keep_the_metadata_of_their_domain(spark):
    chunks = spark.createDataFrame([(1, 0, "c", "t", {"domain": "policy", "file_state": "x", "secret": "y"})], "doc_id int, pos int, chunk_id string, text string, metadata map<string,string>")
    make = lambda: lambda prompts: [json.dumps({"triplets": [{"entity_1": "a", "relation": "r", "entity_2": "b", "source_sentence": "s"}]}) for _ in prompts]
    assert backends.raw_triplets(chunks, make, keys=backends.POLICY).first()["metadata"] == {"domain": "policy", "file_name": "", "file_type": "", "file_grantee": "", "file_state": "x", "file_year": ""}
    assert backends.raw_triplets(chunks, make).first()["metadata"]["secret"] == "y"
