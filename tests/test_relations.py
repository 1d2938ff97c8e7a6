import random
import time

from pyspark.sql import functions as F

from lodestone.operators import relations


def slow(sentences, chunks):
    norm = lambda x: x.lower().strip("\t\n\x0b\x0c\r ").replace("\n\n", " ")
    out = {}
    for i, doc, s in sentences:
        if doc is None or s is None or not s.strip(" "):
            continue
        hits = [(p, c) for d, c, p, t in chunks if d == doc and t is not None and norm(s) in norm(t)]
        if hits:
            out[i] = min(hits)[1]
    return out


def run(spark, sentences, chunks):
    s = spark.createDataFrame(sentences, "sentence_id long, doc_id string, sentence string")
    c = spark.createDataFrame(chunks, "doc_id string, chunk_id string, pos int, text string")
    return {r["sentence_id"]: r["chunk_id"] for r in relations.located(s, c).collect()}


def test_sentences_meet_their_first_chunk(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["aa", "ab", "a", "ba", "É", "b b", "\n\nx"])
    chunks = [(d, f"{d}{p}", p, " ".join(word() for _ in range(rng.randrange(12)))) for d in ("d", "e") for p in range(40)] + [("f", "f0", 0, None), (None, "n", 0, "aa"), ("g", "g0", 3, "Only")]
    sentences = [(k, rng.choice(["d", "e", "f"]), " ".join(word() for _ in range(rng.randrange(5)))) for k in range(300)]
    sentences += [(900, "g", "ONLY "), (901, "g", "\n"), (902, "g", "   "), (903, None, "aa"), (904, "g", None), (905, "h", "x"), (906, "g", "ly")]
    want = slow(sentences, chunks)
    assert run(spark, sentences, chunks) == want and len(want) > 90
    assert run(spark, sentences[:0], chunks) == {}
    monkeypatch.setattr(relations, "CHUNK_PACK", 7)  # a document of several packs
    assert run(spark, sentences, chunks) == want


def test_bounded_automata_give_the_same(spark, monkeypatch):
    texts = [f"line {k} of many, {k * k}" for k in range(50)]
    assert relations.first_holders(texts, [f"of many, {k * k}" for k in range(50)] + ["", "absent", "l"]) == [next(i for i, t in enumerate(texts) if f"of many, {k * k}" in t) for k in range(50)] + [0, None, 0]
    assert relations.first_holders([], ["", "a"]) == [None, None]


def test_work_grows_with_the_length(spark):
    took = []
    for n in (10_000, 80_000):
        texts = [f"sentence number {k} says {k * 7919 % 1_000_003} things" for k in range(n)]
        began = time.process_time()
        assert relations.first_holders(texts, texts) == list(range(n))
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]  # 8 times the text; sentences times chunks would be 64 times


def test_one_document_of_many_lines(spark):
    rows = spark.range(60_000).select(F.lit("d").alias("doc_id"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("line "), F.col("id") % 30_000, F.lit(" of one very long document")).alias("text"))
    asked = rows.select(F.col("pos").cast("long").alias("sentence_id"), "doc_id", F.col("text").alias("sentence"))
    found = relations.located(asked, rows)
    assert found.where("chunk_id <> concat('c', sentence_id % 30000)").count() == 0 and found.count() == 60_000
