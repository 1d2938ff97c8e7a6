from pyspark.sql import functions as F

from lodestone.functions import judge
from lodestone.operators.evaluation import response_details, robustness
from lodestone.streaming.evaluate import answered, evaluate_stream, metrics_so_far, metrics_tracked, read_responses, track_metrics

ITEM = "item_id string, record_id string, query string, docs array<string>, answer string, query_variant string, doc_variant_type string, retriever string, for_metric boolean"


def work(spark, records):
    rows = []
    for k in range(records):
        rows.append((f"{k}/empty", f"r{k}", "q", [], f"truth {k}", "original", judge.EMPTY, None, False))
        for v in ("original", "word_level"):
            rows += [(f"{k}/{v}/{d}", f"r{k}", "q", ["d"], f"truth {k}", v, d, "r0" if d == judge.REAL else None, True) for d in (judge.TRUTH, judge.SIMILAR, judge.DIFFERENT, judge.REAL)]
    return spark.createDataFrame(rows, ITEM)


def values(df):
    return {(r["model"], r["metric"]): r["value"] for r in df.collect()}


def test_each_batch_touches_its_own_state_and_gives_the_batch_query(spark, tmp_path):
    items = work(spark, 12)
    said = F.when(F.pmod(F.xxhash64("item_id", "model"), F.lit(3)) == 0, F.col("answer")).when(F.pmod(F.xxhash64("item_id", "model"), F.lit(3)) == 1, "no such info").when(F.pmod(F.xxhash64("item_id"), F.lit(5)) == 0, F.lit(None).cast("string")).otherwise("something else")
    every = items.withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2")))).select("item_id", "model", said.alias("response"), "record_id").cache()
    number = F.regexp_extract("item_id", "^([0-9]+)", 1).cast("int")
    probe = F.endswith("item_id", F.lit("/empty"))
    # one model's records alone; the others; an answer twice, the second one other; then all probes, late
    parts = [
        every.where(~probe & (F.col("model") == "m1") & (number < 4)),
        every.where(~probe & ~((F.col("model") == "m1") & (number < 4))),
        every.where(~probe & (F.col("model") == "m2") & (number == 2)).withColumn("response", F.lit("another answer")),
        every.where(probe),
        every.limit(0),
    ]
    seen, touched = None, []
    for k, part in enumerate(parts):
        part.select("item_id", "model", "response").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = track_metrics(read_responses(spark, str(tmp_path / "in*")), items, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        stream.awaitTermination()
        states = [s for p in stream.recentProgress for s in p["stateOperators"]]
        touched.append(sum(s["numRowsUpdated"] for s in states))
        if k != 2:  # a second answer to an item doesn't count
            seen = part if seen is None else seen.unionByName(part)
        got, want = values(metrics_tracked(spark, str(tmp_path / "out"))), values(robustness(response_details(items, seen.where("response is not null").select("item_id", "model", "response"))))
        assert got == want and len(got) == 15 * (1 + (k > 0))
    assert touched[0] == 4 and touched[1] == 20 and touched[2] == 1 and touched[4] == 0, touched


def test_verdicts_are_kept_without_texts(spark, tmp_path):
    """Answers that differ in one record, lack it or are null; an item answered twice counts as it came first."""
    items = work(spark, 6).withColumn("answer", F.when(F.endswith("item_id", F.lit("/empty")), F.lit("other truth")).when(F.startswith("item_id", F.lit("3/")), F.lit(None).cast("string")).otherwise(F.col("answer")))
    items = items.withColumn("record_id", F.when(F.startswith("item_id", F.lit("4/")), F.lit(None).cast("string")).when(F.startswith("item_id", F.lit("5/")), F.lit("")).otherwise(F.col("record_id"))).cache()
    said = F.when(F.pmod(F.xxhash64("item_id"), F.lit(3)) == 0, F.col("answer")).when(F.pmod(F.xxhash64("item_id"), F.lit(3)) == 1, "no such info").otherwise("something else")
    every = items.select("item_id", F.lit("m").alias("model"), said.alias("response")).cache()
    every.coalesce(1).write.parquet(str(tmp_path / "in0"))
    got = answered(every, items.withColumn("answer", F.coalesce("answer", F.lit(""))))
    assert got.count() == every.count() == got.select("item_id").distinct().count()
    for k in range(2):
        evaluate_stream(read_responses(spark, str(tmp_path / "in*")), items, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        assert values(metrics_so_far(spark, items, str(tmp_path / "out"))) == values(robustness(response_details(items, every)))
        assert "response" not in spark.read.parquet(str(tmp_path / "out")).columns
        if not k:
            every.withColumn("response", F.lit("a second answer")).coalesce(1).write.parquet(str(tmp_path / "in1"))


def test_state_is_small(spark, tmp_path):
    """Long ids of one record are packed, and no metric is named for each item."""
    import zlib

    import pandas as pd

    from lodestone.streaming.evaluate import CELL, changed_cells

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, size = State(), 31
    rows = [(f"conv_{'9' * 60}/{i}", True, f"v{i % 5}", "ground-truth-docs", None, i % 2 == 0, True, i == 30) for i in range(size)]
    pdf = pd.DataFrame(rows, columns=["item_id", "for_metric", *CELL, "robust", "robust_known", "knows"])
    first = pd.concat(changed_cells(("m", "r"), iter([pdf[:20]]), state))
    later = pd.concat(changed_cells(("m", "r"), iter([pdf]), state))
    assert len(state.get[0]) < 500 and b"conv" in zlib.decompress(state.get[0])
    assert (first["n"].sum(), first["robust"].sum()) == (20, 10) and (later["n"].sum(), later["robust"].sum()) == (11, 21)
    assert pd.concat(changed_cells(("m", "r"), iter([pdf]), state)).empty
