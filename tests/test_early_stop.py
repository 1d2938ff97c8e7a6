import hashlib

from pyspark.sql import functions as F

from lodestone.operators import backends
from lodestone.operators.early_stop import accepted_until, graded_waves, next_wave
from lodestone.plans import standins


def rows_of(n):
    return [(f"r{k}", "q" * (k % 37 + 1), "a" * (k % 23 + 1)) for k in range(n)]


def fold(rows, target):
    """Record by record, as far as needed: the accepted ones, and how many were graded."""
    kept, seen = [], 0
    for name, q, a in sorted(rows, key=lambda r: hashlib.sha1(f"42|{r[0]}".encode()).hexdigest()):
        if len(kept) == target:
            break
        if len(q) % 11 and all(1 + n % 5 > 2 for n in (len(q), len(a), len(q) + len(a))):
            kept.append((name, seen))
        seen += 1
    return kept, seen


def ok():
    return F.forall(F.map_values("scores"), lambda x: x > 2)


def grade(df):
    return backends.graded(df, standins.grader)


def test_stops_and_gives_what_the_fold_gives(spark, tmp_path):
    rows = rows_of(2000)
    df = spark.createDataFrame(rows, "record_id string, question string, answer string")
    for target, least in ((30, 10), (30, 64), (1, 10), (10**6, 500)):
        path = str(tmp_path / f"{target}-{least}")
        kept = accepted_until(df, F.col("record_id"), grade, ok(), target, path, least=least)
        want, needed = fold(rows, target)
        assert sorted((r["place"], r["record_id"]) for r in kept.collect()) == [(p, n) for n, p in want]
        asked = spark.read.parquet(f"{path}/waves")
        waves = [r["n"] for r in asked.groupBy("wave").agg(F.count("*").alias("n")).orderBy("wave").collect()]
        assert asked.count() < needed + max(waves) and (target == 10**6) == (asked.count() == 2000)
    assert accepted_until(df.limit(0), F.col("record_id"), grade, ok(), 5).count() == 0
    assert "accepted" not in kept.columns and "scores" in kept.columns


def test_goes_on_behind_the_last_whole_wave(spark, tmp_path):
    df = spark.createDataFrame(rows_of(600), "record_id string, question string, answer string")
    path = str(tmp_path / "w")

    def broken(rows):
        if rows.agg(F.min("place")).first()[0] > 0:
            raise RuntimeError("the model is gone")
        return grade(rows)

    try:
        graded_waves(df, F.col("record_id"), broken, ok(), 50, path, least=20)
    except RuntimeError:
        pass
    first = spark.read.parquet(f"{path}/waves").count()
    assert first == 50
    kept = accepted_until(df, F.col("record_id"), grade, ok(), 50, path, least=20)
    assert sorted(r["record_id"] for r in kept.collect()) == sorted(n for n, _ in fold(rows_of(600), 50)[0])
    again = accepted_until(df, F.col("record_id"), lambda _: 1 / 0, ok(), 50, path, least=20)  # nothing is asked twice
    assert again.count() == 50


def test_wave_sizes():
    assert next_wave(1000, 0, 0, 100, 10_000) == 1000 and next_wave(5, 0, 0, 100, 10_000) == 100
    assert next_wave(100, 0, 100, 10, 150) == 100 and next_wave(100, 25, 100, 10, 1000) == 300 and next_wave(100, 99, 1000, 10, 1000) == 11
