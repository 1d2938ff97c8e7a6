import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking


def order(key, seed=42):
    return hashlib.sha1(f"{seed}|{key}".encode()).hexdigest()


def groups(spark, one):
    rows = [(k, None if k % 50 == 0 else "one" if one or k % 5 else f"g{k % 3}", k % 4 == 1) for k in range(3000)]
    held = {}
    for k, g, ok in rows:
        held.setdefault(g, []).append((order(k), k, ok))
    return spark.createDataFrame(rows, "k long, g string, ok boolean"), {g: sorted(v) for g, v in held.items()}


@pytest.mark.parametrize("one", [True, False])
def test_ranks_samples_and_first_accepted(spark, one):
    df, held = groups(spark, one)
    got = {(r["g"], r["rank"]): r["k"] for r in ranking.hash_ranked(df, ["g"], F.col("k")).collect()}
    assert got == {(g, i): k for g, v in held.items() for i, (_, k, _) in enumerate(v, 1)}
    for count in (1, 7, 100, 5000):
        found = sorted((str(r["g"]), r["k"]) for r in ranking.hash_sample(df, ["g"], F.col("k"), count).collect())
        assert found == sorted((str(g), k) for g, v in held.items() for _, k, _ in v[:count])
        want = [(str(g), k, i) for g, v in held.items() for i, k in [(i, k) for i, (_, k, ok) in enumerate(v) if ok][:count]]
        first = ranking.accepted_first(df, ["g"], F.when(F.col("ok"), F.col("k")).otherwise(F.col("k")), F.col("ok"), count)
        assert sorted((str(r["g"]), r["k"], r["shuffled"]) for r in first.collect()) == sorted(want)
    whole = ranking.hash_sample(df, [], F.col("k"), 9)
    assert sorted(r["k"] for r in whole.collect()) == sorted(k for _, k in sorted((order(k), k) for k in range(3000))[:9])
    assert ranking.hash_sample(df.limit(0), ["g"], F.col("k"), 3).count() == 0


def test_no_window_holds_a_whole_key(spark):
    df, _ = groups(spark, True)
    plans = [ranking.hash_sample(df, ["g"], F.col("k"), 5), ranking.accepted_first(df, ["g"], F.col("k"), F.col("ok"), 5), ranking.hash_ranked(df, ["g"], F.col("k"))]
    for plan in plans:
        windows = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" +-:").startswith("Window ")]
        assert len(windows) == 2
        for line in windows:  # one over counts by bucket, one over a bucket's rows
            assert "sum(_own_" in line or "_at#" in line.split("windowspecdefinition(")[1].split(",")[0]


def test_numbers_in_a_given_order(spark):
    rows = [(k * 37 % 1000, f"g{k % 2}") for k in range(1000)] + [(10**12, "g0"), (-5, "g1")]
    df = spark.createDataFrame(rows, "seq long, g string")
    for buckets in (1, 16, 4096):
        got = sorted((r["g"], r["idx"], r["seq"]) for r in ranking.numbered(df, ["g"], "seq", buckets=buckets).collect())
        assert got == sorted((g, i, s) for g in ("g0", "g1") for i, s in enumerate(sorted(x for x, y in rows if y == g)))
    assert ranking.numbered(df.limit(0), ["g"], "seq").count() == 0


def test_top_n_in_two_steps(spark):
    df = spark.createDataFrame([(k, "g" if k < 900 else "h", k % 17) for k in range(1000)], "k long, g string, v int")
    got = sorted((r["g"], r["rank"], r["k"]) for r in ranking.top_n(df, ["g"], [F.desc("v"), F.col("k")], F.col("k"), 5).collect())
    want = [(g, i, k) for g, low, high in (("g", 0, 900), ("h", 900, 1000)) for i, (_, k) in enumerate(sorted((-(k % 17), k) for k in range(low, high))[:5], 1)]
    assert got == want
