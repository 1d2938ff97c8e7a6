"""Grading that stops when enough has been accepted.

Rows are graded in waves of the seeded shuffled order until ``target`` of them are accepted, so a model is asked about
target / acceptance rate rows and at most one wave more, not about all. The order is a number a row
(``ranking.hash_ranked``), written once and sorted by it, so a wave reads its own row groups only. Each wave is written
before anything else happens to it: replies aren't repeatable, and a run that stopped goes on behind its last whole wave
if it is given the same path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import hash_ranked, running
from lodestone.sources.folders import exists, shared_path


def next_wave(target: int, accepted: int, graded: int, least: int, most: int) -> int:
    """Rows that the rate so far needs for what is missing; as many again as so far where nothing was accepted."""
    if not graded:
        return min(max(target, least), most)
    need = graded if not accepted else -(-(target - accepted) * graded // accepted)
    return min(max(need, least), most)


def graded_waves(rows: DataFrame, key: Column, grade: Callable[[DataFrame], DataFrame], accepted: Column, target: int, path: str, seed: int = 42, least: int = 100, most: int = 10_000) -> DataFrame:
    """All graded rows with place (from 0) and accepted: waves below path until target are accepted or none is left."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/order/_SUCCESS"):
        hash_ranked(rows, [], key, seed, name="place").withColumn("place", F.col("place") - 1).repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(f"{path}/order")
    order = spark.read.parquet(f"{path}/order")
    every, seen, found, wave = order.count(), 0, 0, 0
    while exists(spark, f"{path}/waves/wave={wave}/_SUCCESS"):
        seen, found, wave = *_progress(spark, path, wave), wave + 1
    while found < target and seen < every:
        size = next_wave(target, found, seen, least, most)
        own = grade(order.where((F.col("place") >= seen) & (F.col("place") < seen + size)))
        own.withColumn("accepted", F.coalesce(accepted, F.lit(False))).write.mode("overwrite").parquet(f"{path}/waves/wave={wave}")
        seen, found, wave = *_progress(spark, path, wave), wave + 1
    return spark.read.parquet(f"{path}/waves") if wave else grade(order).withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def _progress(spark, path: str, wave: int) -> tuple[int, int]:
    """Rows graded and accepted up to a wave."""
    done = spark.read.parquet(f"{path}/waves").where(F.col("wave") <= wave)
    return done.agg(F.count("*"), F.count_if("accepted")).first()


def accepted_until(rows: DataFrame, key: Column, grade: Callable[[DataFrame], DataFrame], accepted: Column, target: int, path: str | None = None, seed: int = 42, least: int = 100, most: int = 10_000) -> DataFrame:
    """The first target accepted rows of the shuffled order, graded, with place, and all accepted ones if there are fewer.

    grade: adds grades to rows, asking a model (``backends.graded``). accepted: a condition on what it adds; null is no.
    path: where the waves are written, a new shared folder by default.
    """
    path = path or shared_path(rows.sparkSession, "early-stop")
    graded = graded_waves(rows, key, grade, accepted, target, path, seed, least, most).where("accepted")
    # a distributed running count: the last wave may have accepted more than was asked for
    counted = running(graded, [], F.col("place"), F.floor(F.col("place") / least), {"_nth": F.lit(1)}, ("_nth", target))
    return counted.where(F.col("_nth") <= target).drop("_nth", "accepted", *({"wave"} & set(counted.columns)))
