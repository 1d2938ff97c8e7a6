"""Numbers, samples and first rows in a total order, without a task that holds a whole key.

A row's bucket is a coarse image of its place in the order: of two rows in different buckets the one in the lower
bucket comes first. Rows are counted by key and bucket before the shuffle; the running sums of these counts, at most one row
a bucket, tell where each bucket starts, and inside a bucket a window orders the few rows that are left. Orders by
hash have the hash's first digits as their bucket, so buckets are even whatever the keys. Where only the first rows
of a key are asked for, buckets that start behind them are left out before anything is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import order_key

#: Hexadecimal digits of a hash that name its bucket: 4,096 buckets a key.
DIGITS = 3


def hash_bucket(order: Column, digits: int = DIGITS) -> Column:
    return F.conv(F.substring(order, 1, digits), 16, 10).cast("long")


def running(df: DataFrame, keys: Sequence[str], order: Column, bucket: Column, sums: dict[str, Column], first: tuple[str, int] | None = None) -> DataFrame:
    """df with the running sum of each of sums within its keys' rows, the row included.

    bucket must not fall where order rises. first: (name, n) keeps the buckets that begin before n of that sum only;
    which of their rows count is left to the caller. Rows that are equal in order come in any order. A null key is a key.
    """
    rows = df.withColumn("_order", order).withColumn("_at", F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), bucket.alias("bucket"))).withColumns({f"_n_{n}": c for n, c in sums.items()})
    held = rows.groupBy("_at").agg(*(F.sum(f"_n_{n}").alias(f"_own_{n}") for n in sums))
    before = Window.partitionBy(*(F.col(f"_at.k{i}") for i in range(len(keys))) or [F.lit(0)]).orderBy("_at.bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(F.col("_at").alias("_start"), *(F.coalesce(F.sum(f"_own_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    if first:
        starts = starts.where(F.col(f"_before_{first[0]}") < first[1])
    inside = Window.partitionBy("_at").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(starts, F.col("_at") == F.col("_start"))  # fields that are null are equal inside of structs
    return placed.withColumns({n: F.col(f"_before_{n}") + F.sum(f"_n_{n}").over(inside) for n in sums}).select(*(f"`{c}`" for c in df.columns), *sums)


def hash_ranked(df: DataFrame, keys: Sequence[str], key: Column, seed: int = 42, first: int | None = None, name: str = "rank") -> DataFrame:
    """df with each row's place, from 1, in its keys' seeded portable order; the first rows only where first is given."""
    order = order_key(key, seed)
    out = running(df, keys, order, hash_bucket(order), {name: F.lit(1)}, None if first is None else (name, first))
    return out if first is None else out.where(F.col(name) <= first)


def hash_sample(df: DataFrame, keys: Sequence[str], key: Column, count: int, seed: int = 42) -> DataFrame:
    """count rows of each keys group in a seeded portable order, all of a smaller group."""
    return hash_ranked(df, keys, key, seed, count, "_rank").drop("_rank")


def accepted_first(df: DataFrame, keys: Sequence[str], key: Column, accepted: Column, target: int, seed: int = 42) -> DataFrame:
    """Accepted rows in shuffled order until target of them, with shuffled, their place (from 0) in that order of all rows."""
    order, ok = order_key(key, seed), F.coalesce(accepted, F.lit(False))
    sums = {"shuffled": F.lit(1), "_accepted": F.when(ok, 1).otherwise(0)}
    out = running(df.withColumn("_ok", ok), keys, order, hash_bucket(order), sums, ("_accepted", target))
    return out.where(F.col("_ok") & (F.col("_accepted") <= target)).withColumn("shuffled", (F.col("shuffled") - 1).cast("int")).drop("_ok", "_accepted")


def numbered(df: DataFrame, keys: Sequence[str], order: str, name: str = "idx", buckets: int = 4096) -> DataFrame:
    """df with each row's place, from 0, in its keys' order of a whole-number column without nulls; buckets are even ranges of it."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    place = F.floor((F.col(order) - F.lit(low or 0)) / width)
    return running(df, keys, F.col(order), place, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: Column, count: int, name: str = "rank", salts: int = 64) -> DataFrame:
    """The first count rows of each keys group with their rank: of each salt's share first, then of what these leave."""
    own = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    few = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_n") <= count)
    return few.drop("_n", "_salt").withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= count)
