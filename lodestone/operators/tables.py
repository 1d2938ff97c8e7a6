"""Relational operators on document tables: first and last rows, upserts, incremental sets, groups and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import strip


def last_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row a key, the one with the largest seq. Aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """new rows over old ones of the same key; a replaced row keeps the place (seq) of the first."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, seq)]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", seq)).alias("_row"), F.min_by(seq, F.struct("_new", seq)).alias(seq))
    return out.select(*keys, seq, "_row.*").select(*old.columns)


def incremental(old: DataFrame, new: DataFrame, kept: DataFrame, file: str, key: str) -> DataFrame:
    """Old rows whose file is kept, and new rows whose key the kept old ones don't have."""
    alive = old.join(kept.select(file).distinct(), file, "left_semi")
    return alive.unionByName(new.join(alive.select(key), key, "left_anti"))


def fill_missing(df: DataFrame, known: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with nulls of columns filled from known, one row a key."""
    facts = known.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return df.join(facts, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in df.columns))


def filter_or_all(df: DataFrame, condition: Column, fallback: bool = True) -> DataFrame:
    """The rows that meet the condition; with fallback all rows if none does."""
    found = df.where(condition)
    if not fallback:
        return found
    none = found.select(F.lit(1).alias("_any")).limit(1).agg(F.count("*").alias("_found"))
    return found.unionByName(df.crossJoin(F.broadcast(none)).where("_found = 0").drop("_found"))  # one row, one count


def in_any_case(column: Column, values: Sequence[str]) -> Column:
    return F.lower(column).isin([v.lower() for v in values])


def groups_of(df: DataFrame, keys: Sequence[str], order: str, size: int, item: str) -> DataFrame:
    """(keys, grp, items): runs of size consecutive rows of each key, as ordered arrays."""
    placed = df.withColumn("grp", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / size))
    rows = placed.groupBy(*keys, "grp").agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("rows"))
    return rows.select(*keys, "grp", F.transform("rows", lambda r: r[item]).alias("items"))


def until_total(df: DataFrame, keys: Sequence[str], order: str, amount: str, target: int) -> DataFrame:
    """The rows before which the running amount is below target: the row that crosses it stays whole."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(amount).over(before), F.lit(0))).where(F.col("_before") < target).drop("_before")


def from_marker(df: DataFrame, keys: Sequence[str], order: str, marker: Column, back: int = 1) -> DataFrame:
    """Rows from back rows before the first marker on; a marker in the very first row leaves the last row, none leaves nothing."""
    every = Window.partitionBy(*keys)
    own = Window.partitionBy(*keys).orderBy(order)
    placed = df.withColumn("_at", F.row_number().over(own) - 1).withColumn("_first", F.min(F.when(marker, F.col("_at"))).over(every)).withColumn("_last", F.max("_at").over(every))
    start = F.when(F.col("_first") >= back, F.col("_first") - back).when(F.col("_first").isNotNull(), F.col("_last") + 1 + F.col("_first") - back)
    return placed.where(F.col("_at") >= start).drop("_at", "_first", "_last")


def before_marker(df: DataFrame, keys: Sequence[str], order: str, marker: Column) -> DataFrame:
    """Rows before the first marker, all without one."""
    first = F.min(F.when(marker, F.col(order))).over(Window.partitionBy(*keys))
    return df.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def preceding_lines(df: DataFrame, keys: Sequence[str], order: str, text: str, usable: Column, count: int = 2) -> DataFrame:
    """df with context: up to count lines before each, those that are usable, joined by newlines."""
    own = Window.partitionBy(*keys).orderBy(order)
    lines = df.withColumn("_line", F.when(usable, F.col(text)))
    context = F.concat_ws("\n", *(F.lag("_line", k).over(own) for k in range(count, 0, -1)))
    return lines.withColumn("context", context).drop("_line")


def anti_existing(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are not done yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def map_union(a: Column, b: Column) -> Column:
    """Entries of both maps, b's where both have a key; it needs no session setting."""
    rest = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(rest, b))


def rename_columns(df: DataFrame, names: dict[str, Sequence[str]]) -> DataFrame:
    """df's columns by canonical name: for each the first column whose name, in any case, contains a given part."""
    out = []
    for name, parts in names.items():
        found = next((c for p in parts for c in df.columns if p.lower() in c.lower()), None)
        out.append(F.trim(F.col(f"`{found}`").cast("string")).alias(name) if found else F.lit(None).cast("string").alias(name))
    return df.select(*out)


# A company table's columns, and what the names of others for them hold, in the order in which they are tried.
COMPANY_COLUMNS = ("Symbol", "Security", "GICS_Sector", "GICS_SubIndustry", "CIK")
COMPANY_NAMES = {"Symbol": ("ticker", "symbol"), "Security": ("company", "security", "name"), "GICS_Sector": ("sector",), "GICS_SubIndustry": ("industry",), "CIK": ("cik",)}


def company_table(df: DataFrame) -> DataFrame:
    """COMPANY_COLUMNS of a table with these columns, or with such as their names tell: each column is for the first that fits, and of several for one the last counts.

    Values are trimmed texts, numbers of a CIK have ten digits at least; without such a column it is empty. A missing other column is an error.
    """
    found = {c: c.replace("_", " ") for c in COMPANY_COLUMNS if c.replace("_", " ") in df.columns}
    found |= {"GICS_SubIndustry": "GICS Sub-Industry"} if "GICS Sub-Industry" in df.columns else {}
    if len(found) < len(COMPANY_COLUMNS):
        kinds = {c: next((k for k, parts in COMPANY_NAMES.items() if any(p in c.lower() for p in parts)), None) for c in df.columns}
        found = {k: c for c, k in kinds.items() if k}
    missing = set(COMPANY_COLUMNS) - set(found) - {"CIK"}
    if missing:
        raise ValueError(f"no column for {sorted(missing)} among {df.columns}")
    text = {k: strip(F.col(f"`{c}`").cast("string")) for k, c in found.items()}
    cik = text.get("CIK", F.lit(""))
    text["CIK"] = F.when(F.rlike(cik, F.lit(r"^[0-9]{1,9}$")), F.lpad(cik, 10, "0")).otherwise(cik)
    return df.select(*(text[c].alias(c) for c in COMPANY_COLUMNS))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
