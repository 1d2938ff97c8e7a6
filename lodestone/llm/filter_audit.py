"""Filter interaction audit: what each filter of a set removes in every order, from counts by failure mask.

Each document has a mask of the filters it fails. Documents are counted by part and mask only once; a subset-zeta
transform (``log2`` rounds over arrays of one count a mask) turns these counts into the survivors of every subset of
filters, and every figure of every order is a difference of two neighbouring subsets' survivors. So the texts are
read once, whatever the number of orders, and after the counts there are at most 2^n rows a part.

A filter is a boolean column that is true where a document fails; null counts as passed. One filter may be a
duplicate filter: it fails where an equal text has a smaller id in the whole table. Texts are equal if their SHA-256
is. Equal texts are first counted by (text, part, label), so that a text which a third of all rows hold is a few
rows with counts before anything needs it in one place.

Nulls and ties: a null text is empty, a null part is the empty string. A row with a null id is never a duplicate
and makes none; rows of one id and one text aren't smaller than each other, so all of them pass or all fail. A
document is good (toxic) if any row of its id in labels says so; a null label and a null id say nothing. An empty table has no
parts and gives no rows. Columns that aren't named in the call are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ("n", "good", "toxic")
#: Orders grow as the factorial of the filters, masks as a power of two.
MOST_FILTERS = 7
BLANKS = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of anything but blanks (space and the controls 9 to 13)."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def document_filters(text: Column) -> dict[str, Column]:
    """The filters A to D: too short, too repetitive, too many capitals, markup characters."""
    own = words(text)
    return {
        "A": F.size(own) < 100,
        "B": 100 * F.size(F.array_distinct(own)) < 80 * F.size(own),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicates: str | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and the bits of the filters they fail, in the filters' order.

    duplicates: the name of the duplicate filter; its bit comes after those of filters. Texts are read in one scan and
    go no further than their digest.
    """
    bits = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    seen = docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256).alias("_text"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_key"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    told = seen.join(marks.where("good or toxic"), F.col("_id") == F.col("_key"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    if duplicates is None:
        counted = told.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    else:
        counted = _with_duplicates(told, 1 << len(filters))
    sums = [F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in COUNTS[1:])]
    return counted.groupBy("part", "mask").agg(*sums)


def _with_duplicates(told: DataFrame, bit: int) -> DataFrame:
    """Counts with the duplicate filter's bit: of a text's rows all but those of its least id fail.

    Rows are counted by id, then by text and kind with the count at the kind's least id, so what a text has at the
    end is a few rows, at most one for each part and label.
    """
    kinds = ["_text", "part", "mask", "good", "toxic"]
    rows = told.groupBy(*kinds, "_id").agg(F.count("*").alias("n"))
    named = F.col("_id").isNotNull()
    held = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("_id", "n"))).alias("least"))
    first = F.min("least._id").over(Window.partitionBy("_text"))
    failed = held.withColumn("failed", F.when(F.col("least").isNull(), F.lit(0)).otherwise(F.col("named") - F.when(F.col("least._id") == first, F.col("least.n")).otherwise(0)))
    own = ["part", "good", "toxic"]
    passed = failed.select(*own, "mask", (F.col("n") - F.col("failed")).alias("n"))
    return passed.unionByName(failed.select(*own, (F.col("mask") + F.lit(bit)).alias("mask"), F.col("failed").alias("n"))).where("n > 0")


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): arrays with, at each subset of filters, the documents that pass all of the subset.

    With z[U] the sum of the counts of all masks within U, the survivors of S are z[complement of S]. z takes one round a
    filter: a mask with the round's bit adds what stands at the mask without it.
    """
    if not 0 < filters <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters, not {filters}")
    masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS)))).alias("at"))  # one a mask

    def zeta(name: str) -> Column:
        start = F.transform(masks, lambda m: F.coalesce(F.try_element_at("at", m)[name], F.lit(0)).cast("long"))
        within = F.aggregate(F.lit([1 << k for k in range(filters)]), start, lambda z, bit: F.transform(z, lambda x, m: x + F.when(m.bitwiseAND(bit) > 0, F.get(z, m - bit)).otherwise(0)))
        return F.reverse(within)  # the complement of S is the last mask less S

    return by_mask.select("part", *(zeta(c).alias(c) for c in COUNTS))


def order_steps(alive: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row a part, order of the filters and step, from the arrays of survivors; names: one letter a filter.

    kept, removed, redundant (failing the step's filter, removed before), unique_fails (failing that filter only),
    good_lost, toxic_lost, and shapley: what the filter removes, summed over all orders.
    """
    size, last = len(names), (1 << len(names)) - 1
    bits = F.lit([1 << k for k in range(size)])
    weights = F.lit([factorial(k) * factorial(size - 1 - k) for k in range(size)])  # orders in which a set of k goes first

    def share(n: Column) -> Column:
        def of(bit: Column) -> Column:
            gain = lambda s: F.when(s.bitwiseAND(bit) == 0, F.get(weights, F.bit_count(s)).cast("long") * (F.get(n, s) - F.get(n, s + bit))).otherwise(0)
            return F.aggregate(F.sequence(F.lit(0), F.lit(last)), F.lit(0).cast("long"), lambda held, s: held + gain(s))

        return F.transform(bits, of)

    orders = F.lit(["".join(p) for p in permutations(names)])
    steps = alive.withColumn("shares", share(F.col("n"))).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(names)), F.lit(0))
    own = F.instr(F.lit("".join(names)), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    steps = steps.withColumn("before", before).withColumn("own", own).withColumn("bit", F.get(bits, "own"))
    at = lambda c, s: F.get(F.col(c), s)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("before") + F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("n", F.col("before") + F.col("bit")).alias("kept"),
        lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("bit")) - lost("n")).alias("redundant"),
        (at("n", F.lit(last) - F.col("bit")) - at("n", F.lit(last))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", "own").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, duplicates: str | None = "E", key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """order_steps of the filters, by default A to D and the duplicate filter E, over all documents."""
    own = document_filters(F.coalesce(F.col(f"`{text}`"), F.lit(""))) if filters is None else filters
    names = [*own, *([duplicates] if duplicates else [])]
    if any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError(f"filters are named by one letter each, not {names}")
    return order_steps(survivors(mask_counts(docs, labels, own, duplicates, key, text, part), len(names)), names)
