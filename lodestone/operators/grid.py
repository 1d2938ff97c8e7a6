"""A query set against all rows as a grid: packs of queries by packs of rows, each cell one task's work.

Rows are dealt round robin into packs of a bounded number of rows, so no key makes a pack large, and each pack is one
row of arrays. A cell gets one pack of either side; both sides are copied as often as the other has packs, which is
all that is shuffled. Nothing passes through the driver but two counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks of one grid; more cells share them.
MOST_TASKS = 100_000


def packs_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def packed(df: DataFrame, packs: int, build: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """One row (pack, and what build makes of its rows) for each pack of df that has rows; build gets about rows / packs rows.

    schema: of build's columns.
    """
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = pa.schema([("pack", pa.int32()), *((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pylist([{"pack": TaskContext.get().partitionId()} | build(pa.Table.from_batches(held))], types)

    return df.repartition(packs).mapInArrow(run, f"pack int, {schema}")


def grid(left: DataFrame, lefts: int, right: DataFrame, rights: int, cell: Callable[[dict, dict], pa.Table | None], schema: str, types: pa.Schema) -> DataFrame:
    """What cell gives for each pair of a left and a right pack, each as a dict of its columns."""
    across = left.withColumn("_left", F.col("pack")).withColumn("_right", F.explode(F.sequence(F.lit(0), F.lit(rights - 1))))
    down = right.withColumn("_right", F.col("pack")).withColumn("_left", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1))))
    tasks = min(lefts * rights, MOST_TASKS)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = cell(a.to_pylist()[0], b.to_pylist()[0]) if a.num_rows and b.num_rows else None
        return types.empty_table() if found is None else found

    keys = ("_left", "_right")
    return across.repartition(tasks, *keys).groupBy(*keys).cogroup(down.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, schema)
