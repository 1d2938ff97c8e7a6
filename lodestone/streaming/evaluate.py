"""Evaluation of a stream of responses: an addition, for results that arrive while models still answer.

The stream's checkpoint stands for saved progress: a stopped run goes on after the last whole batch. ``track_metrics``
keeps state by model and record, so a batch reads and changes only the state of its own rows, and writes what it changes
in the metrics; ``metrics_tracked`` sums these few rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.evaluation import judged_items, metric_names, robustness, verdicts, with_robust

RESPONSE = "item_id string, model string, response string"
VERDICT = ("item_id", "model", "is_correct", "refused")


def read_responses(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """The responses in Parquet files below path, as they come, at most so many files a batch."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files).parquet(path)


ABOUT = ("record_id", "query_variant", "doc_variant_type", "retriever", "for_metric")


def answered(responses: DataFrame, items: DataFrame) -> DataFrame:
    """responses with their items' columns and answer. A record's items share its answer, so it is joined by record and not shuffled with every item."""
    record = F.coalesce("record_id", F.lit("")).alias("_r")
    key = [F.xxhash64("answer").alias("_a1"), F.xxhash64(F.lit("second"), "answer").alias("_a2")]
    truths = items.select(record, "answer").distinct().select("_r", *key, "answer")
    return responses.join(items.select("item_id", *ABOUT, record, *key), "item_id").join(truths, ["_r", "_a1", "_a2"]).drop("_r", "_a1", "_a2")


def evaluate_stream(responses: DataFrame, items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the verdicts on each batch's responses below path, without texts; a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["item_id", "model"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    judged = verdicts(answered(responses, items)).select(*VERDICT)
    return judged.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def metrics_so_far(spark: SparkSession, items: DataFrame, path: str) -> DataFrame:
    """Robustness over all batches written; an item answered twice counts once."""
    first = F.min_by(F.struct("is_correct", "refused"), "batch").alias("first")
    held = spark.read.schema("item_id string, model string, is_correct boolean, refused boolean, batch long").parquet(path).groupBy("item_id", "model").agg(first)
    told = items.select("item_id", *ABOUT)
    return robustness(with_robust(held.select("item_id", "model", "first.*").join(told, "item_id")))


#: What a response counts for follows from these.
CELL = ("query_variant", "doc_variant_type", "retriever")
CHANGES = "model string, metric string, n long, robust long"
CELL_CHANGES = "model string, query_variant string, doc_variant_type string, retriever string, n long, robust long"


def changed_cells(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """What a model's new responses to a record change in the counts of its cells.

    The state is packed JSON: the record's items so far, and for each cell how many count and are robust without and with the
    model knowing the answer. An item counts once, as it came first. A right probe that comes late turns the items before
    it, so what they had counted is taken back.
    """
    held = json.loads(zlib.decompress(state.get[0])) if state.exists else {"knows": False, "items": [], "cells": []}
    seen, cells = set(held["items"]), {tuple(c): n for c, n in held["cells"]}
    before, knew = {c: list(n) for c, n in cells.items()}, held["knows"]
    for pdf in frames:
        for item, counts, *cell, plain, known, knows in zip(*(pdf[c].tolist() for c in ("item_id", "for_metric", *CELL, "robust", "robust_known", "knows")), strict=True):
            if item in seen:
                continue
            seen.add(item)
            held["items"].append(item)
            held["knows"] = held["knows"] or bool(knows)
            if counts:
                n = cells.setdefault(tuple(x if isinstance(x, str) else None for x in cell), [0, 0, 0])
                n[0] += 1
                n[1] += int(plain)
                n[2] += int(known)
    held["cells"] = list(cells.items())
    state.update((zlib.compress(json.dumps(held).encode()),))
    none = [0, 0, 0]
    changed = [(key[0], *c, n[0] - before.get(c, none)[0], n[1 + held["knows"]] - before.get(c, none)[1 + knew]) for c, n in cells.items()]
    rows = [c for c in changed if c[-2] or c[-1]]
    yield pd.DataFrame({name: [c[i] for c in rows] for i, name in enumerate(("model", *CELL, "n", "robust"))})


def track_metrics(responses: DataFrame, items: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes, batch by batch, the changes of the metrics below path; a batch that runs again replaces its own folder."""
    judged = judged_items(answered(responses.where("response is not null"), items))
    changes = judged.groupBy("model", "record_id").applyInPandasWithState(changed_cells, CELL_CHANGES, "held binary", "update", "NoTimeout")

    def put(batch: DataFrame, number: int) -> None:
        cells = batch.groupBy("model", *CELL).agg(F.sum("n").alias("n"), F.sum("robust").alias("robust"))
        named = cells.select("model", F.explode(metric_names()).alias("metric"), "n", "robust")
        named.groupBy("model", "metric").agg(F.sum("n").alias("n"), F.sum("robust").alias("robust")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def metrics_tracked(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, value) of all batches so far, from their changes; as ``evaluation.robustness`` gives it."""
    sums = spark.read.schema(CHANGES + ", batch long").parquet(path).groupBy("model", "metric").agg(F.sum("n").alias("n"), F.sum("robust").alias("robust"))
    always = F.explode(F.array(*map(F.lit, ("overall_robustness", "query_robustness", "doc_robustness")))).alias("metric")
    every = sums.select("model").distinct().select("model", always).join(sums, ["model", "metric"], "full")
    return every.select("model", "metric", F.round(F.coalesce(F.col("robust") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias("value"))


def windowed_counts(events: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of their own time; later ones than the watermark are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
