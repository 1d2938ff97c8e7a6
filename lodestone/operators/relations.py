"""Relation names made canonical by leader clustering in the order of arrival; sentences found in their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.ranking import numbered
from lodestone.sources.folders import shared_path


#: Distinct names of a scope that one round takes, and rows whose scores are held at once.
BLOCK, TILE = 4096, 512
#: Scores are rounded, so that they don't depend on how a product was summed.
DIGITS = 9


def leaders(vectors: np.ndarray, above: float = 0.9) -> np.ndarray:
    """For each vector in turn the place of the nearest leader by dot product if it is strictly above the bound, else its own: it leads."""
    n = len(vectors)
    return fold_block(np.arange(n), vectors, np.full(n, -np.inf), np.zeros(n, np.int64), above)


def nearest(vectors: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's largest score with what is held, and the first place that has it."""
    score, at = np.empty(len(vectors)), np.empty(len(vectors), np.int64)
    for low in range(0, len(vectors), TILE):
        near = np.round(vectors[low : low + TILE] @ held.T, DIGITS)
        at[low : low + TILE] = near.argmax(axis=1)
        score[low : low + TILE] = near.max(axis=1)
    return score, at


def fold_block(places: np.ndarray, vectors: np.ndarray, score: np.ndarray, leader: np.ndarray, above: float) -> np.ndarray:
    """The leaders of a block of consecutive vectors whose nearest earlier leader (score, leader) is known.

    Only vectors without one above the bound can lead, so only they are folded one by one; then each vector takes the
    best new leader before it, if that is better than its earlier one.
    """
    out, open_ = leader.copy(), np.flatnonzero(score <= above)
    held, led = np.empty((len(open_), vectors.shape[1] if vectors.ndim > 1 else 0)), []
    for i in open_.tolist():
        if not led or np.round(held[: len(led)] @ vectors[i], DIGITS).max() <= above:
            held[len(led)] = vectors[i]
            led.append(i)
    new = np.array(led, np.int64)
    for low in range(0, len(vectors) if led else 0, TILE):
        near = np.round(vectors[low : low + TILE] @ held[: len(led)].T, DIGITS)
        near[new[None, :] >= np.arange(low, low + len(near))[:, None]] = -np.inf
        best = near.argmax(axis=1)
        most = near[np.arange(len(near)), best]
        better = (most > above) & (most > score[low : low + TILE])
        out[low : low + TILE] = np.where(better, places[new[best]], out[low : low + TILE])
    out[new] = places[new]
    return out


def canonical(relations: DataFrame, above: float = 0.9, block: int = BLOCK) -> DataFrame:
    """(scope, relation, leader) of relations (scope, relation, vector, seq): what the fold of ``leaders`` gives in the order of seq.

    Equal names take their first row. Names are taken in rounds of block names a scope: each meets the leaders of all
    earlier rounds in parallel, in packs of one round's leaders of one scope, and only what none of them is near enough to is folded in
    one task, at most block names. So no task holds a scope, and rounds are as many as the largest scope has blocks.
    """
    spark = relations.sparkSession
    distinct = relations.groupBy("scope", "relation").agg(F.min_by("vector", "seq").alias("vector"), F.min("seq").alias("seq"))
    placed = numbered(distinct, ["scope"], "seq", "place").select("scope", "relation", F.col("vector").cast("array<double>").alias("vector"), F.col("place").cast("long"), F.floor(F.col("place") / block).cast("int").alias("round"))
    root = shared_path(spark, "leaders")
    placed.write.partitionBy("round").parquet(f"{root}/names")
    names = spark.read.schema(placed.schema).parquet(f"{root}/names")
    rounds = names.agg(F.max("round")).first()[0]
    if rounds is None:
        return relations.select("scope", "relation", F.col("relation").alias("leader")).limit(0)
    scope, kind = (relations.schema[c].dataType.simpleString() for c in ("scope", "relation"))
    schema = f"scope {scope}, relation {kind}, place long, leader long, vector array<double>, round int"

    def matrix(x: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(pc.list_flatten(x.combine_chunks())).reshape(len(x), -1)

    def whole(t: pa.Table, columns: dict) -> pa.Table:
        return pa.table([t.column(c).combine_chunks() if v is None else pa.array(v) for c, v in columns.items()], names=list(columns))

    def near(own: pa.Table, held: pa.Table) -> pa.Table:
        if not own.num_rows or not held.num_rows:
            return whole(own.slice(0, 0), {"scope": None, "place": None, "score": np.zeros(0), "leader": np.zeros(0, np.int64)})
        held = held.sort_by("place")
        score, at = nearest(matrix(own.column("vector")), matrix(held.column("vector")))
        return whole(own, {"scope": None, "place": None, "score": score, "leader": np.asarray(held.column("place"))[at]})

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        places = np.asarray(t.column("place"))
        score, known = np.asarray(pc.fill_null(t.column("score"), -np.inf)), np.asarray(pc.fill_null(t.column("leader"), -1))
        found = fold_block(places, matrix(t.column("vector")), score, known, above)
        kept = pc.if_else(pa.array(found == places), t.column("vector").combine_chunks(), None)
        return pa.table([*(t.column(c).combine_chunks() for c in ("scope", "relation", "place")), pa.array(found), kept, t.column("round").combine_chunks()], names=["scope", "relation", "place", "leader", "vector", "round"])

    for r in range(rounds + 1):
        own = names.where(F.col("round") == r)
        best = spark.createDataFrame([], f"scope {scope}, place long, score double, leader long")
        if r:
            held, packs = (spark.read.schema(schema).parquet(*(f"{root}/found/{k}" for k in range(r))).where("vector is not null").withColumnRenamed("round", "pack") for _ in range(2))
            packs = packs.select(F.col("scope").alias("_s"), "pack").distinct()
            asked = own.join(packs, F.col("scope").eqNullSafe(F.col("_s"))).drop("_s")
            cells = asked.groupBy("scope", "pack").cogroup(held.groupBy("scope", "pack")).applyInArrow(near, f"scope {scope}, place long, score double, leader long")
            first = F.max(F.struct("score", (-F.col("leader")).alias("earlier")))
            best = cells.groupBy("scope", "place").agg(first.alias("b")).select("scope", "place", "b.score", (-F.col("b.earlier")).alias("leader"))
        known = best.select(F.col("scope").alias("_s"), F.col("place").alias("_p"), "score", "leader")
        joined = own.join(known, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_p")), "left").drop("_s", "_p")
        joined.groupBy("scope").applyInArrow(fold, schema).write.mode("overwrite").parquet(f"{root}/found/{r}")
    every = spark.read.schema(schema).parquet(*(f"{root}/found/{k}" for k in range(rounds + 1)))
    lead = every.where("vector is not null").select(F.col("scope").alias("_s"), F.col("place").alias("_p"), F.col("relation").alias("_name"))
    return every.join(lead, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("leader") == F.col("_p"))).select("scope", "relation", F.col("_name").alias("leader"))


#: Chunks of a document that one automaton run reads, sentences (and their characters) that one automaton holds.
CHUNK_PACK, HELD, HELD_CHARS = 4096, 20_000, 1 << 22


def first_holders(texts: list[str], sentences: list[str]) -> list[int | None]:
    """For each sentence the place of the first text that holds it: one pass of an Aho-Corasick automaton over the texts."""
    import ahocorasick

    found: dict[str, int | None] = dict.fromkeys(sentences)
    if "" in found and texts:
        found[""] = 0
    automaton = ahocorasick.Automaton()
    for s in found:
        if s:
            automaton.add_word(s, s)
    left = len(automaton)
    if left:
        automaton.make_automaton()
        for i, text in enumerate(texts):
            for _, s in automaton.iter(text):
                if found[s] is None:
                    found[s] = i
                    left -= 1
            if not left:
                break
    return [found[s] for s in sentences]


def located(sentences: DataFrame, chunks: DataFrame) -> DataFrame:
    """sentences (doc_id, sentence, and what tells them apart) without their text but with chunk_id, the document's first chunk (by pos, a whole number) that holds the sentence.

    Both are normalised. A document's chunks, in packs of CHUNK_PACK, and its sentences meet in one sorted stream of a task: the
    pack is held, then automata of a bounded number of sentences each read it once, so the work grows with the length of the texts
    and not with sentences times chunks. Texts are shuffled once; only the sentences of documents of several packs are copied to each. Sentences without a character but blanks, and those that no chunk holds, go.
    """
    from lodestone.functions.text import normalize_text

    names = [c for c in sentences.columns if c != "sentence"]
    own = sentences.where(F.col("doc_id").isNotNull() & (F.length(F.trim("sentence")) > 0)).select(F.col("doc_id").alias("_doc"), F.struct(*names).alias("_row"), normalize_text(F.col("sentence")).alias("_text"))
    texts = chunks.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("_doc"), F.floor(F.coalesce("pos", F.lit(0)) / CHUNK_PACK).alias("_pack"), F.col("pos").cast("long").alias("_pos"), "chunk_id", normalize_text(F.col("text")).alias("_text"))
    asked, more = own.withColumn("_pack", F.lit(0).cast("long")), texts.where("_pack <> 0").select("_doc", "_pack").distinct()
    if not more.isEmpty():
        asked = asked.unionByName(own.join(more, "_doc"))
    both = texts.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("_doc", "_pack").sortWithinPartitions("_doc", "_pack", "_side", "_pos").select("_doc", "_pack", "_side", "_pos", "chunk_id", "_text", "_row")
    ids, row = chunks.schema["chunk_id"].dataType, dealt.schema["_row"].dataType
    schema = T.StructType([T.StructField("_row", row), T.StructField("_pos", T.LongType()), T.StructField("chunk_id", ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, key, held, open_, size = None, None, [], [], 0

        def found() -> pa.RecordBatch:
            at = first_holders([t for _, _, t in held], [t for t, _ in open_])
            hits = [(r, *held[i][:2]) for (_, r), i in zip(open_, at) if i is not None]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits) if hits else ((), (), ()), kinds)], ["_row", "_pos", "chunk_id"])

        for batch in batches:
            kinds = kinds or [batch.schema.field(n).type for n in ("_row", "_pos", "chunk_id")]
            for doc, pack, side, pos, chunk, text, r in zip(*(c.to_pylist() for c in batch.columns)):
                if (doc, pack) != key or len(open_) >= HELD or size >= HELD_CHARS:
                    if open_:
                        yield found()
                    open_, size = [], 0
                    if (doc, pack) != key:
                        key, held = (doc, pack), []
                if side:
                    open_.append((text, r))
                    size += len(text)
                else:
                    held.append((pos, chunk, text))
        if open_:
            yield found()

    hits = dealt.mapInArrow(run, schema)
    return hits.groupBy("_row").agg(F.min_by("chunk_id", "_pos").alias("chunk_id")).select("_row.*", "chunk_id")
