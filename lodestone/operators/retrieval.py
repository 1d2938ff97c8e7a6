"""Exact vector search, reranking and hits.

The queries are a stated set that meets all vectors in blocks: packs of either side are dealt to the cluster as a grid
(``operators.grid``), each cell keeps its own best k of each query, and a ranking that cuts each task's share first merges them. Nothing
but three counts passes through the driver, and no table of pairs exists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.grid import grid, packed, packs_of

METRICS = ("dot", "l2", "cosine")
#: Queries that one matrix of scores holds.
TILE = 128
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer."""
    if metric == "l2":
        return -((queries * queries).sum(axis=1)[:, None] - 2 * queries @ rows.T + (rows * rows).sum(axis=1)[None, :])
    if metric == "cosine":
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return queries @ rows.T


def _pack(t: pa.Table) -> dict:
    flat = pc.list_flatten(t.column("embedding")).combine_chunks()
    return {"ids": np.asarray(t.column("vec_id")).astype(np.int64).tobytes(), "x": np.asarray(flat).astype(np.float64).tobytes()}


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["x"], np.float64).reshape(len(ids), -1)


def best_of(scores: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int, other: bool) -> tuple[np.ndarray, ...]:
    """(query ids, ids, scores) of each row's k largest scores, ties by id; other leaves a row's own id out."""
    if other:
        scores = np.where(asked[:, None] == ids[None, :], -np.inf, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        at, place = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        at, place = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[place], -scores[at, place], at))
    at, place = at[order], place[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    at, place = at[nth < k], place[nth < k]
    return asked[at], ids[place], scores[at, place]


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "dot", other: bool = True, block: int = 1024, digits: int = 6, row_block: int = 16_384) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k nearest vectors of each query, ties by vec_id; other leaves the query's own id out.

    queries and vectors: vec_id, a whole number that is kept exactly, and embedding, all of one length. Scores are rounded to
    digits before they rank; of l2 they are distances. block, row_block: rows of a pack of queries and of vectors.
    """
    if metric not in METRICS:
        raise ValueError(f"metric {metric} is none of {METRICS}")
    whole = "vec_id is not null and embedding is not null"
    asked, rows = (df.where(whole).select(F.col("vec_id").cast("long"), "embedding") for df in (queries, vectors))
    lefts, rights = packs_of(asked.count(), block), packs_of(rows.count(), row_block)

    def cell(left: dict, right: dict) -> pa.Table:
        (names, q), (ids, x) = _arrays(left), _arrays(right)
        found = [best_of(np.round(_scores(q[i : i + TILE], x, metric), digits), names[i : i + TILE], ids, k, other) for i in range(0, len(names), TILE)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], schema=FOUND)

    kept = "ids binary, x binary"
    out = grid(packed(asked, lefts, _pack, kept), lefts, packed(rows, rights, _pack, kept), rights, cell, "query_id long, vec_id long, score double", FOUND)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.withColumn("score", -F.col("score") + F.lit(0.0)) if metric == "l2" else ranked


def rerank(ranked: DataFrame, pair_score: str, keep: int = 3) -> DataFrame:
    """The keep best of each query's ranked rows by pair score, the earlier rank of equals."""
    own = Window.partitionBy("query_id").orderBy(F.desc(pair_score), "rank")
    return ranked.withColumn("final_rank", F.row_number().over(own)).where(F.col("final_rank") <= keep)


def hit_any(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, hit): one of the found ids (array found) is one of the true ones (array truth)."""
    return found.join(truth, key).select(key, F.coalesce(F.arrays_overlap("found", "truth"), F.lit(False)).alias("hit"))
