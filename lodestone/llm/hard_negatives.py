"""Hard negatives by product quantisation with residual bounds.

Vectors become integers, floor(scale * x), and scores are their exact inner products. Each row keeps the codes of
its nearest integer centroids, two components each, and the norm of what they leave. For an anchor a, a table of
products with all centroids gives a row's score by lookups, and the row's true score differs from it by at most
|a| times the residual norm (Cauchy and Schwarz). So lower and upper bounds are certain: rows surely in a window give
the least score that its best k can have, rows whose bounds miss the window or stay below that score are left out, and
the exact products of the others complete the window. All numbers are integers but the norms, which are rounded up.

The anchors are a stated query set and meet all rows in blocks, as a grid that the cluster deals (``operators.grid``):
each cell gives its own best k of each window, which are merged by a ranking that cuts each task's share first. Anchors
are mined twice, for their positives and, with the windows these give, for their negatives.

Documented bound: the centroids are fitted on at most ``sample`` rows (those of least hash); they change the
work, not the result. Rows with a null id, label or vector, or a null or non-finite component take no part; a missing
component of a shorter vector counts as zero. Components must stay under 2^26 after scaling, else the query fails with a
message. Rows that repeat an id are rows of their own: each may be the other's positive, and each is an anchor. Equal scores
are ordered by id. Fewer rows than asked for: all of them. Empty tables and tables without anchors give no rows. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored
from lodestone.operators.grid import grid, packed, packs_of

WIDTH, CENTROIDS, ROUNDS = 2, 256, 6
LARGEST = 1 << 26
#: Anchors that share one lookup table.
TILE = 64
ROW_PACK, ANCHOR_PACK = 8192, 1024


def integer_rows(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, x) of the rows that take part."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # false for NaN, which is the largest
    held = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    out = held.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), whole.alias("x"))
    large = F.exists("x", lambda c: F.abs(c) >= LARGEST)
    return out.withColumn("x", F.when(large, F.raise_error(F.lit(f"a component is 2^26 or more after scaling by {scale}"))).otherwise(F.col("x")).cast("array<int>"))


def matrix(x: pa.ChunkedArray, dims: int) -> np.ndarray:
    """The lists as rows of dims integers, filled up with zeros."""
    sizes = np.asarray(pc.list_value_length(x)).astype(np.int64)
    flat = np.asarray(pc.list_flatten(x)).astype(np.int64)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    c = centroids.astype(np.float64)
    return ((c * c).sum(axis=1) - 2 * (x.astype(np.float64) @ c.T)).argmin(axis=1)


def train(rows: np.ndarray, seed: int = 7) -> np.ndarray:
    """Integer centroids (parts, CENTROIDS, WIDTH) by Lloyd's rounds over each part of the sample."""
    rng = np.random.default_rng(seed)
    parts = rows.shape[1] // WIDTH
    out = np.zeros((parts, CENTROIDS, WIDTH), np.int64)
    for p in range(parts):
        x = rows[:, p * WIDTH : (p + 1) * WIDTH]
        if not len(x):
            continue
        c = x[rng.permutation(len(x))[np.arange(CENTROIDS) % len(x)]].astype(np.float64)
        for _ in range(ROUNDS):
            own = _nearest(x, c)
            n = np.bincount(own, minlength=CENTROIDS)
            for d in range(WIDTH):
                c[:, d] = np.where(n > 0, np.bincount(own, x[:, d], CENTROIDS) / np.maximum(n, 1), c[:, d])
        out[p] = np.rint(c)
    return out


def encode(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and residual norms, rounded up."""
    codes = np.empty((len(rows), len(books)), np.uint8)
    left = np.zeros(len(rows))
    for p, c in enumerate(books):
        x = rows[:, p * WIDTH : (p + 1) * WIDTH]
        codes[:, p] = own = _nearest(x, c)
        rest = (x - c[own]).astype(np.float64)
        left += (rest * rest).sum(axis=1)
    return codes, _up(np.sqrt(left))


def _up(x: np.ndarray) -> np.ndarray:
    """x with room for the rounding of sums and roots: sums of squares here have at most 2^-40 of relative error."""
    return x * (1 + 2.0**-38) + 2.0**-38


def lookup_scores(anchors: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(rows, anchors): scores with the rows' centroids, summed from a table of each part's products."""
    parts = len(books)
    own = anchors.reshape(len(anchors), parts, WIDTH).transpose(1, 2, 0)
    tables = books @ own  # (parts, CENTROIDS, anchors)
    if parts and np.abs(tables).max(initial=0) * parts < 1 << 31:
        tables = tables.astype(np.int32)
    out = np.zeros((len(codes), len(anchors)), tables.dtype)
    for p in range(parts):
        out += tables[p].take(codes[:, p], axis=0)
    return out.astype(np.int64)


def best_in_window(low: np.ndarray, high: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
    """Places that can be among the k largest scores within [least, most], from certain bounds of the scores."""
    open_ = (high >= least) & (low <= most)
    sure = low[(low >= least) & (high <= most)]
    if len(sure) >= k:
        open_ &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
    return np.flatnonzero(open_)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Pack:
    """A pack of rows, sorted by label."""

    def __init__(self, row: dict, dims: int, parts: int):
        self.own = np.frombuffer(row["own"], np.int64)
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(row["x"], np.int32).reshape(n, dims)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(n, parts)
        self.norms = np.frombuffer(row["norms"], np.float64)

    def exact(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.x[places].astype(np.int64) @ anchor


def _bounds(est: np.ndarray, anchor: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = anchor.astype(np.float64)
    room = np.floor(_up(_up(np.sqrt(a @ a)) * norms)).astype(np.int64) + 1
    return est - room, est + room


def hard_negatives(rows: DataFrame, anchors_of: str, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, sample: int = 4096, row_pack: int = ROW_PACK, anchor_pack: int = ANCHOR_PACK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchors_of: the condition on id that makes a row an anchor. An anchor's positives are its best rows of the same
    label, a positive's negatives the best rows of other labels with least % to most % of its score.
    """
    own = integer_rows(rows, key, vector, label, scale)
    seen = own.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.count(F.when(F.expr(anchors_of), 1)).alias("anchors")).first()
    dims = -(-(seen["dims"] or 0) // WIDTH) * WIDTH
    lefts, rights, parts = packs_of(seen["anchors"], anchor_pack), packs_of(seen["n"], row_pack), dims // WIDTH
    learnt = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("x").toArrow().column("x")  # at most sample rows
    books = train(matrix(learnt, dims))
    shared = rows.sparkSession.sparkContext.broadcast(books)  # dims / 2 times 256 centroids

    def build(t: pa.Table) -> dict:
        from pyspark import TaskContext

        order = np.argsort(np.asarray(t.column("label")), kind="stable")
        x = matrix(t.column("x"), dims)[order]
        codes, norms = encode(x, shared.value)
        here = (np.int64(TaskContext.get().partitionId()) << 32) + np.arange(len(x))
        return {"own": here.tobytes(), "ids": np.asarray(t.column("id"))[order].tobytes(), "labels": np.asarray(t.column("label"))[order].tobytes(), "x": x.astype(np.int32).tobytes(), "codes": codes.tobytes(), "norms": norms.tobytes()}

    table = stored(packed(own, rights, build, "own binary, ids binary, labels binary, x binary, codes binary, norms binary"), "codes")
    anchors = stored(_unpacked(table, dims).where(F.expr(anchors_of)), "anchors")  # under the identities that the packs gave their rows

    near = grid(_anchor_packs(anchors, lefts, dims), lefts, table, rights, _same_label(dims, parts, shared, positives), "own long, other long, score long", pa.schema([("own", pa.int64()), ("other", pa.int64()), ("score", pa.int64())]))
    place = Window.partitionBy("own").orderBy(F.desc("score"), "other")
    chosen = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
    windows = chosen.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("place", "other", "score"))).alias("positives"))  # at most positives each
    asked = stored(anchors.join(windows, "own"), "windows")

    kept = "own long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    types = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.int64()) for x in kept.split(", ")])
    far = grid(_anchor_packs(asked, lefts, dims), lefts, table, rights, _other_labels(dims, parts, shared, negatives, least, most, types), kept, types)
    rank = F.row_number().over(Window.partitionBy("own", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _unpacked(table: DataFrame, dims: int) -> DataFrame:
    """(own, id, label, x) of packs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"]) // 8
                x = pa.array(np.frombuffer(row["x"], np.int32).reshape(n, dims).tolist() if dims else [[]] * n, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.frombuffer(row[c], np.int64)) for c in ("own", "ids", "labels")), x], ["own", "id", "label", "x"])

    return table.select("own", "ids", "labels", "x").mapInArrow(run, "own long, id long, label long, x array<int>")


def _anchor_packs(anchors: DataFrame, packs: int, dims: int) -> DataFrame:
    """Packs of anchors, sorted by label, with their positives where there are any."""

    def build(t: pa.Table) -> dict:
        order = np.argsort(np.asarray(t.column("label")), kind="stable")
        out = {"own": np.asarray(t.column("own")), "ids": np.asarray(t.column("id")), "labels": np.asarray(t.column("label")), "x": matrix(t.column("x"), dims)}
        out = {k: np.ascontiguousarray(v[order]).tobytes() for k, v in out.items()}
        if "positives" in t.column_names:
            told = t.column("positives").to_pylist()
            listed = [(i, p["place"], p["other"], p["score"]) for i, j in enumerate(order.tolist()) for p in told[j]]
            out["positives"] = np.array(listed, np.int64).reshape(-1, 4).tobytes()
        return out

    more = ", positives binary" if "positives" in anchors.columns else ""
    return packed(anchors, packs, build, "own binary, ids binary, labels binary, x binary" + more)


def _anchor_arrays(row: dict, dims: int) -> tuple[np.ndarray, ...]:
    own, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("own", "ids", "labels"))
    return own, ids, labels, np.frombuffer(row["x"], np.int64).reshape(len(own), dims)


def _same_label(dims: int, parts: int, shared, k: int):
    def cell(left: dict, right: dict) -> pa.Table:
        own, _, labels, x = _anchor_arrays(left, dims)
        rows, found = Pack(right, dims, parts), []
        for label in np.unique(labels).tolist():
            low, high = np.searchsorted(rows.labels, [label, label + 1])
            mine = np.flatnonzero(labels == label)
            for at in range(0, len(mine) if low < high else 0, TILE):
                tile = mine[at : at + TILE]
                scores = lookup_scores(x[tile], shared.value, rows.codes[low:high])
                for t, i in enumerate(tile.tolist()):
                    few, much = _bounds(scores[:, t], x[i], rows.norms[low:high])
                    places = low + best_in_window(few, much, np.iinfo(np.int64).min, np.iinfo(np.int64).max, k + 1)  # one may be the anchor itself
                    places = places[rows.own[places] != own[i]]
                    exact = rows.exact(places, x[i])
                    best = _first(exact, rows.ids[places], k)
                    found.append((np.full(len(best), own[i]), rows.ids[places][best], exact[best]))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("own", "other", "score"), columns)))

    return cell


def _other_labels(dims: int, parts: int, shared, k: int, least: int, most: int, types: pa.Schema):
    def cell(left: dict, right: dict) -> pa.Table:
        own, ids, labels, x = _anchor_arrays(left, dims)
        rows, found = Pack(right, dims, parts), []
        listed = np.frombuffer(left["positives"], np.int64).reshape(-1, 4)
        ends = np.searchsorted(listed[:, 0], np.arange(len(own) + 1))
        for at in range(0, len(own), TILE):
            scores = lookup_scores(x[at : at + TILE], shared.value, rows.codes)
            for i in range(at, min(at + TILE, len(own))):
                few, much = _bounds(scores[:, i - at], x[i], rows.norms)
                low, high = np.searchsorted(rows.labels, [labels[i], labels[i] + 1])
                few[low:high] = much[low:high] = np.iinfo(np.int64).min  # the anchor's label is in no window
                for _, place, other, score in listed[ends[i] : ends[i + 1]].tolist():
                    bottom, top = -(-least * score // 100), most * score // 100
                    places = best_in_window(few, much, bottom, top, k)
                    exact = rows.exact(places, x[i])
                    inside = np.flatnonzero((exact >= bottom) & (exact <= top))
                    best = inside[_first(exact[inside], rows.ids[places][inside], k)]
                    n = len(best)
                    found.append((np.full(n, own[i]), np.full(n, place), np.full(n, ids[i]), np.full(n, other), np.full(n, score), rows.ids[places][best], exact[best]))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(types)
        return pa.table([pa.array(c.astype(np.int32 if t.type == pa.int32() else np.int64)) for c, t in zip(columns, types)], schema=types)

    return cell
