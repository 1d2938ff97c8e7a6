"""SimHash near-duplicates, linked by the generalised pigeonhole.

The 64 bits are grouped into parts so that correlated bits share a part. If a fingerprint's thresholds t over the
parts sum to tau - parts + 1, every fingerprint within tau of it is within t of it in at least one part. Dynamic
programming allocates each fingerprint its own thresholds (-1 skips a part) by estimated candidate counts; it then
probes the parts' values within them, and the candidates are verified on all 64 bits.

A part's value that more than ``dense`` distinct fingerprints share is not paired out: its members and those that
probe it are linked through the fingerprints at one differing bit, since two within 2 bits share such a neighbour.
That covers the same links with 65 rows each. Other thresholds than 0 to 2 have no such way and are refused.

Estimates are counts of all fingerprints in tables of fixed size. Equal fingerprints are one node. Null or empty
text has fingerprint zero and is linked like any other. A null doc_id names no component; a component of null ids
alone has a null id. Repeated rows are kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_blocks, release, shared_path, sieve, sifted, stored, text_column
from lodestone.llm.components import components
from lodestone.llm.rolling import mix

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CELLS = 1 << 16
ONE = np.uint64(1)


def shingle_hashes(text: str, size: int, seed: int = 42) -> list[int]:
    words = text.encode().translate(LOWER).split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined, at, ends = b" ".join(words), 0, []
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)]


def fingerprints_of(texts: list[str], size: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text; a bit is set if over half of the shingles' hashes have it."""
    return fingerprint_hashes([shingle_hashes(t, size) for t in texts])


def fingerprint_hashes(hashes: list[list[int]]) -> np.ndarray:
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.array([x for h in hashes for x in h], np.uint64)
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum(counts[some]) - counts[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > counts[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches):
            fp = fingerprints_of(text_column(batch).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_table(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def summed(df: DataFrame, count) -> dict[int, int]:
    """Sums over all fps of what count gives for an array of them, by its index: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for low in range(0, len(fps), 1 << 17):
                got = count(fps[low : low + (1 << 17)])
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["k", "n"])

    return {r["k"]: r["n"] for r in df.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}


def together(fps: np.ndarray) -> np.ndarray:
    bits = bit_table(fps).astype(np.float64)
    return (bits.T @ bits).ravel().astype(np.int64)


def parts_of(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in parts of equal size; each part grows by the bit that is most correlated with those it has."""
    share = counts / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (tie[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def masks(parts: list[list[int]]) -> list[np.uint64]:
    return [np.uint64(sum(1 << b for b in own)) for own in parts]


def cell(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(48)).astype(np.int64)


def flips(values: np.ndarray, own: list[int], times: int) -> np.ndarray:
    """(values, variants) with at most times bits of own turned."""
    turn = [0, *(1 << b for b in own)] if times else [0]
    if times == 2:
        turn += [1 << a | 1 << b for i, a in enumerate(own) for b in own[:i]]
    return values[:, None] ^ np.array(turn, np.uint64)[None, :]


def allocate(fps: np.ndarray, parts: list[list[int]], tables: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (fps, parts) of least estimated cost, and that cost: probes plus candidates."""
    goal, least = tau - len(parts) + 1, -len(parts)
    span = goal - least + 1 + 3 * len(parts)
    best = np.full((len(fps), span), np.inf)
    best[:, -least] = 0
    chosen = []
    for k, (own, mask) in enumerate(zip(parts, masks(parts), strict=True)):
        values = fps & mask
        cost = {-1: np.zeros(len(fps))}
        for t in range(tau + 1):
            if t == 2 and len(own) > 24:
                continue  # hundreds of probes never pay
            probes = flips(values, own, t)
            cost[t] = tables[k][cell(probes.ravel())].reshape(probes.shape).sum(axis=1) + probes.shape[1]
        now = np.full_like(best, np.inf)
        pick = np.full(best.shape, -1, np.int8)
        for t, c in cost.items():
            moved = np.full_like(best, np.inf)
            if t < 0:
                moved[:, :-1] = best[:, 1:]
            elif t == 0:
                moved[:] = best
            else:
                moved[:, t:] = best[:, :-t]
            moved += c[:, None]
            better = moved < now
            now[better], pick[better] = moved[better], t
        best = now
        chosen.append(pick)
    at = np.full(len(fps), goal - least)
    out = np.empty((len(fps), len(parts)), np.int8)
    for k in range(len(parts) - 1, -1, -1):
        out[:, k] = chosen[k][np.arange(len(fps)), at]
        at = at - out[:, k]
    return out, best[:, goal - least]


def keyed(fps: DataFrame, parts: list[list[int]], tables, tau: int | None) -> DataFrame:
    """(part, value, fp): every part's value, or with tau the values that each fingerprint probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for low in range(0, len(every), 1 << 13):
                values = every[low : low + (1 << 13)]
                chosen = np.zeros((len(values), len(parts)), np.int8) if tau is None else allocate(values, parts, tables.value, tau)[0]
                for k, (own, mask) in enumerate(zip(parts, masks(parts), strict=True)):
                    for t in np.unique(chosen[:, k]).tolist():
                        if t >= 0:
                            mine = values[chosen[:, k] == t]
                            probes = flips(mine & mask, own, t)
                            fp = np.repeat(mine, probes.shape[1])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int32)), pa.array(probes.ravel().view(np.int64)), pa.array(fp.view(np.int64))], ["part", "value", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, value long, fp long")


def near(fps: DataFrame) -> DataFrame:
    """(u, v) of fingerprints that share one at most one bit away, through the least of each such group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for low in range(0, len(every), 1 << 13):
                values = every[low : low + (1 << 13)]
                probes = flips(values, list(range(64)), 1)
                yield pa.RecordBatch.from_arrays([pa.array(probes.ravel().view(np.int64)), pa.array(np.repeat(values, 65).view(np.int64))], ["value", "fp"])

    hubs = fps.select("fp").mapInArrow(run, "value long, fp long").groupBy("value").agg(F.min("fp").alias("u"), F.max("fp").alias("most"))
    shared = hubs.where("u <> most").select("value", "u")
    return fps.select("fp").mapInArrow(run, "value long, fp long").join(shared, "value").where("fp <> u").select("u", F.col("fp").alias("v")).distinct()


def links(fps: DataFrame, tau: int = 2, dense: int = 64) -> DataFrame:
    """(u, v): a link between distinct fingerprints at most tau bits apart; dense values are linked through hubs.

    fps: a stored table of distinct values in column fp.
    """
    if not 0 <= tau <= 2:
        raise ValueError("thresholds of 0, 1 or 2 bits")
    spark = fps.sparkSession
    n = fps.count()
    counts = np.zeros(64 * 64)
    for k, v in summed(fps, together).items():
        counts[k] = v
    options = []
    for m in (2, 3):
        parts = parts_of(counts.reshape(64, 64), n, m)
        own = masks(parts)
        got = summed(fps, lambda x, own=own: np.concatenate([np.bincount(cell(x & mask), minlength=CELLS) for mask in own]))
        tables = np.zeros(m * CELLS)
        tables[list(got)] = list(got.values())
        # what a fingerprint costs on average, over a bounded sample
        some = np.array([r["fp"] for r in fps.limit(2000).collect()], np.int64).view(np.uint64)
        options.append((allocate(some, parts, tables.reshape(m, CELLS), tau)[1].mean() if len(some) else 0, m, parts, tables.reshape(m, CELLS)))
    _, _, parts, tables = min(options, key=lambda x: x[:2])
    shared = spark.sparkContext.broadcast(tables)  # parts x CELLS counts
    index, probes = keyed(fps, parts, None, None), keyed(fps, parts, shared, tau)
    hot = stored(index.groupBy("part", "value").count().where(F.col("count") > dense).select("part", "value"), "hot")
    pairs = probes.join(hot, ["part", "value"], "left_anti").withColumnRenamed("fp", "u").join(index.withColumnRenamed("fp", "v"), ["part", "value"])
    pairs = pairs.where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau)).select("u", "v").distinct()
    if hot.isEmpty():
        return pairs
    crowd = stored(index.unionByName(probes).join(hot, ["part", "value"], "left_semi").select("fp").distinct(), "crowd")
    through = near(crowd)
    if tau < 2:  # a hub joins fingerprints two bits apart: keep those that are near enough, by direct neighbours
        through = near_exact(crowd, tau)
    return pairs.unionByName(through)


def near_exact(fps: DataFrame, tau: int) -> DataFrame:
    """(u, v) at most tau (0 or 1) bits apart: each looks its neighbours up."""
    if tau == 0:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    around = fps.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(1).cast("long") * F.shiftleft(F.lit(1).cast("long"), b)) for b in range(64)))).alias("v"))
    return around.join(fps.select(F.col("fp").alias("v")), "v").where("fp < v").select(F.col("fp").alias("u"), "v")


def grouped(docs: DataFrame, size: int = 3, tau: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text)."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = components(links(distinct, tau))
    named = distinct.join(rooted, distinct["fp"] == rooted["node"]).select("fp", "first", "root")
    least = named.groupBy("root").agg(F.min("first").alias("joint"))
    label = distinct.join(named.select("fp", "root"), "fp", "left").join(least, "root", "left").select("fp", F.coalesce("joint", "first").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 3, tau: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    return grouped(docs, size, tau).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Documents of a given similarity

#: A shingle that more texts share is crowded: its texts are first linked through a few of them, then paired in squares.
PAIRED = 16
#: Texts of a crowded shingle on each side of a square.
SIDE = 256
#: Shingles of the most sampled texts come last in the order of shingles: at most so many, each in so many sampled texts.
COMMON, OFTEN = 1 << 16, 8


def prefix_of(hashes: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's shingles in an order that holds for all texts: common ones last, else by hash.

    A set at least that similar shares ceil(least n) of the n shingles, so it has one of the first n - ceil(least n) + 1.
    """
    if not len(hashes):
        return np.zeros(1, np.int64)  # texts without words
    if len(common):
        last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-6)) + 1].view(np.int64)


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def similarity(a: str, b: str, size: int) -> float:
    """Jaccard similarity of two texts' shingles; of two without words 1."""
    x, y = set(shingle_hashes(a, size)), set(shingle_hashes(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def common_shingles(keyed_docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of one text in eight: a table of bounded size. It orders, and drops nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, trim=True):
            own = [shingle_set(t, size) for t in text_column(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["token"])

    counts = keyed_docs.where("pmod(t1, 8) = 0").select("text").mapInArrow(run, "token long").groupBy("token").count()
    rows = counts.where(F.col("count") > OFTEN).orderBy(F.desc("count"), "token").limit(COMMON).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def similar_groups(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """(t1, t2, root) of each distinct text: texts linked by chains of at least that similarity share root.

    A text's number is its own within the run, given when its prefix is written, and links are between numbers: two texts
    of one 64-bit name stay two.

    Two such texts share a shingle of their prefixes (prefix_of), at places and with sizes that leave room for the
    overlap. All pairs that share one are verified on all shingles, but for those of crowded shingles that are in one
    group already: texts of a crowded shingle are first linked through the two whose prefixes are most shared (an
    original has no edits of its own), and then only pairs across groups are open, made in squares of SIDE texts.

    With a column part, the same for equal texts, only texts of one part are compared.
    """
    from lodestone.llm.repeats import KEY, distinct_texts, with_key

    spark = docs.sparkSession
    parted = ["part"] if "part" in docs.columns else []
    texts = with_key(docs.select("text", *parted))
    common = spark.sparkContext.broadcast(common_shingles(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, trim=True):
            sets = [shingle_set(t, size) for t in text_column(batch).to_pylist()]
            n = pa.array([len(x) for x in sets], pa.int32())
            tokens = pa.array([prefix_of(x, common.value, least) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n, tokens], [*KEY, *parted, "n", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow_blocks(batches, "text_u", trim=True):
            keep = [similarity(a, b, size) >= least for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    whole = distinct_texts(docs).select(*KEY, "text")

    def paired(left: DataFrame, right: DataFrame, on: list[str], also=None) -> DataFrame:
        """Pairs (u, v) of rows with one token whose sizes and places leave room for the overlap."""
        fields = ["id", "n", "pos", "root"]
        a = left.select(*on, *(F.col(c).alias(f"{c}_u") for c in fields if c in left.columns))
        b = right.select(*on, *(F.col(c).alias(f"{c}_v") for c in fields if c in right.columns))
        need = F.ceil(F.lit(least / (1 + least)) * (F.col("n_u") + F.col("n_v")) - 1e-6)
        room = F.least(F.col("n_u") - F.col("pos_u"), F.col("n_v") - F.col("pos_v"))
        fits = (F.least("n_u", "n_v") >= F.lit(least) * F.greatest("n_u", "n_v") - 1e-6) & (room >= need)
        made = a.join(b, on).where(fits & (F.col("id_u") != F.col("id_v")))
        made = made if also is None else made.where(also)
        return made.select(F.least("id_u", "id_v").alias("u"), F.greatest("id_u", "id_v").alias("v"))

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        ids, path = prints.select("id", *KEY), shared_path(spark, "pairs")
        named = stored(pairs.distinct().join(ids.toDF("u", "u1", "u2"), "u").join(ids.toDF("v", "v1", "v2"), "v").select("u", "u1", "u2", "v", "v1", "v2"), "pairs", path)
        release(spark)
        both = named.join(whole.toDF("u1", "u2", "text_u"), ["u1", "u2"]).join(whole.toDF("v1", "v2", "text_v"), ["v1", "v2"])
        links = stored(both.select("u", "v", "text_u", "text_v").mapInArrow(verify, "u long, v long"), label)
        release(spark, path)
        return links

    # prefixes are shuffled, not texts
    prints = texts.select("text", *KEY, *parted).mapInArrow(run, f"t1 long, t2 long, {'part long, ' if parted else ''}n int, tokens array<long>")
    once = [F.first(c).alias(c) for c in (*parted, "n", "tokens")]
    prints = stored(prints.groupBy(*KEY).agg(*once).withColumn("id", F.monotonically_increasing_id()), "prefixes")
    rows = prints.select("id", "n", *parted, F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
    if parted:
        rows = rows.withColumn("token", F.xxhash64("token", "part")).drop("part")
    counts = rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    release(spark)
    places = [shared_path(spark, label) for label in ("shared", "open")]
    shared = stored(rows.join(counts, "token"), "shared", places[0])
    release(spark)
    few, crowd = shared.where(F.col("m") <= PAIRED), shared.where(F.col("m") > PAIRED)
    pairs = paired(few, few, ["token"], F.col("id_u") < F.col("id_v"))
    if crowd.isEmpty():
        rooted = components(verified(pairs, "links"))
    else:
        own = shared.groupBy("id").agg((F.first("size") - F.count("*")).alias("alone"))
        ranked = crowd.join(own, "id")
        best = [F.min(F.struct("alone", F.xxhash64(F.lit(k), "id", "token").alias("tie"), "id", "n", "pos")).alias(f"hub{k}") for k in range(2)]
        hubs = ranked.groupBy("token").agg(*best).select("token", F.explode(F.array("hub0", "hub1")).alias("hub")).select("token", "hub.id", "hub.n", "hub.pos").distinct()
        near = stored(components(verified(pairs.unionByName(paired(crowd, hubs, ["token"])), "links")), "near")
        named = crowd.join(near, crowd["id"] == near["node"], "left").select("token", "id", "n", "pos", "m", F.coalesce("root", "id").alias("root"))
        split = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
        open_ = named.join(split, "token").withColumn("g", F.ceil(F.col("m") / SIDE).cast("int")).withColumn("mine", F.expr("cast(pmod(xxhash64(id), g) as int)"))
        open_ = stored(open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))), "open", places[1])
        left, right = (open_.withColumnsRenamed({"mine": x, "other": y}) for x, y in (("a", "b"), ("b", "a")))
        rest = paired(left, right, ["token", "a", "b"], (F.col("id_u") < F.col("id_v")) & (F.col("root_u") != F.col("root_v")))
        rooted = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(verified(rest, "rest")))
    release(spark, *places)
    return prints.select("id", *KEY).join(rooted, F.col("id") == rooted["node"], "left").select(*KEY, F.coalesce("root", "id").alias("root"))


def near_groups(docs: DataFrame, size: int = 5, least: float = 0.8, tau: int = 2) -> DataFrame:
    """(t1, t2, root) of each distinct text: SimHash components, as ``grouped`` makes them, and an exact check in each.

    Texts share root if chains of at least that similarity link them within a component, so no text is taken for
    another by its fingerprint alone: those of few shingles have few bits set and meet by chance. Only texts whose
    component has another text are read again; a sieve of their names keeps the others out of the shuffle.
    """
    from lodestone.llm.repeats import KEY, with_key

    spark = docs.sparkSession
    texts = with_key(docs.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, trim=True):
            fp = fingerprints_of(text_column(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(fp.view(np.int64))], [*KEY, "fp"])

    prints = stored(texts.select("text", *KEY).mapInArrow(run, "t1 long, t2 long, fp long").distinct(), "fingerprints")
    rooted = components(links(stored(prints.select("fp").distinct(), "distinct"), tau))
    named = prints.join(rooted, prints["fp"] == rooted["node"], "left")
    parts = stored(named.select(*KEY, F.coalesce("root", "fp").alias("part")), "parts")
    several = parts.groupBy("part").agg(F.count("*").alias("m")).where("m > 1").select("part")
    path = shared_path(spark, "compared")
    asked = stored(parts.join(several, "part"), "asked")
    likely = sifted(texts, stored(sieve(asked, F.col("t1"), asked=F.lit(True)), "sieve"), F.col("t1")).where("asked")
    compared = stored(likely.select("text", *KEY).join(asked, KEY).select("text", "part"), "compared", path)
    release(spark)
    same = similar_groups(compared, size, least)
    release(spark, path)
    return parts.join(same, KEY, "left").select(*KEY, F.struct("part", F.coalesce("root", F.lit(-1)).alias("root")).alias("root"))


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8, tau: int | None = None) -> DataFrame:
    """One row of each group of similar texts: the one with the smallest doc_id, nulls last; of equal rows one.

    With tau only texts of one SimHash component, linked by fingerprints at most tau bits apart, are compared.

    Rows are judged by their hashes, and a sieve tells which stay and which go, so that texts aren't shuffled but for those
    of equal rows and those that it can't tell, which are looked up.
    """
    from lodestone.llm.repeats import KEY, with_key

    groups = similar_groups(docs, size, least) if tau is None else near_groups(docs, size, least, tau)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    own = with_key(docs.select("doc_id", "text", row.alias("row"))).select("doc_id", *KEY, "row")
    # the least row of each text, then of each group; n: equal rows
    rows = own.groupBy("doc_id", *KEY, "row").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", *KEY, "row", "n")
    first = rows.groupBy(*KEY).agg(F.min(order).alias("first"))
    best = groups.join(first, KEY).groupBy("root").agg(F.min("first").alias("best"))
    keepers = stored(best.select(F.col("best.t1").alias("k1"), F.col("best.t2").alias("k2"), F.col("best.row").alias("row"), F.col("best.n").alias("n")), "keepers")
    key = F.xxhash64("k1", "k2", "row")
    every = rows.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "row").join(keepers, ["k1", "k2", "row"], "left")
    marks = stored(sieve(every, key, stays=F.col("n").isNotNull(), goes=F.coalesce(F.col("n") > 1, F.lit(True))), "sieve")
    release(docs.sparkSession)
    # keyed under names that documents don't have
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), row.alias("row"))
    told = sifted(named, marks, key)
    untold = lambda df: df.where("stays and goes").drop("stays", "goes")
    kept = untold(told).join(untold(sifted(keepers, marks, key)), ["k1", "k2", "row"])
    sure, alone, equal = told.where("stays and not goes"), kept.where("n = 1"), kept.where("n > 1").dropDuplicates(["k1", "k2", "row"])
    out = [df.select(*(F.col(n).alias(c) for c, n in names.items())) for df in (sure, alone, equal)]
    return out[0].unionByName(out[1]).unionByName(out[2])
