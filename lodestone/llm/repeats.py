"""Repeated windows of all texts: what the two substring operators share.

A text is a sequence (bytes, or words). Every window of ``width`` symbols picks an anchor in itself by its content
alone, so equal windows pick equal anchors at equal places. Neighbouring windows with one anchor form a record:
``h`` names the anchor, ``g`` the record's whole content and the anchor's place in it, so a group of equal records
is handled once.

1. Anchors are counted by name; those that occur once can't belong to a repeated window.
2. The records of the others are counted by (h, g), and one of each is taken from its text.
3. The operator's own method finds which windows of these records are repeated.
4. The answers go back to every record, to its text, and to every row that holds the text.

Equal texts are one text. A text tells each anchor and each record once, however often it has it. Texts and records are
scanned as often as they are shuffled: columns that only some readers of a shuffle need are packed, so that the engine
sees one shuffle and reuses it. Two records are taken for one if anchor and content have equal 64-bit names; of 10^13
records two different ones meet so with a chance far below a hundredth. Texts are shuffled once, by a 128-bit hash, and every step reads that exchange again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_blocks, text_column
from lodestone.llm.rolling import mix, prefix_sums, slice_hash

#: Distinct records of one anchor beyond which their windows are counted by name in the cluster, not in one task.
DENSE = 4096
KEY = ["t1", "t2"]
#: Bytes of text scanned at once: their 64-bit arrays stay in a core's cache.
SCANNED = 1 << 18


@dataclass
class Anchored:
    """Records of a block of texts; at, low and high are places in the block's sequence, windows start in low <= s < high."""

    row: np.ndarray
    h: np.ndarray
    g: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    offsets: np.ndarray
    sums: np.ndarray


def anchored(values: np.ndarray, offsets: np.ndarray, width: int, anchor: np.ndarray, look: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Anchored:
    """Groups windows into records. anchor numbers each window's anchor, one window for each start up to len(values) - width;
    look gives places and names of anchors by number."""
    sums = prefix_sums(values)
    # windows within one text, the texts' stretches of starts one after the other
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    some = np.flatnonzero(count)
    begin, count = offsets[some], count[some]
    change = np.zeros(len(anchor) + 1, bool)
    change[1:-1] = anchor[1:] != anchor[:-1]
    change[begin] = True
    keep = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(keep, begin, 1)
    np.add.at(keep, begin + count, -1)
    change[begin + count] = True  # a stretch's end, or the next one's start
    low = np.flatnonzero(change)
    inside = np.cumsum(keep, dtype=np.int8)[low] > 0
    high = np.append(low[1:], len(anchor))[inside]
    low = low[inside]
    row = some[np.searchsorted(begin, low, side="right") - 1] if len(some) else low
    at, name = look(anchor[low]) if len(low) else (low, np.zeros(0, np.uint64))
    g = mix(slice_hash(sums, low, high - 1 + width) + (at - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return Anchored(row, name, g, at, low, high, offsets, sums)


#: Gives the records of a column, and the bytes that stand for the record from low to high (exclusive, of starts).
Scan = Callable[[pa.Array], tuple[Anchored, Callable[[int, int], bytes]]]


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which rows of equal keys stand together, and where in it each group begins."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return order, np.flatnonzero(new)


def with_key(docs: DataFrame) -> DataFrame:
    """docs with text never null and its 128-bit hash in t1, t2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"text": text, "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("second"), text)})


def distinct_texts(docs: DataFrame) -> DataFrame:
    return with_key(docs.select("text")).groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def dealt_once(df: DataFrame, keys: list[str], places: list[int]) -> DataFrame:
    """df (keys, rest) dealt by keys. Joins on the keys and on these places of rest ask that they aren't null, each below its own
    copy of the shuffle; asking it here makes the copies equal, so that the engine runs one."""
    for c in [*(F.col(k) for k in keys), *(F.col("rest")[i] for i in places)]:
        df = df.where(c.isNotNull())
    return df.repartition(*keys)


def repeated(docs: DataFrame, scan: Scan, width: int, resolve: Callable[[DataFrame], DataFrame], finish: Callable[[list[bytes], list[np.ndarray]], list[tuple]], schema: str, settled: bool) -> DataFrame:
    """For each row of docs (doc_id, text), what finish makes of its text and the starts [from, to), flat, of its repeated windows.

    resolve: takes (h, g, n, off, data, ...) records, data being the scan's bytes (rows without are not for it), and gives (h, g, starts). settled: it
    gets only what is open: records of which there is one, and their rivals at the anchor; a record that occurs
    twice is repeated throughout. Anchors with over DENSE different records are resolved by their windows' names.
    """
    texts = distinct_texts(docs)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, "text", SCANNED):
            found = scan(text_column(batch))[0]
            # a text tells each anchor once, however often it has it
            order, first = grouped(found.h, found.row)
            times = np.diff(np.append(first, len(order)))
            h, row = found.h[order[first]], found.row[order[first]]
            packed = np.stack([batch.column(3).to_numpy()[row] * times, *(batch.column(i).to_numpy()[row] for i in (0, 1))], axis=1).astype(np.int64)
            rest = pa.ListArray.from_arrays(pa.array(np.arange(len(packed) + 1, dtype=np.int32) * 3), pa.array(packed.ravel()))
            yield pa.RecordBatch.from_arrays([longs(h), rest], ["h", "rest"])

    def marked(batch: pa.RecordBatch, column: int, found: Anchored, field: np.ndarray) -> np.ndarray:
        """The records whose field is in their text's list."""
        lists = batch.column(column)
        mine = np.concatenate([np.asarray(x.values).astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        return np.flatnonzero(np.isin(field.view(np.int64), mine))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_blocks(batches, "text", SCANNED):
            found = scan(text_column(batch))[0]
            keep = marked(batch, 4, found, found.h)
            # a text tells equal records once, with the places of all
            order, first = grouped(found.g[keep], found.h[keep], found.row[keep])
            keep = keep[order]
            times = np.diff(np.append(first, len(keep)))
            one = keep[first]
            row = found.row[one]
            n, t1, t2 = (batch.column(i).to_numpy()[row] for i in (3, 0, 1))
            ends = np.cumsum(times + 5)
            rest = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
            rest[(ends - times - 5)[:, None] + np.arange(5)] = np.stack([n * times, found.at[one] - found.low[one], found.high[one] - found.low[one], t1, t2], axis=1)
            rest[np.arange(len(keep)) + 5 * np.repeat(np.arange(1, len(one) + 1), times)] = found.at[keep] - found.offsets[found.row[keep]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(rest))
            yield pa.RecordBatch.from_arrays([longs(found.h[one]), longs(found.g[one]), lists], ["h", "g", "rest"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Anchored, Callable[[int, int], bytes], np.ndarray, np.ndarray, np.ndarray]]:
        """The records that stand for their (h, g), with their counts."""
        for batch in arrow_blocks(batches, "text", SCANNED):
            lists = batch.column(4).to_pylist()
            column = text_column(batch)
            found, data = scan(column)
            mine = {(i, x["g"]): (x["n"], x["dense"]) for i, own in enumerate(lists) for x in own or ()}
            keep, n, dense = [], [], []
            for j, key in enumerate(zip(found.row.tolist(), found.g.view(np.int64).tolist(), strict=True)):
                if got := mine.pop(key, None):
                    keep.append(j)
                    n.append(got[0])
                    dense.append(got[1])
            yield found, data, np.array(keep, np.int64), np.array(n, np.int64), np.array(dense, bool)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records for the operator's own method, with data; windows of those of dense anchors, with their names."""
        names = ["h", "g", "n", "off", "data", "w", "deal"]
        for found, data, keep, n, dense in chosen(batches):
            own, m = keep[~dense], n[~dense]
            cut = pa.array([data(a, b) for a, b in zip(found.low[own].tolist(), found.high[own].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([longs(found.h[own]), longs(found.g[own]), longs(m), longs(found.at[own] - found.low[own]), cut, pa.nulls(len(own), pa.int64()), pa.array(np.zeros(len(own), np.int64))], names)
            own, m = keep[dense], n[dense]
            size = found.high[own] - found.low[own]
            record = np.repeat(np.arange(len(own)), size)
            start = np.repeat(found.low[own], size) + np.arange(len(record)) - np.repeat(np.cumsum(size) - size, size)
            w = slice_hash(found.sums, start, start + width)
            yield pa.RecordBatch.from_arrays([longs(found.h[own][record]), longs(found.g[own][record]), longs(m[record]), longs(start - found.at[own][record]), pa.nulls(len(record), pa.binary()), longs(w), longs(found.g[own][record])], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(batch.column(5).is_valid())
            yield pa.RecordBatch.from_arrays([own.column(i) for i in (0, 1, 3, 5, 2)], ["h", "g", "c", "w", "n"])

    placed = dealt_once(texts.mapInArrow(places, "h long, rest array<long>"), ["h"], [1, 2])  # rest: times, t1, t2
    several = placed.groupBy("h").agg(F.sum(F.col("rest")[0]).alias("n")).where("n > 1").select("h")
    # several has each h once; a semi join would be moved below the shuffle
    marks = placed.join(several, "h").select("h", *(F.col("rest")[1 + i].alias(k) for i, k in enumerate(KEY)))
    marks = marks.groupBy(*KEY).agg(F.collect_list("h").alias("marks"))
    scanned = texts.join(marks, KEY).select(*KEY, "text", "copies", "marks").mapInArrow(records, "h long, g long, rest array<long>")
    every = dealt_once(scanned, ["h", "g"], [3, 4])  # rest: n, windows before the anchor, windows, t1, t2, anchors' places
    counted = every.groupBy("h", "g").agg(F.sum(F.col("rest")[0]).alias("n"), *(F.min_by(F.col("rest")[3 + i], F.struct(F.col("rest")[3], F.col("rest")[4])).alias(k) for i, k in enumerate(KEY)))
    # counted by n, so that this reader, too, needs all columns of the shuffle
    rivals = counted.groupBy("h").agg(F.count(F.when(F.col("n") > 0, 1)).alias("kinds"), F.max(F.col("n") == 1).alias("single"))
    kinds = counted.join(rivals, "h").where("kinds > 1 or n > 1").withColumn("dense", F.col("kinds") > DENSE)
    open_ = kinds.where("kinds > 1 and single") if settled else kinds
    asked = texts.join(open_.groupBy(*KEY).agg(F.collect_list(F.struct("g", "n", "dense")).alias("own")), KEY).select(*KEY, "text", "copies", "own")
    # an anchor's records meet in one task, the windows of dense ones are dealt by record
    dealt = asked.mapInArrow(picked, "h long, g long, n long, off long, data binary, w long, deal long").repartition("h", "deal")
    by_name = dealt.mapInArrow(windows, "h long, g long, c long, w long, n long")
    twice = by_name.groupBy("h", "c", "w").agg(F.sum("n").alias("n")).where("n > 1").select("h", "c", "w")
    dense = by_name.join(twice, ["h", "c", "w"], "left_semi").groupBy("h", "g").agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("c").cast("int"), (F.col("c") + 1).cast("int"))))).alias("starts"))
    answers = dense.unionByName(resolve(dealt))
    if settled:
        answers = answers.unionByName(counted.where("n > 1").select("h", "g", F.lit(None).cast("array<int>").alias("starts")))
    # a record repeated throughout has no list of starts, but its own bounds; its windows may be answered, too
    ats, before, count = F.transform(F.slice("rest", 6, F.size("rest")), lambda a: a.cast("int")), F.col("rest")[1].cast("int"), F.col("rest")[2].cast("int")
    open_starts = F.flatten(F.transform(ats, lambda a: F.transform("starts", lambda s: s + a)))
    whole = F.flatten(F.transform(ats, lambda a: F.array(a - before, a - before + count)))
    told = every.join(answers, ["h", "g"]).select(*(F.col("rest")[3 + i].alias(k) for i, k in enumerate(KEY)), F.coalesce(open_starts, whole).alias("starts"))
    told = told.groupBy(*KEY).agg(F.flatten(F.collect_list("starts")).alias("found"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in arrow_blocks(batches, "text", SCANNED):
            column, found = text_column(batch), batch.column(4)
            starts = [np.asarray(x.values).astype(np.int64) if x.is_valid else np.zeros(0, np.int64) for x in found]
            rows = finish([x.encode() for x in column.to_pylist()], starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], type=pa_type(schema, k)) for k in range(len(names)))], [*KEY, *names])

    made = texts.join(told, KEY, "left").select(*KEY, "text", "copies", "found").mapInArrow(finished, f"t1 long, t2 long, {schema}")
    return with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", *KEY).join(made, KEY).drop(*KEY)


def anchor_chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """A partition's records, sorted by h, in tables of about size bytes that end between anchors."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        batch = batch.filter(batch.column(4).is_valid())
        if not batch.num_rows:
            continue
        if held and total > size and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
        h = batch.column(0).to_numpy()
        cut = int(np.searchsorted(h, h[-1])) if total + batch.nbytes > size else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, total, batch = [], 0, batch.slice(cut)
        held.append(batch)
        total += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_anchor(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[DataFrame], DataFrame]:
    """A resolver of records that are dealt by anchor: it gets each anchor's, at most DENSE of them, one after the other."""
    return lambda records: records.sortWithinPartitions("h").mapInArrow(run, "h long, g long, starts array<int>")


def answered(whole: pa.Table, starts: list[np.ndarray]) -> pa.RecordBatch:
    some = np.array([i for i, x in enumerate(starts) if len(x)], np.int64)
    h, g = whole.column("h").to_numpy()[some], whole.column("g").to_numpy()[some]
    return pa.RecordBatch.from_arrays([longs(h), longs(g), pa.array([starts[i].astype(np.int32) for i in some.tolist()], pa.list_(pa.int32()))], ["h", "g", "starts"])


def pa_type(schema: str, k: int) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string()}[schema.split(", ")[k].split()[1]]


def covered(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The merged [low, high) that windows with these starts cover."""
    out: list[list[int]] = []
    pairs = starts.reshape(-1, 2)
    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b - 1 + width)
        else:
            out.append([a, b - 1 + width])
    return [(a, b) for a, b in out]
