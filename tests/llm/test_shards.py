import pytest

from lodestone.llm.common import shared_path
from lodestone.llm.shards import CommitConflict, ShardStore, sharded


def make(spark, low, n):
    return spark.createDataFrame([(i if i % 7 else None, f"text {i} " * (i % 50) if i % 11 else None, i % 3) for i in range(low, low + n)], "doc_id long, text string, rows int").repartition(6)


def everything(df):
    return sorted(map(str, df.select("doc_id", "text", "rows").collect()))


def test_append_compact_and_versions(spark):
    first, second = make(spark, 0, 300), make(spark, 300, 200)
    store = ShardStore(spark, shared_path(spark, "test"), first.schema, target_bytes=12_000, shard_rows=20)
    assert store.version() == 0 and store.read().count() == 0
    assert store.append(first) == 1 and store.append(second) == 2
    before = store.manifest().count()
    assert store.compact() == 3
    after = store.manifest().collect()
    assert len(after) < before / 2
    assert sum(r["rows"] for r in after) == 500
    want = everything(first.union(second))
    assert everything(store.read()) == want and everything(store.read(2)) == want and everything(store.read(1)) == everything(first)
    with pytest.raises(CommitConflict):
        store.commit(store.manifest(), 3)
    assert store.version() == 3
    store.vacuum()
    assert everything(store.read()) == want
    assert store.append(first.limit(0)) == 4 and everything(store.read()) == want


def test_tiers_over_many_arrivals(spark):
    parts = [make(spark, 100 * k, 100).coalesce(2) for k in range(6)]
    store = ShardStore(spark, shared_path(spark, "test"), parts[0].schema, target_bytes=40_000, shard_rows=25)
    want = parts[0].limit(0)
    for part in parts:
        store.append(part)
        want = want.union(part)
        before = store.manifest().count()
        store.compact()
        assert store.manifest().count() <= before
        assert everything(store.read()) == everything(want)
    live = store.manifest().collect()
    assert sum(r["rows"] for r in live) == 600 and len({r["shard"] for r in live}) == len(live)
    assert max(r["bytes"] for r in live) < 2 * 40_000
    store.vacuum()
    files = store._data(store._folders(store.manifest())).select(store.shard).distinct().count()
    assert files == len(live) and everything(store.read()) == everything(want)


def test_clashing_column_names(spark):
    rows = [(i, f"text {i} " * 30, "a", i, None, "m", 1.5) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _shard string, _size int, lodestone_bin string, _metadata string, `a.b` double").repartition(4)
    store = ShardStore(spark, shared_path(spark, "test"), docs.schema, target_bytes=20_000, shard_rows=10)
    store.append(docs)
    store.append(docs.limit(7))
    store.compact()
    got = store.read()
    assert got.columns == [store.shard, *docs.columns] or set(got.columns) == {store.shard, *docs.columns}
    assert sorted(map(str, got.select(*(f"`{c}`" for c in docs.columns)).collect())) == sorted(map(str, docs.union(docs.limit(7)).collect()))
    out = sharded(docs, 20_000, 10).collect()
    assert len(out) == 90 and all(r["listed"] for r in out)


def test_sharded_reads_every_row(spark):
    docs = make(spark, 0, 120)
    docs = docs.union(docs.limit(5))
    got = sharded(docs, 12_000, 10).collect()
    assert len(got) == 125 and all(r["listed"] for r in got)
    assert sharded(docs.limit(0)).count() == 0
