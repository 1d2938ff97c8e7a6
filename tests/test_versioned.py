import pytest
from pyspark.sql import functions as F

from lodestone.sources.versioned import Conflict, Progress, VersionedTable, save_document_index


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "item_id string, model string, response string")


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_see_whole_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.read() is None
    t.commit(rows(spark, ("a", "m", "1")), {"x": 1})
    old = t.read()
    seen = []

    class Slow:  # a writer that is looked at while it writes
        def parquet(self, path):
            rows(spark, ("b", "m", "2"), ("c", "m", "3")).write.parquet(path)
            seen.append((t.version(), held(t.read())))

    class Rows:
        schema, write = old.schema, Slow()

    t.commit(Rows())
    assert seen == [(1, [("a", "m", "1")])] and held(t.read()) == [("b", "m", "2"), ("c", "m", "3")]
    assert held(old) == [("a", "m", "1")] and held(t.read(1)) == [("a", "m", "1")] and t.pointer()["about"] == {"x": 1}
    t.commit(rows(spark, ("d", "m", None)), append=True)
    assert len(held(t.read())) == 3
    with pytest.raises(Conflict):
        t.commit(rows(spark, ("e", "m", "")), version=3)
    assert t.version() == 3 and len(held(t.read())) == 3
    t.vacuum(keep=1)
    assert len(held(t.read())) == 3 and t.version() == 3


def test_index_upserts_and_a_beaten_writer_tries_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "i")
    entry = lambda *r: spark.createDataFrame(list(r), "document_id string, domain string, chunk_file string, seq long")
    save_document_index(entry(("a", "f", "1", 0), ("b", "f", "1", 1)), root)
    plain, calls = VersionedTable.commit, []

    def beaten(self, df, *a, **k):
        if not calls:
            calls.append(1)
            plain(VersionedTable(spark, root), entry(("a", "f", "1", 0), ("b", "f", "1", 1), ("z", "f", "other", 9)))
        return plain(self, df, *a, **k)

    monkeypatch.setattr(VersionedTable, "commit", beaten)
    assert save_document_index(entry(("b", "f", "2", 5), ("c", "g", "2", 6)), root) == 3
    got = {r["document_id"]: (r["chunk_file"], r["seq"]) for r in VersionedTable(spark, root).read().collect()}
    assert got == {"a": ("1", 0), "b": ("2", 1), "c": ("2", 6), "z": ("other", 9)}


def test_progress_belongs_to_models_and_domain(spark, tmp_path):
    root, work = str(tmp_path / "p"), rows(spark, *[(f"i{k}", m, "x") for k in range(4) for m in ("m1", "m2")])
    p = Progress(spark, root, ["m1", "m2"], "finance")
    assert p.left(work).count() == 8
    p.save(work.where("item_id = 'i0'"))
    p.save(p.left(work).where("item_id = 'i1' and model = 'm1'"))
    again = Progress(spark, root, ["m2", "m1", "m2"], "finance")  # order and repetition don't matter
    assert again.left(work).count() == 5
    for models, domain in ((["m1"], "finance"), (["m1", "m2", "m3"], "finance"), (["m1", "m2"], "policy")):
        other = Progress(spark, root, models, domain)
        assert other.done() is None and other.left(work).count() == 8
    other.save(work.where("item_id = 'i3'"))
    assert other.left(work).count() == 6 and again.done() is None
    other.finish()
    assert other.done() is None and other.table.read().count() == 0 and other.left(work).agg(F.count("*")).first()[0] == 8
