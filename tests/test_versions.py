from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docengine.plans import sync
from docengine.sources import adapters as registered  # noqa: F401 - registers them
from docengine.sources import base
from docengine.sources.versions import Conflict, VersionedTables
from docengine.streaming import incremental


def values(df) -> dict:
    return {r["k"]: r["v"] for r in df.collect()}


def rows(spark, **kv):
    return spark.createDataFrame(list(kv.items()), "k string, v long")


def test_a_writer_that_is_killed_before_the_commit(spark, tmp_path, monkeypatch):
    store = VersionedTables(spark, f"{tmp_path}/store")
    assert store.versions() == [] and store.read("a") is None and store.done("x") is None
    assert store.commit({"a": rows(spark, x=1), "b": rows(spark, y=2)}, ("load", 1)) == 1
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.commit({"a": rows(spark, x=9)}, ("load", 2))
    again = VersionedTables(spark, f"{tmp_path}/store")
    assert again.versions() == [1] and values(again.read("a")) == {"x": 1} and again.done("load") == 1
    assert len(again.vacuum()) == 1  # what the killed writer left
    assert again.commit({"a": rows(spark, x=2)}, ("load", 2)) == 2
    assert values(again.read("a")) == {"x": 2} and values(again.read("b")) == {"y": 2} and values(again.read("a", 1)) == {"x": 1}


def test_rollback_conflicts_and_vacuum(spark, tmp_path):
    store = VersionedTables(spark, f"{tmp_path}/store")
    for k in range(3):
        store.commit({"a": rows(spark, x=k)}, ("load", k))
    with pytest.raises(Conflict):
        store.commit({"a": rows(spark, x=7)}, base=2)
    assert store.versions() == [1, 2, 3] and values(store.read("a")) == {"x": 2}
    assert store.rollback(1) == 4 and values(store.read("a")) == {"x": 0} and store.done("load") == 0
    assert len(store.vacuum(keep=1)) == 3 and store.versions() == [4] and values(store.read("a")) == {"x": 0}


def test_a_stream_goes_on_after_kills_and_lost_checkpoints(spark, tmp_path, monkeypatch):
    store = VersionedTables(spark, f"{tmp_path}/store")
    changes = lambda: spark.readStream.schema("k string, v long, version long").parquet(f"{tmp_path}/in")
    put = lambda *r: spark.createDataFrame(r, "k string, v long, version long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda checkpoint: incremental.upsert_stream(changes(), store, "t", "k", f"{tmp_path}/{checkpoint}").awaitTermination()
    put(("a", 1, 1), ("b", 1, 1))
    run("one")
    put(("a", 2, 2))
    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run("one")
    assert values(store.read("t")) == {"a": 1, "b": 1}
    run("one")
    assert values(store.read("t")) == {"a": 2, "b": 1}
    before = store.manifest()["version"]
    run("one")  # nothing new
    assert store.manifest()["version"] == before
    put(("a", 0, 0), ("c", 5, 1))
    run("two")  # all from the beginning
    assert values(store.read("t")) == {"a": 2, "b": 1, "c": 5}


def test_a_sync_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "a.md").write_text("# A\n\nText of a.\n\n## More\n\nb")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "b.md").write_text("# B\n\nText of b.")
    store = VersionedTables(spark, f"{tmp_path}/store")
    adapters = {"one": (base.adapter("swift-book"), f"{tmp_path}/books"), "two": (base.adapter("swift-evolution"), f"{tmp_path}/more")}
    publish, calls = VersionedTables._publish, []

    def once(self, manifest):
        calls.append(manifest["version"])
        if len(calls) == 2:
            raise RuntimeError("killed")
        publish(self, manifest)

    monkeypatch.setattr(VersionedTables, "_publish", once)
    with pytest.raises(RuntimeError, match="killed"):
        sync.sync_committed(store, adapters, "monday")
    assert store.versions() == [1] and sync.load(store).documents.count() == 1
    assert sync.sync_committed(store, adapters, "monday") == {}
    assert calls == [1, 2, 2] and sync.load(store).documents.count() == 2  # the first adapter wasn't read again
    assert sync.load(store).sections.where(F.col("content_text").isNotNull()).count() >= 3
    assert sync.load(store, 1).documents.count() == 1 and sync.load(VersionedTables(spark, f"{tmp_path}/none")).documents.count() == 0
