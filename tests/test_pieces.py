from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from docengine.functions.pieces import computed, pieces
from docengine.operators import html


def test_pieces_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (k % 5 * 1000) for k in range(500)] + ["y" * 100_000]), pa.array(range(501))], names=["t", "i"])
    parts = list(pieces(batch, 50_000))
    assert all(p.nbytes <= 50_000 or p.num_rows == 1 for p in parts) and len(parts) > 20
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(501))
    assert list(pieces(batch.slice(0, 0))) == []


def test_rows_are_kept_or_left_out(spark):
    """Rows of several pieces keep their columns; those without a result go."""
    df = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("ab "), 3000).alias("t"))
    got = computed(df, ("id", "t"), lambda i, t: {"held": t[:3]} if i % 3 else None, "held string", ("id",)).collect()
    assert len(got) == 2000 and {r["held"] for r in got} == {"ab "} and sorted(r["id"] for r in got) == [i for i in range(3000) if i % 3]
    assert computed(df, ("id", "t"), lambda i, t: None, "x string").count() == 0


def test_trees_are_freed_at_once():
    """A page's tree isn't a cycle: it goes with its root, whatever the collector does."""
    import gc
    from weakref import ref

    gc.disable()
    try:
        root = html._Tree("<main><p>" + "a" * 1000 + "</p><ul><li>b</li></ul></main>").root
        inner = ref(root.items[0])
        assert root.items[0].items[0].up is root.items[0]
        del root
        assert inner() is None
    finally:
        gc.enable()
