from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from docengine.operators import search
from docengine.plans import search as plan
from docengine.plans.deadline import Deadline, Late


def slowly(df, seconds):
    """df, of which each row takes some seconds."""

    @F.udf("boolean")
    def wait(x):
        time.sleep(seconds)
        return True

    return df.where(wait("id"))


def test_jobs_end_at_the_deadline(spark):
    assert Deadline(spark, None).run(lambda: spark.range(3).count()) == 3
    assert Deadline(spark, 60).run(lambda: spark.range(4).count()) == 4
    with pytest.raises(Late):
        Deadline(spark, 0).run(lambda: pytest.fail("began too late"))
    began = time.monotonic()
    with pytest.raises(Late):
        Deadline(spark, 1).run(lambda: slowly(spark.range(0, 100, 1, 2), 1).count())
    assert time.monotonic() - began < 20
    with pytest.raises(ValueError):
        Deadline(spark, 60).run(lambda: int("x"))
    assert not spark.sparkContext.getJobTags() and spark.range(5).count() == 5


def test_a_slow_tier_is_missing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"k/{i}", t, "x words of a body") for i, t in enumerate(["Buttons", "Views", "Stack"])], "id long, key string, title string, body string")
    none = {c: F.lit(None).cast("string") for c in ("abstract", "declaration", "headings", "role", "role_heading", "doc_kind", "framework", "source_type", "language", "platforms", "source_metadata")}
    docs = docs.withColumns(none | {"path": F.col("key"), "url_depth": F.lit(1), "is_release_notes": F.lit(False), "is_deprecated": F.lit(False), "is_beta": F.lit(False)}).persist()
    corpus = plan.build(docs)
    whole = plan.ranked(corpus, "Buttins", seconds=600)
    assert [r["path"] for r in whole.results] == ["k/0"] and not whole.partial and whole.missing == []
    real = search.fuzzy
    monkeypatch.setattr(search, "fuzzy", lambda docs, *rest: slowly(real(docs, *rest), 120))
    began = time.monotonic()
    cut = plan.ranked(corpus, "Buttins", seconds=15)
    assert cut.partial and cut.missing == ["fuzzy", "body"] and cut.results == [] and time.monotonic() - began < 90
    strict = plan.ranked(corpus, "Buttons", seconds=0)
    assert [r["path"] for r in strict.results] == ["k/0"] and strict.missing == ["fuzzy", "body"]
