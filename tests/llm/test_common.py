from __future__ import annotations

import pytest

from docengine import queries as engine
from docengine.llm import queries
from docengine.llm.common import fresh, shared_dir


def test_operators_and_parsers_share_a_session(spark):
    src = "/root/testdata/sf0.001"
    first = sorted(queries.op4_line_bloom(spark, src).collect())
    assert engine.QUERIES["html_sections"](spark, src).count() > 0
    assert sorted(queries.op4_line_bloom(spark, src).collect()) == first
    assert engine.QUERIES["html_markdown"](spark, src).count() > 0


def test_fresh():
    assert fresh(["a", "_B"], "a", "b", "_b", "c") == ["_a", "b", "__b", "c"]


def test_clusters_name_the_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
