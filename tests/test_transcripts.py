from __future__ import annotations

import duckdb

from docengine.queries import ORACLE_SQL, QUERIES


def test_lines_that_repeat(spark, tmp_path):
    """Documents whose first two lines are the same (or have no letter), and one without text, against the query's SQL."""
    rows = [(0, "One line\nOne line\nmore", "en", "s"), (1, "one\ntwo", "en", "s"), (2, "12 34\n56", "de", "s"), (3, "77", "de", "s"), (4, "", "fr", "s"), (5, None, "fr", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["session_transcripts"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLE_SQL["session_transcripts"]).fetchall(), key=str)
