from __future__ import annotations

import time

from pyspark.sql import functions as F

from docengine.functions import identifiers as ids


def test_signal_of_long_queries_takes_linear_time(spark):
    """A title may be a whole line of thousands of words; its strongest token is the one that the driver's function finds."""
    words = [f"w{k % 7}{'x' * (k % 11)}" for k in range(60_000)]
    cases = [" ".join(words), " ".join([*words, "aB", "cD"]), "abc de", "abcd efgh", "", None, "xY longest", "1 22 ab_c Abcd"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, q string")
    begin = time.monotonic()
    got = df.select("i", ids.high_signal(ids.query_tokens(F.col("q"))).alias("s")).collect()
    assert time.monotonic() - begin < 30
    assert {r["i"]: r["s"] for r in got} == {i: ids.high_signal_token(ids.tokenize(q)) for i, q in enumerate(cases)}
