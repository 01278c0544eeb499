from __future__ import annotations

from pyspark.sql import functions as F

from docengine.functions import identifiers, stemming, versions
from docengine.operators import search

# words and the stems that the published vocabulary gives them
STEMS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size,
hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, hesitanci hesit,
digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis,
hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope,
goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust,
dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas,
controll control, roll roll, is is, be be, été été, x1 x1, apology apolog, possibly possibl, yes ye, enjoying enjoi"""


def test_published_words(spark):
    pairs = dict(x.split() for x in STEMS.replace("\n", " ").split(","))
    assert stemming.stems_of(spark, pairs) == pairs
    assert stemming.stems_of(spark, []) == {}
    assert spark.range(1).select(stemming.porter(F.lit(None).cast("string"))).first()[0] is None


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, abstract string, declaration string, headings string, key string, body string")


ROWS = [
    (1, "View controllers", "the red fox ran far away from the dog", None, "Loading views", "k1", None),
    (2, "Controlling a view", "the dog ran and the red and green fox slept", None, "", "k2", None),
    (3, "Other", "red red red fox", "func view()", "the fox", "k3", None),
    (4, None, None, None, None, None, None),
]


def found(index, stats, query):
    return sorted(r["id"] for r in search.match(index, stats, query).collect())


def test_stemmed_search(spark):
    index, stats = search.store(corpus(spark, ROWS))
    stems = search.store_stemmed(index)
    for words, ids in (("controlled", [1, 2]), ("views", [1, 2, 3]), ("loads", [1]), ('"view control" OR "control a"', [1, 2]), ("nothing", [])):
        assert found(stems, stats, search.stemmed_query(search.parse(words), index)) == ids, words
    assert found(index, stats, search.parse("controlled")) == []
    assert stems.where("term = 'view' AND id = 1").first()["places"] == [0, (3 << 40) + 1]


def test_phrases_near_and_fields(spark):
    index, stats = search.store(corpus(spark, ROWS))
    cases = {
        '"red fox"': [1, 3], '"the fox"': [3], "NEAR(red fox, 0)": [1, 3], "NEAR(fox red, 2)": [1, 2, 3], "NEAR(dog fox, 5)": [1], "NEAR(dog fox, 6)": [1, 2], 'NEAR("red fox" dog, 4)': [], 'NEAR("red fox" dog, 5)': [1],
        'NEAR(red "ran far" dog, 5)': [], 'NEAR(red "ran far" dog, 6)': [1], "NEAR(red fox) NOT dog": [3], "title: view* AND red": [1, 2], "{headings declaration}: fox OR key: k2": [2, 3], "headings: (fox OR loading) AND red": [1, 3],
        'abstract: "the fox" OR none': [], "NEAR(red) OR nothing": [1, 2, 3],
    }
    for words, ids in cases.items():
        assert found(index, stats, search.parse(words)) == ids, words


def test_long_titles_have_linear_trigrams(spark):
    import time

    df = spark.createDataFrame([("é\U0001f600" + "ab c" * 12500,), ("ab",), ("",), (None,), ("AbCd",)], "t string")
    df.select(identifiers.trigrams(F.col("t"))).collect()
    begin = time.monotonic()
    got = [r[0] for r in df.select(identifiers.trigrams(F.col("t"))).collect()]
    assert time.monotonic() - begin < 1.5
    assert got[0] == ["é\U0001f600a", "\U0001f600ab", "ab ", "b c", " ca", "cab"] and got[1:] == [[], [], [], ["abc", "bcd"]]


def test_repeated_platforms_keep_their_place(spark):
    p = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("introducedAt"))
    m = versions.platform_map(F.array(p("iOS", "0"), p("macOS", "11"), p("IOS", "4"), p("tvOS", None), p("ios", "5")))
    assert list(spark.range(1).select(F.map_entries(m)).first()[0]) == [("ios", "5"), ("macos", "11")]


def test_long_fields_count_all_their_places(spark):
    """A single field, of more words than a small number holds."""
    body = " ".join(["the", "and"] * 40000)
    index, stats = search.store(corpus(spark, [(1, None, None, None, None, None, body)]), {"body": 1.0})
    assert {r["term"]: (r["tf"], r["length"], r["places"][-1]) for r in index.collect()} == {"the": (40000.0, 80000, 79998), "and": (40000.0, 80000, 79999)}
    assert [r["id"] for r in search.match(index, stats, search.parse('"and the"'), {"body": 1.0}).collect()] == [1]
