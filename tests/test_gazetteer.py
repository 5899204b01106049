import pytest
from pyspark.sql import functions as F

from corpus_spark.operators import gazetteer as G
from corpus_spark.operators import lexicon as X

PLACES = {"Bangkok": ("bangkok", "bkk"), "Phuket": ("Phuket",), "Thong Lo": ("thong  lo",), "Patong": ("patong",), "C Plus": ("c++",), "At": ("@home",), "New York": ("new york", "n.y."), "York": ("york",), "Ko": ("เกาะ",)}
TEXTS = ["  Bangkok   and PHUKET visa  ", "condo in Thong Lo and Patong", "bare tao", "", None, "c++", "c++x", "xc++", "(c++)", "@home", "at@home", "n.y.", "n.y.x", "York, New\nYork!", "newyork", "new-york", "bkk-bkk", "bkk_", "ÜBER bkk", "bkk" * 3, "new york " * 3000, "เกาะ", "เกาะพ"]


def frame(spark):
    return spark.createDataFrame([(name, a, k) for k, (name, aliases) in enumerate(PLACES.items()) for a in aliases], "toponym string, alias string, ord int")


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_equal_to_the_lists(spark, most):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string")
    want = {r["k"]: r["t"] for r in df.select("k", X.places(F.col("text"), {n: [" ".join(a.split()) for a in x] for n, x in PLACES.items()}).alias("t")).collect()}
    got = {r["k"]: r["toponyms"] for r in G.add_places(df, "text", frame(spark), most=most).collect()}
    assert got == want and got[0] == ["Bangkok", "Phuket"] and got[13] == ["New York", "York"] and got[6] == [] and got[9] == ["At"]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_odd_gazetteers(spark, most):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "k long, text string").withColumn("first", F.lit("kept"))
    odd = spark.createDataFrame([("x", " "), (None, "a"), ("y", "B  c"), ("y", "b c"), ("z", "b"), ("x", None)], "toponym string, alias string")
    got = G.add_places(df, "text", odd, "found", most)
    assert got.columns == ["k", "text", "first", "found"] and {r["k"]: r["found"] for r in got.collect()} == {1: ["y", "z"], 2: []}
    assert {tuple(r["found"]) for r in G.add_places(df, "text", odd.limit(0), "found", most).collect()} == {()}
    assert G.add_places(df.limit(0), "text", odd, "found", most).count() == 0


def test_many_aliases_stay_out_of_the_plan(spark):
    df = spark.createDataFrame([(1, "we met at place 77 and in name 199999 street, not at name 200000 street")], "k long, text string")

    def aliases(n):
        k = F.col("id").cast("string")
        return spark.range(n).select(F.concat(F.lit("p"), k).alias("toponym"), F.concat(F.when(F.col("id") % 2 == 1, F.concat(F.lit("place "), k)).otherwise(F.concat(F.lit("no "), k))).alias("alias")).unionByName(
            spark.range(n).select(F.concat(F.lit("q"), k).alias("toponym"), F.concat(F.lit("name "), k, F.lit(" street")).alias("alias")))

    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    many, few = G.add_places(df, "text", aliases(200_000)), G.add_places(df, "text", aliases(10))
    assert many.first()["toponyms"] == ["p77", "q199999"]
    assert abs(size(many) - size(few)) < 40


def test_bits_hold_back_what_is_no_alias(spark):
    known = G.compile_aliases(frame(spark))
    asked = spark.range(20_000).select(F.concat(F.lit("no place "), F.col("id").cast("string")).alias("gram")).unionByName(known.select(F.col("alias").alias("gram")))
    n = known.count()
    passed = {r["gram"] for r in G._perhaps(asked, known, n).collect()}
    assert {r["alias"] for r in known.collect()} <= passed and len(passed) < 20_000 / 8
    plan = G._perhaps(asked, known, n)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert G._perhaps(asked.limit(0), known, n).count() == 0 and G._perhaps(asked, known.limit(0), 0).count() == 0
