import pytest
from pyspark.sql import functions as F

from tidelog.llm import distinct


def estimates(df, groups, p=12):
    return {tuple(r[g] for g in groups) + (r["ident"],): r["estimate"] for r in distinct.estimate(df, groups, p).collect()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(60_000).select(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"), (F.col("id") % 4).alias("day"), F.concat(F.lit("user-"), F.col("id") % 20_000).alias("u"), F.lit("one").alias("c"), F.lit(1).alias("reg"), F.lit(2).alias("state"))


def test_within_the_stated_error(spark, rows):
    exact = {(r["g"],): r["n"] for r in rows.groupBy("g").agg(F.countDistinct("u").alias("n")).collect()}
    got = estimates(distinct.sketch(rows, ["g"], ["u", "c"]), ["g"])
    for (g,), n in exact.items():
        assert abs(got[g, "u"] / n - 1) < 4 * distinct.standard_error()
        assert got[g, "c"] == pytest.approx(1, abs=0.01)


@pytest.mark.parametrize("n", [0, 1, 2, 10, 300, 5000, 200_000])
def test_sizes(spark, n):
    got = estimates(distinct.sketch(spark.range(n).select(F.lit("x").alias("g"), F.col("id").alias("u")), ["g"], ["u"]), ["g"])
    assert got == {} if n == 0 else abs(got["x", "u"] / n - 1) < max(4 * distinct.standard_error(), 0.02 if n <= 10 else 0)


def test_merging_is_lossless(spark, rows):
    whole = distinct.sketch(rows, ["g"], ["u"])
    days = distinct.merge(distinct.sketch(rows, ["g", "day"], ["u"]), ["g"])
    key = lambda df: sorted(map(tuple, df.select("g", "ident", "block", "regs").collect()), key=repr)
    assert key(whole) == key(days)
    cube = estimates(distinct.merge_all_unions(distinct.sketch(rows, ["g", "day"], ["u"]), ["g", "day"]), ["g", "day"])
    assert cube["g1", None, "u"] == pytest.approx(estimates(whole, ["g"])["g1", "u"]) and (None, None, "u") in cube and len(cube) == 4 * 5


def test_registers_are_bytes(spark, rows):
    whole = distinct.sketch(rows, ["g"], ["u"])
    assert dict(whole.dtypes)["regs"] == "array<tinyint>" and all(len(r["regs"]) == distinct.BLOCK for r in whole.collect())
    loose = distinct.registers(whole, ["g"])
    assert loose.groupBy("g", "ident", "reg").count().where("count > 1").count() == 0 and loose.where("reg < 0 or reg > 4095 or state < 0").count() == 0
    # packing and unpacking is a round trip
    key = lambda df: sorted(map(tuple, df.select("g", "ident", "reg", "state").collect()))
    assert key(distinct.registers(distinct._pack(loose, ["g"]), ["g"])) == key(loose)


def test_nulls_and_spelling(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "x"), ("a", "X"), (None, "x"), ("b", None)], "g string, u string")
    got = estimates(distinct.sketch(df, ["g"], ["u"]), ["g"])
    assert {k: round(v) for k, v in got.items()} == {("a", "u"): 3, (None, "u"): 1}


def test_small_registers_have_the_error_of_their_size(spark):
    n, trials = 20_000, 40
    df = spark.range(n * trials).select((F.col("id") % trials).alias("g"), F.col("id").alias("u"))
    errors = [v / n - 1 for v in estimates(distinct.sketch(df, ["g"], ["u"], p=8), ["g"], 8).values()]
    rms = (sum(e * e for e in errors) / trials) ** 0.5
    assert 0.6 * distinct.standard_error(8) < rms < 1.5 * distinct.standard_error(8)
