"""Numbers of up to 108 digits against Python's integers and decimals."""

import decimal
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import wide

decimal.getcontext().prec = 400


def plain(x):
    text = f"{Decimal(x):f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def numbers(n, digits=78, places=18, seed=5):
    dice = random.Random(seed)
    found = []
    for _ in range(n):
        whole = dice.randrange(10 ** min(digits, dice.choice([1, 9, 18, 19, 36, 37, digits])))
        part = dice.choice(["", f".{dice.randrange(10**places):0{places}}", ".5", ".000000000000000001"])
        found.append(dice.choice(["", "", "-"]) + str(whole) + part)
    return found


@pytest.mark.parametrize("parts", [1, 7])
def test_sums_of_78_digits_equal_python(spark, parts):
    rows = [(k % 5, x, k % 3 > 0) for k, x in enumerate(numbers(600))] + [(9, None, True), (10, "5", False), (11, "1", True), (11, "-1", True)]
    df = spark.createDataFrame(rows, "k int, q string, counts boolean").repartition(parts)
    got = {r["k"]: (r["all"], r["some"], r["n"]) for r in wide.summed(df, ["k"], {"all": F.col("q"), "some": F.when(F.col("counts"), F.col("q"))}, F.count("*").alias("n")).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k and r[1] is not None]
        total = lambda found: plain(sum(Decimal(r[1]) for r in found)) if found else None
        assert got[k] == (total(mine), total([r for r in mine if r[2]]), sum(r[0] == k for r in rows))


def test_sums_of_the_largest_word(spark):
    top = 2**256 - 1
    df = spark.range(1000).select(F.lit(str(top)).alias("q"), (F.col("id") % 2).alias("k"))
    assert {r["q"] for r in wide.summed(df, ["k"], {"q": F.col("q")}).collect()} == {str(500 * top)}
    assert "Python" not in wide.summed(df, ["k"], {"q": F.col("q")})._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["decimal(38,18)", "decimal(20,2)", "long", "int", "double", "float", "decimal(38,0)"])
def test_other_types_add_up_alike(spark, kind):
    df = spark.createDataFrame([("1.5",), ("-7.25",), ("0",), ("3",), (None,)], "t string").select(F.col("t").cast("double").cast(kind).alias("q"))
    want = plain(sum(Decimal(str(r["q"])) for r in df.collect() if r["q"] is not None))
    assert wide.summed(df, [], {"q": F.col("q")}).first()["q"] == want


def test_doubles_beyond_20_digits_do_not_stop_the_job(spark):
    df = spark.createDataFrame([(3e20,), (1e-20,), (1e21,), (-2.5e19,), (0.1,)], "q double")
    assert wide.summed(df, [], {"q": F.col("q")}).first()["q"] == "1275000000000000000000.1"


def test_exponents_and_forms(spark):
    rows = [("1e21", "1" + "0" * 21), ("1.5E+3", "1500"), ("-2e-3", "-0.002"), (".5", "0.5"), ("5.", "5"), ("+7", "7"), ("-0", "0"), ("-0.000", "0"), ("007", "7"), ("x", None), ("", None), ("1.2.3", None), ("1.0000000000000000000000", "1")]
    df = spark.createDataFrame(rows, "t string, want string").repartition(2)
    assert all(r["got"] == r["want"] for r in df.withColumn("got", wide.expr(wide.plus("t", "'0'"))).collect())


def test_lost_places_and_digits_are_errors(spark):
    for text, what in (("1.0000000000000000001", "decimal places"), ("9" * 91, "digits")):
        with pytest.raises(Exception, match=what):
            wide.summed(spark.createDataFrame([(text,)], "q string"), [], {"q": F.col("q")}).collect()


def test_sums_differences_products_and_order_of_pairs(spark):
    a, b, c = numbers(300, 78), numbers(300, 78, seed=6), numbers(300, 30, seed=7)
    df = spark.createDataFrame(list(zip(a, b, c, strict=True)), "a string, b string, c string")
    got = df.select("*", *(wide.expr(x).alias(n) for n, x in (("s", wide.plus("a", "b")), ("d", wide.minus("a", "b")), ("p", wide.times("a", "c")), ("l", wide.less("a", "b")))))
    for r in got.collect():
        x, y, z = Decimal(r["a"]), Decimal(r["b"]), Decimal(r["c"])
        assert (r["s"], r["d"], r["p"], r["l"]) == (plain(x + y), plain(x - y), plain(x * z), x < y)


def test_sums_add_integers_of_64_bits_and_short_ones_need_no_lambda(spark):
    edges = ["-0.5", "0.5", "-1", "-1.000000000000000001", "999999999.999999999", "1000000000", "9" * 36, "-" + "9" * 36 + ".999999999999999999", "1" + "0" * 36, "-" + "7" * 60]
    rows = [(k, x) for k in range(len(edges)) for x in edges[: k + 1]]
    df = spark.createDataFrame(rows, "k int, q string")
    got = wide.summed(df, ["k"], {"q": "q"})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(" in plan and not any("decimal(28,0)" in x for x in plan.split("Aggregate", 1)[1].splitlines()[:1])
    for r in got.collect():
        assert r["q"] == plain(sum(Decimal(x) for x in edges[: r["k"] + 1]))
    for kind in ("decimal(38,18)", "long", "double"):
        some = [x for x in edges[:6]] if kind != "long" else ["-1", "1000000000", "-9223372036854775808"]
        one = spark.createDataFrame([(k, x) for k, x in enumerate(some)], "k int, t string").select("k", F.col("t").cast(kind).alias("q"))
        want = {r["k"]: plain(Decimal(repr(r["q"])) if kind == "double" else Decimal(r["q"])) for r in one.collect()}
        assert {r["k"]: r["q"] for r in wide.summed(one, ["k"], {"q": "q"}).collect()} == want


def test_products_in_64_bit_cells_equal_python(spark):
    pairs = list(zip(numbers(200, 90, seed=1), numbers(200, 36, seed=2), strict=True)) + [("9" * 18 + "." + "9" * 18, "9" * 18 + "." + "9" * 18), ("-0.5", "0.5"), ("-0.000000000000000001", "7"), ("0", "-0.0"), (None, "1"), ("1", None)]
    df = spark.createDataFrame([(k % 9, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    cells = wide.product_cells(df, {"p": ("a", "b")})
    sums = cells.groupBy("k").agg(*(F.expr(f"coalesce(sum(p_{k}), 0L) as p_{k}") for k in range(wide.CELLS)))
    got = {r["k"]: r["t"] for r in sums.select("k", wide.expr(wide.cells_text([f"p_{k}" for k in range(wide.CELLS)])).alias("t")).collect()}
    for k in range(9):
        mine = [Decimal(a) * Decimal(b) for a, b in pairs[k::9] if a is not None and b is not None]
        assert got[k] == plain(sum(mine))
    near = df.where("length(a) < 18 and length(b) < 18 and a not like '-%' and b not like '-%'")
    rows = wide.product_cells(near, {"p": ("a", "b")})
    one = rows.select("a", "b", *(F.expr(f"coalesce(p_{k}, 0L) as p_{k}") for k in range(wide.CELLS)))
    for r in one.select("a", "b", wide.expr(wide.cells_text([f"p_{k}" for k in range(wide.CELLS)])).alias("t")).collect():
        assert r["t"] == plain(Decimal(r["a"]) * Decimal(r["b"]))
