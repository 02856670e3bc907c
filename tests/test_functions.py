import pytest
from pyspark.sql import functions as F

from tessella.functions import registry, rowexpr, sexpr
from tessella.functions.reducers import reducer


@rowexpr.row_expr
def clip(x, lo, hi):
    """A docstring is no expression."""
    return lo if x < lo else hi if x > hi else x


@rowexpr.row_expr
def logic(a, b):
    return (a and b) + 10 * (a or b) + 100 * (not a)


@rowexpr.row_expr
def steps(x):
    (y := x + 1)
    return y * y - x


def rows(spark):
    return spark.createDataFrame([(i, i % 3, float(i)) for i in range(10)], "a long, b long, d double")


def test_row_expressions(spark):
    df = rows(spark)
    got = df.select(clip("a", 2, 5).alias("c"), logic("a", "b").alias("l"), steps("a").alias("s"), steps("d").alias("t")).collect()
    for i, r in enumerate(got):
        assert r["c"] == min(max(i, 2), 5)
        assert r["l"] == int(bool(i) and bool(i % 3)) + 10 * int(bool(i or i % 3)) + 100 * int(not i)
        assert r["s"] == (i + 1) ** 2 - i and isinstance(r["t"], float)


def test_no_python_in_plan(spark):
    plan = rows(spark).select(clip("a", 2, 5))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_refused_constructs():
    def loop(x):
        for _ in x:
            pass
        return x

    def power(x):
        return x**2

    def chain(x):
        return 1 < x < 3

    for fn in (loop, power, chain):
        with pytest.raises(SyntaxError):
            rowexpr.row_expr(fn)(F.lit(1))
    with pytest.raises(TypeError):
        clip("a")
    with pytest.raises(TypeError):
        clip("a", 1, [2])


def test_sexpr(spark):
    df = rows(spark)
    got = [r[0] for r in df.select(sexpr.sexpr("( begin ( := y ( * a 2 ) ) ( return ( if ( > y 5 ) ( + y 1 ) ( - 0 y ) ) ) )", a="a")).collect()]
    assert got == [2 * i + 1 if 2 * i > 5 else -2 * i for i in range(10)]
    assert sexpr.parse("( + 1 2.5 )") == ["+", 1, 2.5]
    for bad, error in (("( + 1", SyntaxError), ("1 )", SyntaxError), ("( + 1 )", ValueError), ("( if 1 2 )", ValueError), ("zz", NameError), ("( what 1 )", ValueError)):
        with pytest.raises(error):
            sexpr.sexpr(bad)


def test_reducers_and_registry(spark):
    df = spark.createDataFrame([(0, 5), (1, 2), (2, 5), (3, 2)], "idx long, v long")
    row = df.agg(reducer("argmax")("v").alias("hi"), reducer("argmin")("v").alias("lo"), reducer("prod")("v").alias("p")).first()
    assert tuple(row) == (0, 1, 100.0)
    with pytest.raises(ValueError):
        reducer("nothing")
    registry.register("double_it", lambda x: x * 2, spark, "long")
    assert registry.call("double_it", 4) == 8 and "double_it" in registry.commands()
    assert spark.sql("select double_it(4L)").first()[0] == 8
    with pytest.raises(KeyError):
        registry.call("none")
    with pytest.raises(ValueError):
        registry.register("double_it", print)
