"""Small series with known results; None is missing."""

from math import inf, nan

import pytest
from pyspark.sql import functions as F

from seriesmith.functions import arr, math, perf, stats
from seriesmith.functions.series import Series
from seriesmith.operators import indicators as ta

S = Series(["k"], ["pos"])


def frame(spark, **columns):
    rows = list(zip(*columns.values(), strict=True))
    kinds = ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(rows)], f"k string, pos int, {kinds}")


def run(spark, *exprs, **columns):
    got = frame(spark, **columns).select("pos", *[e.alias(f"v{i}") for i, e in enumerate(exprs)]).orderBy("pos").collect()
    out = [[None if r[f"v{i}"] is None or r[f"v{i}"] != r[f"v{i}"] else round(float(r[f"v{i}"]), 6) for r in got] for i in range(len(exprs))]
    return out if len(out) > 1 else out[0]


def reduced(spark, expr, **columns):
    v = frame(spark, **columns).groupBy("k").agg(expr.alias("v")).first()["v"]
    return None if v is None or v != v else v


N = nan


def test_missing(spark):
    x = [N, 1, N, N, 2, N]
    assert run(spark, arr.ffill(S, "x"), arr.bfill(S, "x"), x=x) == [[None, 1, 1, 1, 2, 2], [1, 1, 2, 2, 2, None]]
    assert run(spark, arr.lag(S, "x"), arr.lag(S, "x", -1), arr.lag(S, "x", 0), x=[1, 2, 3, 4]) == [[None, 1, 2, 3], [2, 3, 4, None], [1, 2, 3, 4]]
    assert run(spark, arr.replace("x", N, 0), x=[1, N, 2, N]) == [1, 0, 2, 0]
    assert arr.dropna(frame(spark, x=[1, N, N, 2]), "x").count() == 2
    assert reduced(spark, arr.equals("x", "y", 3), x=[0.1234], y=[0.1235]) is True
    assert reduced(spark, arr.equals("x", "y", 4), x=[0.1234], y=[0.1236]) is False


def test_elements(spark):
    assert run(spark, math.round_("x"), x=[1.2, 1.6, -1.5]) == [1, 2, -2]
    assert run(spark, math.clamp("x", 0, 8), x=[N, -5, 10]) == [None, 0, 8]
    x = [1, 1 + 2.0**-53, 1 + 2.0**-51]
    assert run(spark, math.eq("x", 1), math.neq("x", 1), x=x) == [[1, 1, 0], [0, 0, 1]]
    assert run(spark, math.div("x", "y"), x=[1, -1, 0, 4], y=[0, 0, 0, 2]) == [inf, -inf, None, 2]
    assert run(spark, math.floor("x"), x=[1e300, 1.5, N]) == [1e300, 1, None]


def test_cumulative_and_rolling(spark):
    assert run(spark, math.cumsum(S, "x"), math.cumprod(S, "x"), x=[1, N, 2]) == [[1, 1, 3], [1, None, 2]]
    assert run(spark, math.cummax(S, "x"), x=[N, 2, 1]) == [None, 2, 2]
    assert run(spark, math.rollsum(S, "x", 2), x=[N, N, 1, N, 2]) == [None, None, 1, 1, 2]
    assert run(spark, math.rollsum(S, "x", 2, zero_warmup=True), x=[1, 2]) == [0, 3]
    assert run(spark, math.rollprod(S, "x", 2), x=[2, 0, 3, 4]) == [None, 0, 0, 12]
    assert run(spark, math.rollargmin(S, "x", 3), math.rollargmax(S, "x", 3), x=[1, 3, 2, 5, 4]) == [[None, None, 0, 0, 2], [None, None, 1, 3, 3]]
    assert run(spark, stats.rollvar(S, "x", 2), stats.rollmean(S, "x", 2), x=[1, N, 3, 4]) == [[None, None, None, 0.5], [None, 1, 3, 3.5]]
    assert run(spark, math.rollsum(S, "x", 2, skipna=False), x=[1, 2, N, 4, 5]) == [None, 3, None, None, None]


def test_aggregates(spark):
    got = frame(spark, x=[1, 2, 3, 4], y=[3, 5, 7, 9]).groupBy("k").agg(math.ols("x", "y").alias("o")).first()["o"]
    assert (round(got["slope"], 9), round(got["intercept"], 9)) == (2, 1)
    assert reduced(spark, math.ols("x", "y")["slope"], x=[1, 1], y=[1, 2]) is None
    assert reduced(spark, stats.quantile("x", 0.25), x=[1, 2, 3, 4]) == 1.75
    assert reduced(spark, stats.hmean("x"), x=[1, 2, 4]) == pytest.approx(3 / 1.75)
    assert reduced(spark, stats.gmean("x"), x=[1, 3, 9]) == pytest.approx(3)
    assert reduced(spark, stats.var("x", 0), x=[1, 2, 3, 4]) == 1.25
    assert reduced(spark, stats.skew("x"), x=[1, 1, 1]) == 0
    assert reduced(spark, stats.kurtosis("x"), x=[1, 1, 1, 1]) == 0
    assert reduced(spark, stats.percentiles("x", [0.1, -0.5, 0.5, 2]), x=[1, 2, 3, 4])[1] is None
    assert reduced(spark, math.argmin("x", "pos"), x=[N, N]) == -1
    assert reduced(spark, math.norm("x", inf), x=[-3, 2]) == 3
    assert stats.mad(frame(spark, x=[N, 1, 2]), S, "x").first()["mad"] == 0.5
    assert stats.mad(frame(spark, x=[N, 1, 2]), S, "x", skipna=False).first()["mad"] is None
    kept = stats.winsorize(frame(spark, x=[N, 0, 1, 2, 3, 100]), S, "x", 0.25, 0.75).orderBy("pos").collect()
    assert [r["winsorized"] for r in kept] == [None, 1, 1, 2, 3, 3]
    assert run(spark, stats.zscore(S, "x", skipna=False), x=[N, 1, 3]) == [None, None, None]
    assert run(spark, stats.norminmax(S, "x", skipna=False), x=[1, N, 3]) == [0, None, 1]
    assert math.ols_multi(frame(spark, x=[1, 2, 3], y=[3, 5, 7]), ["k"], ["x"], "y").first()["coefficients"] == pytest.approx([1, 2])
    assert math.ols_multi(frame(spark, x=[1, 1, 1], y=[3, 5, 7]), ["k"], ["x"], "y").first()["coefficients"] is None
    assert run(spark, stats.norminmax(S, "x"), x=[N, 1, 3, N]) == [None, 0, 1, None]


def test_indicators(spark):
    assert run(spark, ta.rising(S, "x", 3), x=[1, N, 3, 4, 5]) == [0, 0, 0, 1, 1]
    assert run(spark, ta.cross(S, "x", 1), ta.crossover(S, "x", 1), ta.crossunder(S, "x", 1), x=[1, 2, 0, 3]) == [[0, 1, 1, 1], [0, 1, 0, 1], [0, 0, 1, 0]]
    assert run(spark, ta.cross(S, "x", "y", lambda x, px, y, py: (x >= y) & (px < py)), x=[1, 2, 3, 1], y=[2, 2, 2, 2]) == [0, 1, 0, 0]
    assert run(spark, ta.wad(S, "h", "l", "c", skipna=False), h=[1, 1, 1, 1], l=[0, 0, 0, N], c=[1, N, 2, 3]) == [None, 0, 0, None]
    assert run(spark, ta.aroon(S, "h", "l", 3, skipna=False)[0], h=[1, N, 3, 2, 4], l=[0] * 5) == [None, None, round(200 / 3, 6), 100, None]
    up = run(spark, ta.aroon(S, "h", "l", 3)[0], h=[1, 2, 3, 2, 4], l=[0, 1, 1, 1, 2])
    assert up == [None, None, round(200 / 3, 6), 100, None]
    assert run(spark, ta.obv(S, "x", "v"), x=[1, 2, N, 3, 4], v=[10] * 5) == [0, 10, None, None, 20]
    assert run(spark, ta.ad(S, "h", "l", "c", "v"), h=[5, 6, 7], l=[4, 5, 6], c=[5, N, 7], v=[10] * 3) == [10, None, 20]
    assert run(spark, ta.mfi(S, "x", "x", "x", "v", 5), x=[7] * 10, v=[1] * 10)[5] == 50
    assert run(spark, ta.wad(S, "h", "l", "c"), h=[1, 1, 1], l=[0, 0, 0], c=[1, 1, 2])[1:] == [0, 2]
    assert run(spark, *ta.donchian(S, "h", "l", 3), h=[1, 2, 3, 4], l=[0, 1, 1, 2]) == [[None, None, 3, 4], [None, None, 0, 1], [None, None, 1.5, 2.5]]
    assert run(spark, ta.ichimoku(S, "h", "l", "l", 3, 4, 5)[0], h=[1, 2, 3, 4, 5], l=[1] * 5)[2] == 2


def test_performance(spark):
    assert run(spark, perf.returns(S, "x"), x=[100, 110, 121]) == [None, 0.1, 0.1]
    assert run(spark, perf.cumreturns(S, "x"), x=[0.1, 0.1]) == [0.1, 0.21]
    assert reduced(spark, perf.cagr("x", 2), x=[0.1, 0.1]) == pytest.approx(0.21)
    e = frame(spark, x=[100, 90, 95, 80, 120])
    assert perf.maxdd(e, S, "x").first()["maxdd"] == pytest.approx(0.2)
    d = perf.maxdd_details(e, S, "x").first()
    assert (d["peak"], d["trough"], d["end"]) == (0, 3, 4)
    assert run(spark, perf.rollmaxdd(S, "x", 3), x=[100, 90, 95, 80, 120])[2] == 0.1
    got = perf.dduration(frame(spark, x=[N, 100, 90, N, 95, 80]), S, "x").orderBy("pos").collect()
    assert [r["duration"] for r in got][:4] == [-1, 0, 1, -1]
    assert perf.max_duration(frame(spark, x=[N, 100, 90, N, 95, 120, 80]), S, "x").first()["max_duration"] == 2
    assert perf.max_duration(frame(spark, x=[N, N]), S, "x").first()["max_duration"] == 0
    assert reduced(spark, perf.omega("x"), x=[1, 2]) == inf
    assert reduced(spark, perf.omega("x"), x=[0, 0]) is None
    assert reduced(spark, perf.sortino("x"), x=[1, -1, 2]) is None
    day = 86_400_000
    r = spark.createDataFrame([("a", 0, 0.01), ("a", 3 * day, 0.02)], "k string, ts long, r double")
    assert [round(x["ret"], 6) for x in perf.dailyreturns(r, ["k"], "ts", "r").orderBy("day_ms").collect()] == [0.01, 0, 0, 0.02]


@pytest.mark.parametrize("bad", [
    lambda: ta.sma(S, "x", 0), lambda: math.rollmin(S, "x", -1), lambda: ta.hma(S, "x", 1), lambda: ta.ao(S, "x", "x", 5, 5),
    lambda: stats.quantile("x", 2), lambda: stats.var("x", -1), lambda: stats.winsorize(None, S, "x", 0.9, 0.1), lambda: stats.percentiles("x", [2]),
])
def test_bad_parameters(spark, bad):
    with pytest.raises(ValueError):
        bad()


def test_sampling(spark):
    df = spark.range(100)
    assert stats.sample(df, 10, 1).count() == 10 and stats.sample(df, 1000, 1).count() == 100 and stats.sample(df, -1, 1).count() == 0
    assert stats.bootstrap(df, 250, 1).count() == 250 and stats.bootstrap(df.limit(0), 5, 1).count() == 0
    assert stats.shuffle(df, 1).agg(F.sum("id")).first()[0] == 4950
