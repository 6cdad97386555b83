"""Scans of segments against the kernels over whole series."""

import numpy as np
import pytest

from seriesmith.functions.series import Series
from seriesmith.operators import kernels as K
from seriesmith.operators import scan
from seriesmith.operators.recur import Spec, with_recurrences

S = Series(["k"], ["pos"])
SPECS = {
    "ema": Spec("ema", ("x",), (5,)), "dema": Spec("dema", ("x",), (4,)), "tema": Spec("tema", ("x",), (4,)), "rma": Spec("rma", ("x",), (6,)), "rsi": Spec("rsi", ("x",), (5,)),
    "apo": Spec("apo", ("x",), (3, 7)), "ppo": Spec("ppo", ("x",), (3, 7)), "macd": Spec("macd", ("x",), (3, 6, 4)), "adosc": Spec("adosc", ("h", "l", "x", "v"), (2, 5)),
    "atr": Spec("atr", ("h", "l", "x"), (5,)), "natr": Spec("natr", ("h", "l", "x"), (5,)), "keltner": Spec("keltner", ("h", "l", "x"), (4, 2.0)),
}


def series(seed, n):
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.normal(size=n))
    h, low = x + rng.random(n), x - rng.random(n)
    x[rng.random(n) < 0.15] = np.nan
    h[rng.random(n) < 0.05] = np.nan
    return {"x": x, "h": h, "l": low, "v": rng.random(n)}


@pytest.mark.parametrize("rows", [100_000, 7])
def test_segments_give_the_whole_series(spark, monkeypatch, rows):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", rows)
    data = {"a": series(1, 90), "b": series(2, 31), "c": series(3, 4)}
    flat = [(k, i, *(None if np.isnan(v[i]) else float(v[i]) for v in d.values())) for k, d in data.items() for i in range(len(d["x"]))]
    df = spark.createDataFrame(flat, "k string, pos long, x double, h double, l double, v double").repartition(3)
    mixed = SPECS | {"kama": Spec("kama", ("x",), (4,)), "rma_dense": Spec("rma", ("h",), (3, False))}
    got = with_recurrences(df, S, mixed if rows == 7 else SPECS).orderBy("k", "pos").collect()
    for k, d in data.items():
        mine = [r for r in got if r["k"] == k]
        assert len(mine) == len(d["x"])
        for name, spec in SPECS.items():
            for column, want in zip(spec.outputs(name), spec.run(d), strict=True):
                found = np.array([np.nan if r[column] is None else r[column] for r in mine])
                assert np.allclose(found, want, rtol=1e-9, atol=1e-9, equal_nan=True), (k, column)


def test_segments_follow_times(spark, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT_ROWS", 10)
    df = spark.range(60).selectExpr("id % 2 AS k", "CAST(timestamp_seconds(id * 3600) AS TIMESTAMP_NTZ) AS at", "double(id) AS x")
    cut = scan.with_segments(df, Series(["k"], ["at"]))
    assert cut.groupBy("k", "__seg").count().agg({"count": "max"}).first()[0] <= 12
    got = with_recurrences(df, Series(["k"], ["at"]), {"e": Spec("ema", ("x",), (3,))}).orderBy("k", "at").collect()
    want = np.concatenate([K.ema(np.arange(i, 60, 2, dtype=float), 3) for i in range(2)])
    assert np.allclose([np.nan if r["e"] is None else r["e"] for r in got], want, equal_nan=True)


def test_empty_and_missing(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(5)], "k string, pos long, x double")
    assert with_recurrences(df, S, {"e": SPECS["ema"]}).where("e IS NOT NULL").count() == 0
    assert with_recurrences(df.limit(0), S, {"e": SPECS["ema"]}).count() == 0
