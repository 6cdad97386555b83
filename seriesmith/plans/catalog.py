"""One query per operator over hourly bars of ``events``, and the SQL each must equal.

The series has k (event type), pos (0-based place), o, h, l, c, v, and three columns with
missing values: x (c, missing at every 17th place), y (h, missing at every 13th) and r
(the return of c, missing at the first place). Results are rounded to 4 places; missing
is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arr, math, perf, stats
from ..functions.series import Series, div
from ..operators import indicators as ta
from ..operators.recur import Spec, with_recurrences
from ..sources.tables import bars, randnormal, randuniform, read_table
from . import recursive

S = Series(["k"], ["pos"])

PRELUDE = """bars AS (
  SELECT event_type AS k, date_trunc('hour', ts) AS bar, arg_min(value, (ts, value)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, value)) AS c, count(*)::DOUBLE AS v
  FROM events GROUP BY 1, 2
), placed AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY bar) - 1 AS pos, o, h, l, c, v FROM bars
), s AS (
  SELECT *, CASE WHEN (pos + 1) % 17 <> 0 THEN c END AS x, CASE WHEN (pos + 1) % 13 <> 0 THEN h END AS y,
         CASE WHEN lag(c) OVER (PARTITION BY k ORDER BY pos) <> 0 THEN c / lag(c) OVER (PARTITION BY k ORDER BY pos) - 1 END AS r
  FROM placed
)"""
W = "WINDOW w AS (PARTITION BY k ORDER BY pos), wc AS (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING), wa AS (PARTITION BY k)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_bar = Series(["k"], ["bar"])
    placed = bars(read_table(spark, sf_dir, "events")).withColumn("pos", by_bar.pos.cast("long")).drop("bar")
    nan = F.lit(float("nan"))
    gapped = placed.withColumn("x", F.when((F.col("pos") + 1) % 17 == 0, nan).otherwise(F.col("c"))).withColumn("y", F.when((F.col("pos") + 1) % 13 == 0, nan).otherwise(F.col("h")))
    before = S.lag(F.col("c"))
    return gapped.withColumn("r", F.when(before != 0, F.try_divide(F.col("c"), before) - 1))


#: Places that results are rounded to, so that the order of summation does not show.
PLACES = 4
#: Added before rounding: prices have two decimals, so averages of them often lie halfway between two results.
NUDGE = 3.7e-6


def shown(c: Column) -> Column:
    return F.when(~F.isnan(c), F.round(c + NUDGE, PLACES))


def shown_sql(e: str) -> str:
    return f"round(CASE WHEN NOT isnan(({e})::DOUBLE) THEN ({e})::DOUBLE + {NUDGE} END, {PLACES})"


@dataclass
class Entry:
    """rows: Columns over the series; sql: their expressions, after stages of named columns."""

    make: Callable[[], dict[str, Column]]
    sql: dict[str, str] | None
    stages: list[dict[str, str]] = field(default_factory=list)
    group: bool = False
    whole: bool = False  # integers or booleans: not rounded
    where: str = ""

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = {n: c.cast("long") if self.whole else shown(c.cast("double")) for n, c in self.make().items()}
        df = series(spark, sf_dir)
        named = [c.alias(n) for n, c in out.items()]
        return df.groupBy("k").agg(*named) if self.group else df.select("k", "pos", *named)

    def text(self) -> str | None:
        if self.sql is None:
            return None
        ctes, last = [PRELUDE], "s"
        for i, stage in enumerate(self.stages):
            ctes.append(f"t{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {last} {W})")
            last = f"t{i}"
        out = ", ".join(f"{f'({e})::BIGINT' if self.whole else shown_sql(e)} AS {n}" for n, e in self.sql.items())
        tail = "GROUP BY k" if self.group else W
        return f"WITH {', '.join(ctes)} SELECT k, {'' if self.group else 'pos, '}{out} FROM {last} {self.where} {tail}"


def row(make: Callable[[], Column], sql: str, *stages: dict[str, str], **kw) -> Entry:
    return Entry(lambda: {"value": make()}, {"value": sql}, list(stages), **kw)


def many(names: str, make: Callable[[], list[Column]], sqls: list[str], *stages: dict[str, str], **kw) -> Entry:
    return Entry(lambda: dict(zip(names.split(), make(), strict=True)), dict(zip(names.split(), sqls, strict=True)), list(stages), **kw)


def agg(make: Callable[[], Column], sql: str, *stages: dict[str, str], **kw) -> Entry:
    return Entry(lambda: {"value": make()}, {"value": sql}, list(stages), True, **kw)


def roll(p: int, start: int | None = None) -> str:
    return f"OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN {p - 1 if start is None else start} PRECEDING AND CURRENT ROW)"


def warm(e: str, p: int) -> str:
    return f"CASE WHEN pos >= {p - 1} THEN {e} END"


P = 20
R = roll(P)
PAIR = {"px": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END", "py": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END"}
WMA = lambda x, p: f"CASE WHEN pos >= {p - 1} THEN ({' + '.join(f'{p - i} * coalesce(lag({x}, {i}) OVER w, 0)' for i in range(p))}) / nullif({' + '.join(f'{p - i} * (lag({x}, {i}) OVER w IS NOT NULL)::INT' for i in range(p))}, 0) END"
M3 = lambda e, p: f"sum({e}) {roll(p)} / nullif(count({e}) {roll(p)}, 0)"


def ieee(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} WHEN {b} = 0 AND {a} > 0 THEN 'inf'::DOUBLE WHEN {b} = 0 AND {a} < 0 THEN '-inf'::DOUBLE END"


def central(x: str, over: str, power: int) -> str:
    return f"list_avg([(e - m) ** {power} for e in q])"


def entries() -> dict[str, Entry]:
    c = F.col
    tp = "(h + l + c) / 3"
    e: dict[str, Entry] = {}
    # arr
    e["arr_isna"] = row(lambda: arr.isna("x"), "(x IS NULL)::INT")
    e["arr_notna"] = row(lambda: arr.notna("x"), "(x IS NOT NULL)::INT")
    e["arr_fillna"] = row(lambda: arr.fillna("x", -1), "coalesce(x, -1)")
    e["arr_ffill"] = row(lambda: arr.ffill(S, "x"), "last_value(x IGNORE NULLS) OVER wc")
    e["arr_bfill"] = row(lambda: arr.bfill(S, "x"), "first_value(x IGNORE NULLS) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
    e["arr_replace"] = row(lambda: arr.replace("v", 1, 100), "CASE WHEN v = 1 THEN 100 ELSE v END")
    e["arr_lag"] = many("back ahead", lambda: [arr.lag(S, "x", 2), arr.lag(S, "x", -1)], ["lag(x, 2) OVER w", "lead(x, 1) OVER w"])
    e["arr_allna"] = agg(lambda: arr.allna("x"), "(count(x) = 0)::INT", whole=True)
    e["arr_countna"] = agg(lambda: arr.countna("x"), "count(*) - count(x)", whole=True)
    e["arr_havena"] = agg(lambda: arr.havena("c", "x"), "bool_or(c IS NULL OR x IS NULL)::INT", whole=True)
    e["arr_equals"] = agg(lambda: arr.equals("x", c("x") + 0.0001, 3), "bool_and(x IS NULL OR abs(x - (x + 0.0001)) <= 0.001)::INT", whole=True)
    # math, element by element
    for n, f, q in (("add", math.add, "x + y"), ("sub", math.sub, "x - y"), ("mul", math.mul, "x * y"), ("avg", math.avg, "(x + y) / 2")):
        e[f"math_{n}"] = row(lambda f=f: f("x", "y"), q)
    e["math_div"] = row(lambda: div("x", c("v") - 1), ieee("x", "(v - 1)"))
    e["math_scale"] = row(lambda: math.scale("x", 2.5), "x * 2.5")
    e["math_clamp"] = row(lambda: math.clamp("x", 20, 60), "CASE WHEN x < 20 THEN 20 WHEN x > 60 THEN 60 ELSE x END")
    e["math_abs"] = row(lambda: math.abs_(c("x") - 50), "abs(x - 50)")
    e["math_sign"] = row(lambda: math.sign(c("x") - 50), "sign(x - 50)")
    e["math_round"] = row(lambda: math.round_(c("x") - 50), "CASE WHEN x - 50 >= 0 THEN floor(x - 50 + 0.5) ELSE ceil(x - 50 - 0.5) END")
    e["math_floor"] = row(lambda: math.floor("x"), "floor(x)")
    e["math_ceil"] = row(lambda: math.ceil("x"), "ceil(x)")
    for n, f, q in (("lt", math.lt, "x < o"), ("gt", math.gt, "x > o"), ("lte", math.lte, "x < o OR abs(x - o) < 2.220446049250313e-16"), ("gte", math.gte, "x > o OR abs(x - o) < 2.220446049250313e-16"), ("eq", math.eq, "abs(x - o) < 2.220446049250313e-16")):
        e[f"math_{n}"] = row(lambda f=f: f("x", "o"), f"coalesce({q}, false)", whole=True)
    e["math_neq"] = row(lambda: math.neq("x", "o"), "CASE WHEN x IS NULL THEN true ELSE x <> o END", whole=True)
    e["math_and"] = row(lambda: math.and_(math.gt("c", "o"), math.gt("v", 2)), "c > o AND v > 2", whole=True)
    e["math_or"] = row(lambda: math.or_(math.gt("c", "o"), math.gt("v", 2)), "c > o OR v > 2", whole=True)
    e["math_not"] = row(lambda: math.not_(math.gt("c", "o")), "NOT c > o", whole=True)
    e["math_apply"] = row(lambda: math.apply("x", lambda v: v * v + 1), "x * x + 1")
    e["math_diff"] = row(lambda: math.diff(S, "x"), "x - lag(x) OVER w")
    # math, aggregates
    e["math_sum"] = agg(lambda: math.sum_("x"), "sum(x)")
    e["math_prod"] = agg(lambda: math.prod(1 + c("r") / 1000), "product(1 + r / 1000)")
    e["math_min"] = agg(lambda: math.min_("x"), "min(x)")
    e["math_max"] = agg(lambda: math.max_("x"), "max(x)")
    e["math_argmin"] = agg(lambda: math.argmin("x", "pos"), "arg_min(pos, (x, pos)) FILTER (x IS NOT NULL)", whole=True)
    e["math_argmax"] = agg(lambda: math.argmax("x", "pos"), "arg_min(pos, (-x, pos)) FILTER (x IS NOT NULL)", whole=True)
    e["math_dot"] = agg(lambda: math.dot("c", "h"), "sum(c * h)")
    e["math_norm"] = many("two one most three", lambda: [math.norm("x"), math.norm("x", 1), math.norm("x", float("inf")), math.norm("x", 3)], ["sqrt(sum(x * x))", "sum(abs(x))", "max(abs(x))", "pow(sum(pow(abs(x), 3)), 1.0 / 3)"], group=True)
    e["math_ols"] = many("intercept slope", lambda: [math.ols("x", "y")["intercept"], math.ols("x", "y")["slope"]], ["regr_intercept(y, x)", "regr_slope(y, x)"], group=True)
    # math, cumulative and rolling
    e["math_cumsum"] = row(lambda: math.cumsum(S, "x"), "coalesce(sum(x) OVER wc, 0)")
    e["math_cumprod"] = row(lambda: math.cumprod(S, 1 + c("r") / 1000), "CASE WHEN r IS NOT NULL THEN product(1 + r / 1000) OVER wc END")
    e["math_cummax"] = row(lambda: math.cummax(S, "x"), "CASE WHEN x IS NOT NULL THEN max(x) OVER wc END")
    e["math_cummin"] = row(lambda: math.cummin(S, "x"), "CASE WHEN x IS NOT NULL THEN min(x) OVER wc END")
    e["math_rollsum"] = row(lambda: math.rollsum(S, "x", P), warm(f"sum(x) {R}", P))
    e["math_rollsum_dense"] = row(lambda: math.rollsum(S, "x", P, skipna=False), f"CASE WHEN pos >= {P - 1} AND pos < 16 THEN sum(x) {R} END")
    e["math_rollprod"] = row(lambda: math.rollprod(S, 1 + c("r") / 1000, P), warm(f"product(1 + r / 1000) {R}", P))
    e["math_rollmin"] = row(lambda: math.rollmin(S, "x", P), warm(f"min(x) {R}", P))
    e["math_rollmax"] = row(lambda: math.rollmax(S, "x", P), warm(f"max(x) {R}", P))
    e["math_rollminmax"] = row(lambda: math.rollminmax(S, "l", "h", P, lambda a, b: b - a), warm(f"max(h) {R} - min(l) {R}", P))
    e["math_rollargmin"] = row(lambda: math.rollargmin(S, "x", 5), f"CASE WHEN pos >= 4 THEN arg_max(pos, (-x, pos)) FILTER (x IS NOT NULL) {roll(5, 5)} END", whole=True)
    e["math_rollargmax"] = row(lambda: math.rollargmax(S, "x", 5), f"CASE WHEN pos >= 4 THEN arg_max(pos, (x, pos)) FILTER (x IS NOT NULL) {roll(5, 5)} END", whole=True)
    # stats, aggregates
    e["stats_mean"] = many("plain weighted", lambda: [stats.mean("x"), stats.mean("x", "y")], ["avg(x)", "sum(px * py) / sum(py)"], PAIR, group=True)
    e["stats_hmean"] = agg(lambda: stats.hmean(c("x") + 1), "count(x) / sum(1 / (x + 1))")
    e["stats_gmean"] = agg(lambda: stats.gmean(c("x") + 1), "exp(avg(ln(x + 1)))")
    e["stats_var"] = many("one none", lambda: [stats.var("x"), stats.var("x", 0)], ["var_samp(x)", "var_pop(x)"], group=True)
    e["stats_stdev"] = agg(lambda: stats.stdev("x"), "stddev_samp(x)")
    e["stats_covar"] = agg(lambda: stats.covar("x", "y"), "covar_samp(px, py)", PAIR)
    e["stats_corr"] = agg(lambda: stats.corr("x", "y"), "corr(px, py)", PAIR)
    mean = {"d": "x - avg(x) OVER wa"}
    e["stats_skew"] = agg(lambda: stats.skew("x"), "avg(d ** 3) / pow(avg(d ** 2), 1.5)", mean)
    e["stats_kurtosis"] = agg(lambda: stats.kurtosis("x"), "avg(d ** 4) / pow(avg(d ** 2), 2) - 3", mean)
    e["stats_quantile"] = agg(lambda: stats.quantile("x", 0.3), "quantile_cont(x, 0.3)")
    e["stats_median"] = agg(lambda: stats.median("x"), "median(x)")
    e["stats_percentiles"] = many("a b", lambda: [stats.percentiles("x", [0.1, 1.5, 0.9])[0], stats.percentiles("x", [0.1, 1.5, 0.9])[2]], ["quantile_cont(x, 0.1)", "quantile_cont(x, 0.9)"], group=True)
    # stats, whole series and rolling
    e["stats_zscore"] = row(lambda: stats.zscore(S, "x"), "(x - avg(x) OVER wa) / stddev_samp(x) OVER wa")
    e["stats_norminmax"] = row(lambda: stats.norminmax(S, "x"), "(x - min(x) OVER wa) / (max(x) OVER wa - min(x) OVER wa)")
    e["stats_zscore_dense"] = many("gaps whole", lambda: [stats.zscore(S, "x", skipna=False), stats.zscore(S, "c", skipna=False)], ["CASE WHEN count(x) OVER wa = count(*) OVER wa THEN (x - avg(x) OVER wa) / stddev_samp(x) OVER wa END", "(c - avg(c) OVER wa) / stddev_samp(c) OVER wa"])
    e["stats_norminmax_dense"] = many("later first", lambda: [stats.norminmax(S, "x", skipna=False), stats.norminmax(S, "r", skipna=False)], ["(x - min(x) OVER wa) / (max(x) OVER wa - min(x) OVER wa)", "NULL"])
    e["stats_rollmean"] = row(lambda: stats.rollmean(S, "x", P), warm(f"avg(x) {R}", P))
    e["stats_rollvar"] = row(lambda: stats.rollvar(S, "x", P), warm(f"var_samp(x) {R}", P))
    e["stats_rollstdev"] = row(lambda: stats.rollstdev(S, "x", P, 0), warm(f"stddev_pop(x) {R}", P))
    e["stats_rollcovar"] = row(lambda: stats.rollcovar(S, "x", "y", P), warm(f"covar_samp(px, py) {R}", P), PAIR)
    e["stats_rollcorr"] = row(lambda: stats.rollcorr(S, "x", "y", P), warm(f"covar_samp(px, py) {R} / (stddev_samp(x) {R} * stddev_samp(y) {R})", P), PAIR)
    e["stats_rollcorr_dense"] = row(lambda: stats.rollcorr(S, "c", "y", 8, skipna=False), f"CASE WHEN pos BETWEEN 7 AND 11 THEN covar_samp(c, y) {roll(8)} / (stddev_samp(c) {roll(8)} * stddev_samp(y) {roll(8)}) END")
    e["stats_rollmedian"] = row(lambda: stats.rollmedian(S, "x", P), warm(f"quantile_cont(x, 0.5) {R}", P))
    ordered = {"q": f"list_sort(list(x) FILTER (x IS NOT NULL) {R})"}
    e["stats_rollquantile"] = row(lambda: stats.rollquantile(S, "x", P, 0.9), warm("CASE WHEN len(q) % 2 = 1 THEN q[1 + floor((len(q) - 1) * 0.9)::INT] ELSE (q[1 + floor((len(q) - 1) * 0.9)::INT] + q[2 + floor((len(q) - 1) * 0.9)::INT]) / 2 END", P), ordered)
    window_mean = ({"q": f"list(x) FILTER (x IS NOT NULL) {R}"}, {"m": "list_avg(q)"})
    e["stats_rollskew"] = row(lambda: stats.rollskew(S, "x", P), warm(f"{central('x', R, 3)} / pow({central('x', R, 2)}, 1.5)", P), *window_mean)
    e["stats_rollkurtosis"] = row(lambda: stats.rollkurtosis(S, "x", P), warm(f"{central('x', R, 4)} / pow({central('x', R, 2)}, 2) - 3", P), *window_mean)
    # averages
    e["ta_sma"] = row(lambda: ta.sma(S, "x", P), warm(f"avg(x) {R}", P))
    e["ta_wma"] = row(lambda: ta.wma(S, "x", 10), WMA("x", 10))
    e["ta_vwma"] = row(lambda: ta.vwma(S, "x", "v", P), warm(f"sum(x * v) {R} / sum(CASE WHEN x IS NOT NULL THEN v END) {R}", P))
    tri = [min(i + 1, 9 - i) for i in range(9)]
    e["ta_trima"] = row(lambda: ta.trima(S, "x", 9), f"CASE WHEN pos >= 8 THEN ({' + '.join(f'{w} * coalesce(lag(x, {8 - i}) OVER w, 0)' for i, w in enumerate(tri))}) / ({' + '.join(f'{w} * (lag(x, {8 - i}) OVER w IS NOT NULL)::INT' for i, w in enumerate(tri))}) END")
    e["ta_hma"] = row(lambda: ta.hma(S, "c", 9), "CASE WHEN pos >= 10 THEN (3 * q + 2 * lag(q) OVER w + lag(q, 2) OVER w) / 6 END", {"q": f"2 * ({WMA('c', 4)}) - ({WMA('c', 9)})"})
    # oscillators
    e["ta_ao"] = row(lambda: ta.ao(S, "h", "l"), warm(f"avg(m) {roll(5)} - avg(m) {roll(34)}", 34), {"m": "(h + l) / 2"})
    six = roll(6, 4).replace("CURRENT ROW", "1 FOLLOWING")
    e["ta_aroon"] = many("up down", lambda: ta.aroon(S, "h", "l", 5), [f"CASE WHEN pos >= 4 AND lead(pos) OVER w IS NOT NULL THEN 100.0 * (5 - (pos + 1 - arg_max(pos, ({x}, pos)) {six})) / 5 END" for x in ("h", "-l")])
    seen = lambda x: f"arg_max(pos, ({x}, pos)) FILTER ({x} IS NOT NULL) {six}"
    e["ta_aroon_dense"] = many("up down", lambda: ta.aroon(S, "y", "x", 5, skipna=False), [f"CASE WHEN pos >= 4 AND lead(pos) OVER w IS NOT NULL THEN 100.0 * (5 - (pos + 1 - {seen(x)})) / 5 END" for x in ("y", "-x")])
    before = "lag(x, 10) OVER w"
    e["ta_change"] = row(lambda: ta.change(S, "x", 10), ieee(f"(x - {before})", before))
    e["ta_roc"] = row(lambda: ta.roc(S, "x", 10), ieee(f"(100 * (x - {before}))", before))
    e["ta_mom"] = row(lambda: ta.mom(S, "x", 10), f"x - {before}")
    e["ta_cmo"] = row(lambda: ta.cmo(S, "x", 14), f"CASE WHEN pos >= 14 THEN 100 * (sum(greatest(d, 0)) {roll(14)} - sum(greatest(-d, 0)) {roll(14)}) / sum(abs(d)) {roll(14)} END", {"e": "x - lag(x) OVER w"}, {"d": "CASE WHEN e IS NOT NULL THEN e END"})
    e["ta_cmo"].sql = {"value": f"CASE WHEN pos >= 14 THEN 100 * (sum(CASE WHEN e > 0 THEN e WHEN e IS NOT NULL THEN 0 END) {roll(14)} - sum(CASE WHEN e < 0 THEN -e WHEN e IS NOT NULL THEN 0 END) {roll(14)}) / sum(abs(e)) {roll(14)} END"}
    e["ta_kst"] = row(lambda: ta.kst(S, c("c") + 1), " + ".join(f"{w} * (CASE WHEN pos >= {n - 1} THEN avg(r{p}) {roll(n)} END)" for p, n, w in ((10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4))), {f"r{p}": f"100 * (c - lag(c, {p}) OVER w) / (lag(c, {p}) OVER w + 1)" for p in (10, 15, 20, 30)})
    fast = {"f": f"CASE WHEN pos >= 13 THEN CASE WHEN max(h) {roll(14)} = min(l) {roll(14)} THEN 0 ELSE 100 * (c - min(l) {roll(14)}) / (max(h) {roll(14)} - min(l) {roll(14)}) END END"}
    slow = {"g": f"avg(f) {roll(3)}"}
    e["ta_stoch"] = many("slow signal", lambda: ta.stoch(S, "h", "l", "c", 14, 3, 3), ["CASE WHEN pos >= 17 THEN g END", f"CASE WHEN pos >= 17 THEN avg(g) {roll(3)} END"], fast, slow)
    e["ta_ultosc"] = row(lambda: ta.ultosc(S, "h", "l", "c"), "CASE WHEN pos >= 28 THEN 100 * (" + " + ".join(f"{w} * coalesce(sum(bp) {roll(p)} / nullif(sum(t) {roll(p)}, 0), 0)" for p, w in ((7, 4), (14, 2), (28, 1))) + ") / 7 END", {"pc": "lag(c) OVER w"}, {"bp": "CASE WHEN pc IS NOT NULL THEN c - least(l, pc) END", "t": "CASE WHEN pc IS NOT NULL THEN greatest(h, pc) - least(l, pc) END"})
    e["ta_wpr"] = row(lambda: ta.wpr(S, "h", "l", "c", 14), warm(f"coalesce(-100 * (max(h) {roll(14)} - c) / nullif(max(h) {roll(14)} - min(l) {roll(14)}, 0), 0)", 14))
    # trend
    e["ta_cci"] = row(lambda: ta.cci(S, "h", "l", "c", 10), "CASE WHEN pos >= 18 THEN coalesce((t - m) / nullif(0.015 * list_avg([abs(z - m) for z in q]), 0), 0) END", {"t": tp}, {"q": f"list(t) {roll(10)}"}, {"m": "list_avg(q)"})
    e["ta_dpo"] = row(lambda: ta.dpo(S, "x", 20), warm(f"lag(x, 11) OVER w - avg(x) {R}", P))
    mids = {n: f"CASE WHEN pos >= {p - 1} THEN (max(h) {roll(p)} + min(l) {roll(p)}) / 2 END" for n, p in (("m1", 9), ("m2", 26), ("m3", 52))}
    e["ta_ichimoku"] = many("tenkan kijun span_a span_b chikou", lambda: ta.ichimoku(S, "h", "l", "c"), ["m1", "m2", "(lag(m1, 26) OVER w + lag(m2, 26) OVER w) / 2", "lag(m3, 26) OVER w", "lead(c, 26) OVER w"], mids)
    # volatility
    e["ta_tr"] = row(lambda: ta.tr(S, "h", "l", "c"), "CASE WHEN pos = 0 THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END")
    e["ta_bb"] = many("mid up low", lambda: ta.bb(S, "x", P), [warm(f"avg(x) {R} {s}", P) for s in ("", f"+ 2 * stddev_pop(x) {R}", f"- 2 * stddev_pop(x) {R}")])
    e["ta_bbw"] = row(lambda: ta.bbw(S, "x", P), warm(f"100 * 4 * stddev_pop(x) {R} / avg(x) {R}", P))
    full = f"count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) {roll(10)} = 10"
    e["ta_donchian"] = many("up low mid", lambda: ta.donchian(S, "y", "x", 10), [f"CASE WHEN {full} THEN {v} END" for v in (f"max(y) {roll(10)}", f"min(x) {roll(10)}", f"(max(y) {roll(10)} + min(x) {roll(10)}) / 2")])
    # volume
    mf = "CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END"
    e["ta_ad"] = row(lambda: ta.ad(S, "h", "l", "c", "v"), "sum(f) OVER wc", {"f": mf})
    e["ta_obv"] = row(lambda: ta.obv(S, "x", "v"), "CASE WHEN pos = 0 THEN 0 WHEN f IS NOT NULL THEN sum(f) OVER wc END", {"f": "v * sign(x - lag(x) OVER w)"})
    up = {"pc": "lag(c) OVER w", "pv": "lag(v) OVER w"}
    e["ta_pnvi"] = many("pvi nvi", lambda: ta.pnvi(S, c("c") + 1000, "v"), [f"1000 * product(CASE WHEN v {s} pv THEN (c + 1000) / (pc + 1000) ELSE 1 END) OVER wc" for s in (">", "<")], up)
    e["ta_wad"] = row(lambda: ta.wad(S, "h", "l", "c"), "CASE WHEN pos > 0 THEN sum(CASE WHEN c > pc THEN c - least(l, pc) WHEN c < pc THEN c - greatest(h, pc) ELSE 0 END) OVER wc END", up)
    loose = {"pc": "lag(x) OVER w", "lost": "CASE WHEN (x > lag(x) OVER w AND l IS NULL) OR (x < lag(x) OVER w AND y IS NULL) THEN 1 END"}
    e["ta_wad_dense"] = row(lambda: ta.wad(S, "y", "l", "x", skipna=False), "CASE WHEN pos > 0 AND count(lost) OVER wc = 0 THEN sum(CASE WHEN x > pc THEN x - least(l, pc) WHEN x < pc THEN x - greatest(y, pc) ELSE 0 END) OVER wc END", loose)
    e["ta_mfi"] = row(lambda: ta.mfi(S, "h", "l", "c", "v", 14), f"CASE WHEN pos >= 14 THEN CASE WHEN sum(a) {roll(14)} + sum(b) {roll(14)} = 0 THEN 50 WHEN sum(b) {roll(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(a) {roll(14)} / sum(b) {roll(14)}) END END", {"t": tp}, {"pt": "lag(t) OVER w"}, {"a": "CASE WHEN t > pt THEN t * v ELSE 0 END", "b": "CASE WHEN t < pt THEN t * v ELSE 0 END"})
    # signals
    for n, f, op, m in (("rising", ta.rising, ">", "max"), ("falling", ta.falling, "<", "min")):
        e[f"ta_{n}"] = row(lambda f=f: f(S, "x", 5), "coalesce(last_value(f IGNORE NULLS) OVER wc, 0)", {"f": f"CASE WHEN x IS NOT NULL THEN CASE WHEN pos >= 5 THEN coalesce(x {op} {m}(x) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false)::INT ELSE 0 END END"}, whole=True)
    over, under = "x > y - 20 AND lag(x) OVER w <= lag(y) OVER w - 20", "x < y - 20 AND lag(x) OVER w >= lag(y) OVER w - 20"
    e["ta_crossover"] = row(lambda: ta.crossover(S, "x", c("y") - 20), f"coalesce({over}, false)", whole=True)
    e["ta_crossunder"] = row(lambda: ta.crossunder(S, "x", c("y") - 20), f"coalesce({under}, false)", whole=True)
    e["ta_cross"] = row(lambda: ta.cross(S, "x", c("y") - 20), f"coalesce(({over}) OR ({under}), false)", whole=True)
    # perf
    e["perf_returns"] = row(lambda: perf.returns(S, "x"), "CASE WHEN lag(x) OVER w <> 0 THEN (x / lag(x) OVER w - 1)::FLOAT END")
    e["perf_logreturns"] = row(lambda: perf.logreturns(S, c("x") + 1), "ln((x + 1) / (lag(x) OVER w + 1))::FLOAT")
    small = lambda: c("r") / 1000
    e["perf_cumreturns"] = row(lambda: perf.cumreturns(S, small()), "CASE WHEN r IS NOT NULL THEN product(1 + r / 1000) OVER wc - 1 END")
    e["perf_cagr"] = agg(lambda: perf.cagr(small()), "pow(product(1 + r / 1000), 252.0 / count(r)) - 1")
    e["perf_dd"] = row(lambda: perf.dd(S, "x"), "CASE WHEN x IS NOT NULL THEN x / max(x) OVER wc - 1 END")
    peaks = lambda p: ({"q": f"list(x) FILTER (x IS NOT NULL) {roll(p)}"}, {"u": "[1 - q[i] / nullif(list_max(q[:i]), 0) for i in range(1, len(q) + 1)]"})
    e["perf_rollmaxdd"] = row(lambda: perf.rollmaxdd(S, "x", 10), "CASE WHEN len(q) > 0 THEN coalesce(list_max(u), 0) END", *peaks(10))
    e["perf_rollulcer"] = row(lambda: perf.rollulcer(S, "x", 10), "CASE WHEN len(q) > 0 THEN sqrt(list_sum([coalesce(z, 0) ** 2 for z in u]) / len(q)) END", *peaks(10))
    e["perf_sharpe"] = agg(lambda: perf.sharpe(small()), "avg(r / 1000) * sqrt(252) / stddev_samp(r / 1000)")
    e["perf_sortino"] = agg(lambda: perf.sortino(small()), "avg(r / 1000) * sqrt(252) / sqrt(sum(CASE WHEN r < 0 THEN (r / 1000) ** 2 END) / (count(CASE WHEN r < 0 THEN 1 END) - 1))")
    e["perf_rollsharpe"] = row(lambda: perf.rollsharpe(S, small(), P), f"avg(r / 1000) {R} * sqrt(252) / nullif(stddev_samp(r / 1000) {R}, 0)")
    e["perf_rollsortino"] = row(lambda: perf.rollsortino(S, small(), P), f"avg(r / 1000) {R} * sqrt(252) / nullif(stddev_samp(CASE WHEN r < 0 THEN r / 1000 END) {R}, 0)")
    e["perf_vol"] = agg(lambda: perf.vol(small()), "stddev_samp(r / 1000) * sqrt(252)")
    e["perf_rollvol"] = row(lambda: perf.rollvol(S, small(), P), f"nullif(stddev_samp(r / 1000) {R}, 0) * sqrt(252)")
    e["perf_var"] = many("historical parametric", lambda: [perf.value_at_risk(small()), perf.value_at_risk(small(), 0.05, "parametric")], ["quantile_cont(r / 1000, 0.05)", "avg(r / 1000) + stddev_samp(r / 1000) * (-1.6448536269514729)"], group=True)
    e["perf_omega"] = agg(lambda: perf.omega(small()), "sum(greatest(r, 0)) / sum(greatest(-r, 0))")
    return e


def frames() -> dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]]:
    """Operators that take and give frames."""
    one = lambda v, g="": f"WITH {PRELUDE}{g} SELECT k, {shown_sql(v)} AS value FROM t GROUP BY k"
    value = lambda df: df.select("k", shown(F.col("value")).alias("value"))
    dd = f", t AS (SELECT *, CASE WHEN x IS NOT NULL THEN x / max(x) OVER wc - 1 END AS dd FROM s {W})"
    high = f", n AS (SELECT *, (x IS NOT NULL AND coalesce(x > max(x) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))::INT AS new, max(x) OVER wc AS peak FROM s {W})"
    plus = lambda df: df.withColumn("x", F.col("x") + 1)
    moved = f", s1 AS (SELECT k, pos, x + 1 AS x FROM s), t AS (SELECT *, x / max(x) OVER wc - 1 AS dd FROM s1 {W})"
    rate = "(pow(arg_max(x, pos) / arg_min(x, pos), 252.0 / (max(pos) FILTER (x IS NOT NULL) - min(pos) FILTER (x IS NOT NULL))) - 1) / -min(dd)"
    recent = ", b AS (SELECT k, max(pos) FILTER (x IS NOT NULL) - 252 AS start FROM s GROUP BY k), s1 AS (SELECT s.k, pos, x + 1 AS x FROM s JOIN b ON s.k = b.k AND pos >= start), t AS (SELECT *, x / max(x) OVER wc - 1 AS dd FROM s1 " + W + ")"
    out: dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]] = {
        "arr_dropna": (lambda df: arr.dropna(df, "x").select("k", "pos", shown(F.col("x")).alias("value")), f"WITH {PRELUDE} SELECT k, pos, {shown_sql('x')} AS value FROM s WHERE x IS NOT NULL"),
        "arr_align": (lambda df: arr.align(df.select("k", "pos", "x"), df.where("pos < 50").select("k", "pos", "y"), ["k", "pos"], "left").select("k", "pos", shown(F.col("x") - F.col("y")).alias("value")), f"WITH {PRELUDE} SELECT k, pos, {shown_sql('CASE WHEN pos < 50 THEN x - y END')} AS value FROM s"),
        "stats_winsorize": (
            lambda df: stats.winsorize(df, S, "x", name="value").select("k", "pos", shown(F.col("value")).alias("value")),
            f"WITH {PRELUDE}, q AS (SELECT k, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM s GROUP BY k) SELECT k, pos, {shown_sql('CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END')} AS value FROM s JOIN q USING (k)",
        ),
        "stats_mad_dense": (
            lambda df: stats.mad(df, S, "x", "gaps", skipna=False).join(stats.mad(df, S, "c", "whole", skipna=False), "k").select("k", shown(F.col("gaps")).alias("gaps"), shown(F.col("whole")).alias("whole")),
            f"WITH {PRELUDE}, t AS (SELECT k, abs(c - avg(c) OVER wa) AS d FROM s {W}) SELECT k, NULL::DOUBLE AS gaps, {shown_sql('avg(d)')} AS whole FROM t GROUP BY k",
        ),
        "stats_rollcorr_lengths": (
            lambda df: stats.rollcorr_of(df, df.where("pos < 30"), S, "x", "y", P, out_length="min", name="value").withColumn("kind", F.lit("min"))
            .unionByName(stats.rollcorr_of(df, df.where("pos < 30"), S, "x", "y", P, out_length="max", name="value").withColumn("kind", F.lit("max")))
            .select("k", "pos", "kind", shown(F.col("value")).alias("value")),
            f"""WITH {PRELUDE}, a AS (SELECT k, pos, x, CASE WHEN pos < 30 THEN y END AS y FROM s),
            b AS (SELECT *, {', '.join(f'{v} AS {n}' for n, v in PAIR.items())} FROM a),
            t AS (SELECT *, {warm(f'CASE WHEN stddev_samp(x) {R} * stddev_samp(y) {R} > 1e-12 THEN covar_samp(px, py) {R} / (stddev_samp(x) {R} * stddev_samp(y) {R}) END', P)} AS e FROM b)
            SELECT k, pos, 'min' AS kind, {shown_sql('e')} AS value FROM t WHERE pos < 30 UNION ALL SELECT k, pos, 'max', {shown_sql('e')} FROM t""",
        ),
        "perf_max_duration": (
            lambda df: perf.max_duration(df, S, "x", "value").select("k", F.col("value").cast("long").alias("value")),
            f"WITH {PRELUDE}{high}, i AS (SELECT *, sum(new) OVER wc AS island FROM n {W}) SELECT k, coalesce(max(n), 0)::BIGINT AS value FROM (SELECT k, count(x) - 1 AS n FROM i WHERE x IS NOT NULL GROUP BY k, island) GROUP BY k",
        ),
        "stats_mad": (lambda df: value(stats.mad(df, S, "x", "value")), one("avg(abs(d))", f", t AS (SELECT *, x - avg(x) OVER wa AS d FROM s {W})")),
        "perf_maxdd": (lambda df: value(perf.maxdd(df, S, "x", "value")), one("-min(dd)", dd)),
        "perf_ulcer": (lambda df: value(perf.ulcer(df, S, "x", "value")), one("sqrt(avg(dd * dd))", dd)),
        "perf_recoveryfactor": (lambda df: value(perf.recoveryfactor(plus(df), S, "x", name="value")), one(rate, moved)),
        "perf_calmar": (lambda df: value(perf.calmar(plus(df), S, "x", 1, name="value")), one(rate, recent)),
        "perf_dduration": (
            lambda df: perf.dduration(df, S, "x", "value").select("k", "pos", F.col("value").cast("long").alias("value")),
            f"WITH {PRELUDE}{high}, i AS (SELECT *, sum(new) OVER wc AS island FROM n {W}) SELECT k, pos, (CASE WHEN x IS NULL THEN -1 ELSE count(x) OVER (PARTITION BY k, island ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 END)::BIGINT AS value FROM i",
        ),
        "perf_maxdd_details": (
            lambda df: perf.maxdd_details(df, S, "x").select("k", shown(F.col("maxdd")).alias("maxdd"), *[F.col(n).cast("long").alias(n) for n in ("peak", "trough", "end")]),
            f"""WITH {PRELUDE}{high}, d AS (SELECT *, x / peak - 1 AS dd, max(CASE WHEN new = 1 THEN pos END) OVER wc AS place FROM n {W}),
            low AS (SELECT k, arg_min(pos, (dd, pos)) FILTER (dd IS NOT NULL) AS trough, arg_min(place, (dd, pos)) FILTER (dd IS NOT NULL) AS top, arg_min(peak, (dd, pos)) FILTER (dd IS NOT NULL) AS height, min(dd) AS worst, max(pos) FILTER (x IS NOT NULL) AS last FROM d GROUP BY k)
            SELECT low.k, {shown_sql('-worst')} AS maxdd, top::BIGINT AS peak, trough::BIGINT AS trough, coalesce((SELECT min(pos) FROM d WHERE d.k = low.k AND pos > trough AND x > height), last)::BIGINT AS "end" FROM low""",
        ),
        "perf_expshortfall": (lambda df: value(perf.expshortfall(df, ["k"], "r", name="value")), one("avg(r) FILTER (r <= q)", f", t AS (SELECT *, quantile_cont(r, 0.05) OVER wa AS q FROM s {W})")),
        "perf_tail": (lambda df: value(perf.tail(df, ["k"], "r", name="value")), one("avg(r) FILTER (r >= u) / abs(avg(r) FILTER (r <= q))", f", t AS (SELECT *, quantile_cont(r, 0.05) OVER wa AS q, quantile_cont(r, 0.95) OVER wa AS u FROM s {W})")),
        "perf_dailyreturns": (
            lambda df: perf.dailyreturns(df.withColumn("ms", F.col("pos") * 3_600_000 * 30).withColumn("r", F.col("r") / 1000), ["k"], "ms", "r", 60).select("k", "day_ms", shown(F.col("ret").cast("double")).alias("value")),
            f"""WITH {PRELUDE}, d AS (SELECT k, floor((pos * 108000000 + 3600000) / 86400000)::BIGINT AS day, product(1 + r / 1000) - 1 AS ret FROM s GROUP BY 1, 2),
            a AS (SELECT k, unnest(range(min(day), max(day) + 1)) AS day FROM d GROUP BY k)
            SELECT k, day * 86400000 - 3600000 AS day_ms, {shown_sql('coalesce(ret, 0)::FLOAT')} AS value FROM a LEFT JOIN d USING (k, day)""",
        ),
        "math_ols_multi": (lambda df: math.ols_multi(df, ["k"], ["h", "l"], "c").select("k", *[shown(F.col("coefficients")[i]).alias(f"b{i}") for i in range(3)]), OLS_SQL),
    }
    return out


# Cramer's rule on centred sums.
OLS_SQL = f"""WITH {PRELUDE}, m AS (
  SELECT k, avg(h) AS mh, avg(l) AS ml, avg(c) AS mc, covar_pop(h, h) AS a, covar_pop(h, l) AS b, covar_pop(l, l) AS d, covar_pop(h, c) AS p, covar_pop(l, c) AS q FROM s GROUP BY k
), z AS (SELECT *, (p * d - b * q) / (a * d - b * b) AS s1, (a * q - b * p) / (a * d - b * b) AS s2 FROM m)
SELECT k, {shown_sql('mc - s1 * mh - s2 * ml')} AS b0, {shown_sql('s1')} AS b1, {shown_sql('s2')} AS b2 FROM z"""

RECURRENCES = {
    "ta_ema": Spec("ema", ("x",), (20,)), "ta_dema": Spec("dema", ("x",), (10,)), "ta_tema": Spec("tema", ("x",), (10,)), "ta_t3": Spec("t3", ("c",), (5, 0.7)),
    "ta_kama": Spec("kama", ("x",), (10,)), "ta_rma": Spec("rma", ("x",), (14,)), "ta_rsi": Spec("rsi", ("x",), (14,)), "ta_stochrsi": Spec("stochrsi", ("x",), (14,)),
    "ta_apo": Spec("apo", ("x",), (12, 26)), "ta_ppo": Spec("ppo", ("x",), (12, 26)), "ta_macd": Spec("macd", ("x",), (12, 26, 9)),
    "ta_adosc": Spec("adosc", ("h", "l", "c", "v"), (3, 10)), "ta_atr": Spec("atr", ("h", "l", "c"), (14,)), "ta_natr": Spec("natr", ("h", "l", "c"), (14,)),
    "ta_keltner": Spec("keltner", ("h", "l", "c"), (20, 2.0)), "ta_directional": Spec("directional", ("h", "l", "c"), (14,)),
    "ta_psar": Spec("psar", ("h", "l"), (0.02, 0.2)), "ta_psar_dense": Spec("psar", ("y", "l"), (0.02, 0.2, False)),
    "ta_kama_dense": Spec("kama", ("y",), (4, 2, 30, False)), "ta_rma_dense": Spec("rma", ("y",), (5, False)), "ta_rsi_dense": Spec("rsi", ("y",), (5, False)), "ta_adosc_dense": Spec("adosc", ("y", "l", "c", "v"), (3, 10, False)), "ta_supertrend": Spec("supertrend", ("h", "l", "c"), (10, 3.0)),
}


def recurrence(name: str, spec: Spec) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = with_recurrences(series(spark, sf_dir), S, {"value": spec})
        return made.select("k", "pos", *[shown(F.col(c)).alias(c) for c in spec.outputs("value")])

    query.__name__ = name
    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their 20-bar moving average."""
    return series(spark, sf_dir).select("k", "pos", shown(F.col("c")).alias("c"), shown(ta.sma(S, "c", P)).alias("sma"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {"flagship": flagship}
    out |= {n: e.query for n, e in entries().items()}
    out |= {n: (lambda spark, sf_dir, f=f: f(series(spark, sf_dir))) for n, (f, _) in frames().items()}
    out |= {n: recurrence(n, s) for n, s in RECURRENCES.items()}
    out["math_randuniform"] = lambda spark, sf_dir: randuniform(spark, 1000, -1, 1, seed=1)
    out["math_randnormal"] = lambda spark, sf_dir: randnormal(spark, 1000, 5, 2, seed=1)
    out["stats_shuffle"] = lambda spark, sf_dir: stats.shuffle(series(spark, sf_dir).select("k", "pos"), 1)
    out["stats_sample"] = lambda spark, sf_dir: stats.sample(series(spark, sf_dir).select("k", "pos"), 100, 1)
    out["stats_bootstrap"] = lambda spark, sf_dir: stats.bootstrap(series(spark, sf_dir).select("k", "pos"), 100, 1)
    return out


def oracle_sql() -> dict[str, str]:
    out = {"flagship": f"WITH {PRELUDE} SELECT k, pos, {shown_sql('c')} AS c, {shown_sql(warm(f'avg(c) {R}', P))} AS sma FROM s"}
    out |= {n: t for n, e in entries().items() if (t := e.text())}
    out |= {n: t for n, (_, t) in frames().items() if t}
    out |= recursive.oracle_sql(PRELUDE, shown_sql)
    return out
