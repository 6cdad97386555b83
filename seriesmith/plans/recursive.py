"""SQL of the recurrences: recursive queries that carry the state as columns."""

from __future__ import annotations

from collections.abc import Callable


def walk(prelude: str, feed: str, state: dict[str, tuple[str, str]], outputs: dict[str, str], shown: Callable[[str], str]) -> str:
    """A step over the rows of ``f`` (k, n from 1: the known rows in order, with pos); outputs join back on pos.

    state: column -> (first value, next value), where p is the row before and f the row now.
    """
    first = ", ".join(f"({a})::DOUBLE AS {n}" for n, (a, _) in state.items())
    then = ", ".join(f"({b})::DOUBLE" for _, b in state.values())
    out = ", ".join(f"{shown(e)} AS {n}" for n, e in outputs.items())
    return f"""WITH RECURSIVE {prelude}, f AS ({feed}), p AS (
  SELECT f.k, f.n, f.pos, {first} FROM f WHERE n = 1
  UNION ALL SELECT f.k, f.n, f.pos, {then} FROM p JOIN f ON f.k = p.k AND f.n = p.n + 1
) SELECT s.k, s.pos, {out} FROM s LEFT JOIN p ON p.k = s.k AND p.pos = s.pos"""


def known(columns: str, condition: str) -> str:
    return f"SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS n, {columns} FROM s WHERE {condition}"


def ema_step(name: str, p: int, x: str = "f.x") -> tuple[str, str]:
    return x, f"p.{name} + {2 / (p + 1)!r} * ({x} - p.{name})"


def rma_state(name: str, p: int, x: str) -> dict[str, tuple[str, str]]:
    """name: the running sum before the p-th row, then the average."""
    return {name: (x, f"CASE WHEN f.n < {p} THEN p.{name} + {x} WHEN f.n = {p} THEN (p.{name} + {x}) / {p} ELSE (p.{name} * {p - 1} + {x}) / {p} END")}


def kama_feed(x: str, p: int) -> str:
    """Of each known row: the change over p rows and the path of the last p moves."""
    rows = "PARTITION BY k ORDER BY pos"
    moves = f"SELECT k, pos, {x} AS x, abs({x} - lag({x}) OVER ({rows})) AS d, row_number() OVER ({rows}) AS n FROM s WHERE {x} IS NOT NULL"
    return f"SELECT k, pos, n, x, abs(x - lag(x, {p}) OVER ({rows})) AS change, sum(d) OVER ({rows} ROWS {p - 1} PRECEDING) AS path FROM ({moves})"


def kama_state(p: int) -> dict[str, tuple[str, str]]:
    pace = f"power(CASE WHEN f.path = 0 THEN 0 ELSE f.change / f.path END * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)"
    return {"a": ("NULL", f"CASE WHEN f.n = {p} THEN f.x WHEN f.n > {p} THEN p.a + {pace} * (f.x - p.a) END")}


def t3_state(p: int) -> dict[str, tuple[str, str]]:
    """Six averages; each sums p values of the one below before it is an average."""
    k, below, out = 2 / (p + 1), "f.x", {}
    for j in range(6):
        start, ready = j * (p - 1) + 1, (j + 1) * (p - 1) + 1
        old = f"CASE WHEN f.n < {ready} THEN 1 WHEN f.n = {ready} THEN {1 / p!r} ELSE {1 - k!r} END"
        new = f"CASE WHEN f.n < {start} THEN 0 WHEN f.n < {ready} THEN 1 WHEN f.n = {ready} THEN {1 / p!r} ELSE {k!r} END"
        below = f"(({old}) * p.e{j} + ({new}) * {below})"
        out[f"e{j}"] = ("0" if j else "f.x", below)
    return out


T3_SUM = " + ".join(f"({w!r}) * p.e{j}" for j, w in ((5, -(0.7**3)), (4, 3 * 0.7**2 + 3 * 0.7**3), (3, -6 * 0.7**2 - 3 * 0.7 - 3 * 0.7**3), (2, 1 + 3 * 0.7 + 0.7**3 + 3 * 0.7**2)))


def stochrsi(prelude: str, deltas: str, rsi: str, shown: Callable[[str], str]) -> str:
    state = rma_state("a", 14, "f.g") | rma_state("z", 14, "f.b")
    whole = walk(prelude, deltas, state, {"r": f"CASE WHEN p.n >= 14 THEN {rsi} END"}, lambda e: e)
    over = "OVER (PARTITION BY k ORDER BY pos ROWS 13 PRECEDING)"
    place = f"CASE WHEN count(*) {over} < 14 THEN NULL WHEN max(r) {over} = min(r) {over} THEN 0 ELSE (r - min(r) {over}) / (max(r) {over} - min(r) {over}) END"
    return f"WITH r AS ({whole}), t AS (SELECT k, pos, {place} AS value FROM r WHERE r IS NOT NULL) SELECT r.k, r.pos, {shown('t.value')} AS value FROM r LEFT JOIN t ON t.k = r.k AND t.pos = r.pos"


def directional(q: Callable[..., str], p: int) -> str:
    rows = "OVER (PARTITION BY k ORDER BY pos)"
    up, down, pc = f"h - lag(h) {rows}", f"lag(l) {rows} - l", f"lag(c) {rows}"
    feed = known(
        f"greatest(h - l, abs(h - {pc}), abs(l - {pc})) AS t, CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0 END AS a, CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0 END AS b", "true"
    )
    now = {x: f"(CASE WHEN f.n > {p} THEN p.{x} - p.{x} / {p} ELSE p.{x} END + f.{x})" for x in "tab"}
    dx = f"100 * abs({now['a']} - {now['b']}) / nullif({now['a']} + {now['b']}, 0)"
    seed = 2 * p - 1
    adx = f"CASE WHEN f.n < {p} THEN 0 WHEN f.n < {seed} THEN p.x + {dx} WHEN f.n = {seed} THEN (p.x + {dx}) / {p} ELSE (p.x * {p - 1} + {dx}) / {p} END"
    state = {x: ("0", e) for x, e in now.items()} | {"x": ("0", adx)}
    when = lambda n, e: f"CASE WHEN p.n >= {n} THEN {e} END"
    before = f"lag({when(seed, 'p.x')}, {p - 1}) OVER (PARTITION BY s.k ORDER BY s.pos)"
    return q(
        feed, state, value_plus=when(p, "100 * p.a / nullif(p.t, 0)"), value_minus=when(p, "100 * p.b / nullif(p.t, 0)"), value_dx=when(p, "100 * abs(p.a - p.b) / nullif(p.a + p.b, 0)"),
        value_adx=when(seed, "p.x"), value_adxr=f"({when(seed + 1, 'p.x')} + {before}) / 2",
    )


def bars_ahead(high: str) -> str:
    """High and low with those of the two rows before and of the next; a missing value is NaN, with which no comparison holds."""
    rows = "OVER (PARTITION BY k ORDER BY pos)"
    two = lambda x: f"coalesce(lag({x}, 2) {rows}, lag({x}) {rows})"
    return f"""SELECT k, pos, row_number() {rows} AS n, h, l, lag(h) {rows} AS h1, lag(l) {rows} AS l1, {two('h')} AS h2, {two('l')} AS l2, lead(h) {rows} AS h0, lead(l) {rows} AS l0
    FROM (SELECT k, pos, coalesce({high}, 'nan'::DOUBLE) AS h, l FROM s)"""


def over(a: str, b: str) -> str:
    """a > b, false for NaN, which the database puts above all numbers."""
    return f"({a} > {b} AND NOT isnan({a}) AND NOT isnan({b}))"


def psar_state(step: float = 0.02, most: float = 0.2) -> dict[str, tuple[str, str]]:
    """long: 1 or 0."""
    rises = "(f.h + f.l <= f.h0 + f.l0)"
    ahead = "(p.sar + p.af * (p.best - p.sar))"
    bound = lambda e, one, low: f"(CASE WHEN {over(e, one) if low else over(one, e)} THEN {one} ELSE {e} END)"
    falls, tops = bound(bound(ahead, "f.l2", True), "f.l1", True), bound(bound(ahead, "f.h2", False), "f.h1", False)
    moved = f"(CASE WHEN p.long > 0 THEN {over('f.h', 'p.best')} ELSE {over('p.best', 'f.l')} END)"
    best = f"(CASE WHEN {moved} THEN CASE WHEN p.long > 0 THEN f.h ELSE f.l END ELSE p.best END)"
    turned = f"(CASE WHEN p.long > 0 THEN {over(falls, 'f.l')} ELSE {over('f.h', tops)} END)"
    return {
        "sar": (f"CASE WHEN {rises} THEN f.l ELSE f.h END", f"CASE WHEN {turned} THEN {best} WHEN p.long > 0 THEN {falls} ELSE {tops} END"),
        "best": (f"CASE WHEN {rises} THEN f.h ELSE f.l END", f"CASE WHEN {turned} THEN CASE WHEN p.long > 0 THEN f.l ELSE f.h END ELSE {best} END"),
        "af": (repr(step), f"CASE WHEN {turned} THEN {step} WHEN {moved} THEN least(p.af + {step}, {most}) ELSE p.af END"),
        "long": (f"({rises})::INT", f"CASE WHEN {turned} THEN 1 - p.long ELSE p.long END"),
    }


def supertrend_state(p: int, mult: float) -> dict[str, tuple[str, str]]:
    atr = rma_state("a", p, "f.x")["a"]
    upper, lower = f"((f.h + f.l) / 2 + {mult} * ({atr[1]}))", f"((f.h + f.l) / 2 - {mult} * ({atr[1]}))"
    top = f"(CASE WHEN f.n < {p} THEN NULL WHEN f.n = {p} OR {upper} < p.upper OR f.pc > p.upper THEN {upper} ELSE p.upper END)"
    low = f"(CASE WHEN f.n < {p} THEN NULL WHEN f.n = {p} OR {lower} > p.lower OR f.pc < p.lower THEN {lower} ELSE p.lower END)"
    return {"a": atr, "upper": ("NULL", top), "lower": ("NULL", low), "up": ("1", f"CASE WHEN f.n < {p} THEN 1 WHEN f.c > {top} THEN 1 WHEN f.c < {low} THEN 0 ELSE p.up END")}


def oracle_sql(prelude: str, shown: Callable[[str], str]) -> dict[str, str]:
    x = known("x", "x IS NOT NULL")
    q = lambda feed, state, **outputs: walk(prelude, feed, state, outputs, shown)
    when = lambda n, e: f"CASE WHEN p.n >= {n} THEN {e} END"
    out = {"ta_ema": q(x, {"a": ema_step("a", 20)}, value=when(20, "p.a"))}

    def stage(name: str, below: str, p: int, at: int) -> tuple[str, str]:
        """An EMA of the column below, seeded when that is at its at-th row."""
        now = {"a": f"(p.a + {2 / (p + 1)!r} * (f.x - p.a))"}
        now["b"] = f"CASE WHEN f.n = {p} THEN {now['a']} WHEN f.n > {p} THEN p.b + {2 / (p + 1)!r} * ({now['a']} - p.b) END"
        v = now[below]
        return "NULL", f"CASE WHEN f.n = {at} THEN {v} WHEN f.n > {at} THEN p.{name} + {2 / (p + 1)!r} * ({v} - p.{name}) END"

    two = {"a": ema_step("a", 10), "b": stage("b", "a", 10, 10)}
    out["ta_dema"] = q(x, two, value=when(19, "2 * p.a - p.b"))
    out["ta_tema"] = q(x, two | {"c": stage("c", "b", 10, 19)}, value=when(28, "3 * p.a - 3 * p.b + p.c"))
    out["ta_rma"] = q(x, rma_state("a", 14, "f.x"), value=when(14, "p.a"))
    deltas = "SELECT * EXCLUDE (d), greatest(d, 0) AS g, greatest(-d, 0) AS b, n - 1 AS n FROM (SELECT k, pos, x - lag(x) OVER (PARTITION BY k ORDER BY pos) AS d, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM s WHERE x IS NOT NULL) WHERE d IS NOT NULL"
    deltas = deltas.replace("* EXCLUDE (d)", "k, pos")
    out["ta_rsi"] = q(deltas, rma_state("a", 14, "f.g") | rma_state("z", 14, "f.b"), value=when(14, "CASE WHEN p.z = 0 THEN 100 ELSE 100 - 100 / (1 + p.a / p.z) END"))
    pair = {"a": ema_step("a", 12), "b": ema_step("b", 26)}
    out["ta_apo"] = q(x, pair, value=when(26, "p.a - p.b"))
    out["ta_ppo"] = q(x, pair, value=when(26, "CASE WHEN p.b = 0 THEN 0 ELSE 100 * (p.a - p.b) / p.b END"))
    line = f"({pair['a'][1]} - ({pair['b'][1]}))"
    signal = {"s": ("NULL", f"CASE WHEN f.n = 26 THEN {line} WHEN f.n > 26 THEN p.s + 0.2 * ({line} - p.s) END")}
    out["ta_macd"] = q(x, pair | signal, value_line=when(26, "p.a - p.b"), value_signal=when(26, "p.s"), value_hist=when(26, "p.a - p.b - p.s"))
    flow = "sum(CASE WHEN h = l THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS x"
    out["ta_adosc"] = q(known(flow, "true"), {"a": ema_step("a", 3), "b": ema_step("b", 10)}, value=when(10, "p.a - p.b"))
    before = "lag(c) OVER (PARTITION BY k ORDER BY pos)"
    true = f"CASE WHEN pos = 0 THEN h - l ELSE greatest(h - l, abs(h - {before}), abs(l - {before})) END AS x, c, h, l, {before} AS pc"
    feed = known(true, "true")
    atr = rma_state("a", 14, "f.x")
    out["ta_atr"] = q(feed, atr, value=when(14, "p.a"))
    out["ta_natr"] = q(feed, atr, value=when(14, "100 * p.a / nullif(s.c, 0)"))
    band = rma_state("a", 20, "f.x") | {"m": ema_step("m", 20, "(f.h + f.l + f.c) / 3")}
    dense = lambda n, e: f"CASE WHEN p.n >= {n} AND s.pos < 12 THEN {e} END"  # noqa: E731  # y is missing at place 12 first
    y = known("y AS x", "y IS NOT NULL")
    out["ta_rma_dense"] = q(y, rma_state("a", 5, "f.x"), value=dense(5, "p.a"))
    out["ta_rsi_dense"] = q(deltas.replace("x", "y"), rma_state("a", 5, "f.g") | rma_state("z", 5, "f.b"), value=dense(5, "CASE WHEN p.z = 0 THEN 100 ELSE 100 - 100 / (1 + p.a / p.z) END"))
    out["ta_adosc_dense"] = q(known(flow.replace("h", "y"), "y IS NOT NULL"), {"a": ema_step("a", 3), "b": ema_step("b", 10)}, value=dense(10, "p.a - p.b"))
    out["ta_kama"] = q(kama_feed("x", 10), kama_state(10), value=when(10, "p.a"))
    out["ta_kama_dense"] = q(kama_feed("y", 4), kama_state(4), value=dense(4, "p.a"))
    out["ta_t3"] = q(known("c AS x", "c IS NOT NULL"), t3_state(5), value=when(25, T3_SUM))
    rsi = "CASE WHEN p.z = 0 THEN 100 ELSE 100 - 100 / (1 + p.a / p.z) END"
    out["ta_stochrsi"] = stochrsi(prelude, deltas, rsi, shown)
    out["ta_directional"] = directional(q, 14)
    out["ta_psar"] = q(bars_ahead("h"), psar_state(), value=when(2, "p.sar"))
    out["ta_psar_dense"] = q(bars_ahead("y"), psar_state(), value=when(2, "p.sar"))
    out["ta_supertrend"] = q(feed, supertrend_state(10, 3.0), value_line=when(10, "CASE WHEN p.up > 0 THEN p.lower ELSE p.upper END"), value_upper=when(10, "p.upper"), value_lower=when(10, "p.lower"), value_up="CASE WHEN p.n >= 10 THEN p.up ELSE 0 END")
    out["ta_keltner"] = q(feed, band, value_mid=when(20, "p.m"), value_upper=when(20, "p.m + 2 * p.a"), value_lower=when(20, "p.m - 2 * p.a"))
    return out
