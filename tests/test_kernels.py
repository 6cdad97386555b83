"""Recurrences against formulas written another way."""

import numpy as np
import pytest

from seriesmith.operators import kernels as K

RNG = np.random.default_rng(7)
C = 100 + np.cumsum(RNG.normal(size=300))
H, L = C + RNG.random(300), C - RNG.random(300)
GAPPED = np.where(np.arange(300) % 17 == 16, np.nan, C)


def close(a, b):
    assert np.allclose(a, b, atol=1e-8, equal_nan=True)


def test_ema_closed_form():
    p, k = 10, 2 / 11
    want = [np.nan if i < p - 1 else (1 - k) ** i * C[0] + sum(k * (1 - k) ** (i - j) * C[j] for j in range(1, i + 1)) for i in range(300)]
    close(K.ema(C, p), want)
    close(K.ema(C, 1), C)


def test_gaps_are_bridged():
    known = ~np.isnan(GAPPED)
    for f, args in ((K.ema, (9,)), (K.dema, (5,)), (K.tema, (5,)), (K.kama, (8,)), (K.rma, (9,)), (K.rsi, (9,)), (K.apo, (5, 9)), (K.ppo, (5, 9))):
        out = f(GAPPED, *args)
        assert np.isnan(out[~known]).all()
        close(out[known], f(GAPPED[known], *args))


def test_first_rows():
    first = lambda x: int(np.flatnonzero(~np.isnan(x))[0])
    assert first(K.dema(C, 10)) == 18 and first(K.tema(C, 10)) == 27 and first(K.t3(C, 5)) == 24
    assert first(K.rsi(C, 14)) == 14 and first(K.kama(C, 10)) == 9 and first(K.psar(H, L)) == 1
    d = K.directional(H, L, C, 14)
    assert (first(d["plus"]), first(d["adx"]), first(d["adxr"])) == (13, 26, 39)


def test_kama_direct():
    p, out = 10, K.kama(C, 10)
    for i in (50, 200):
        er = abs(C[i] - C[i - p]) / np.abs(np.diff(C[i - p : i + 1])).sum()
        sc = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        assert out[i] == pytest.approx(out[i - 1] + sc * (C[i] - out[i - 1]))


def test_t3_of_constant_and_linear_parts():
    close(K.t3(np.full(60, 5.0), 4)[18:], np.full(42, 5.0))
    stages, k, p = [C], 2 / 6, 5
    for _ in range(6):
        x, out = stages[-1], []
        for i in range(p - 1, len(x)):
            out.append(x[:p].mean() if not out else k * x[i] + (1 - k) * out[-1])
        stages.append(np.array(out))
    b = 0.7
    e3, e4, e5, e6 = (s[-200:] for s in stages[3:7])
    want = -(b**3) * e6 + (3 * b**2 + 3 * b**3) * e5 + (-6 * b**2 - 3 * b - 3 * b**3) * e4 + (1 + 3 * b + b**3 + 3 * b**2) * e3
    close(K.t3(C, 5)[-200:], want)


def test_stochrsi_range():
    r, s = K.rsi(C, 14), K.stochrsi(C, 14)
    for i in (40, 150, 299):
        w = r[i - 13 : i + 1]
        assert s[i] == pytest.approx((r[i] - w.min()) / (w.max() - w.min()))


def test_directional_by_sums():
    p, d = 14, K.directional(H, L, C, 14)
    up, down = np.diff(H), -np.diff(L)
    plus = np.where((up > down) & (up > 0), up, 0)
    true = K.true_range(H, L, C)[1:]
    decay = lambda x, i: x[: p - 1].sum() * (1 - 1 / p) ** (i - p + 1) + sum(x[j - 1] * (1 - 1 / p) ** (i - j) for j in range(p, i + 1))
    for i in (13, 14, 100):
        assert d["plus"][i] == pytest.approx(100 * decay(plus, i) / decay(true, i))


def test_psar_stays_outside():
    """On the side of the bars that its trend has: below both lows or above both highs, and it changes sides where a bar reaches it."""
    out = K.psar(H, L)
    assert not np.isnan(out[1:]).any()
    below, above = out[1:] <= L[1:] + 1e-12, out[1:] >= H[1:] - 1e-12
    assert (below | above).all() and below.any() and above.any()
    with pytest.raises(ValueError):
        K.psar(H, L, 0.3, 0.2)
    # By hand: up from 1 with the extreme 2, then a low under the stop turns it to the extreme.
    got = K.psar(np.array([2.0, 3.0, 4.0, 3.0]), np.array([1.0, 2.0, 3.0, 0.5]), 0.1, 0.2)
    close(got, [np.nan, 1.0, 1.0 + 0.2 * (3 - 1.0) - 0.4, 4.0])


def test_without_skipping_the_first_gap_ends_it():
    first = 16
    for f, args in ((K.kama, (5, 2, 30)), (K.rma, (5,)), (K.rsi, (5,))):
        out = f(GAPPED, *args, False)
        close(out[:first], f(C, *args)[:first])
        assert np.isnan(out[first:]).all()
    v = np.ones(300)
    out = K.adosc(H, L, GAPPED, v, 3, 10, False)
    close(out[:first], K.adosc(H, L, C, v, 3, 10)[:first])
    assert np.isnan(out[first:]).all()
    # The stop is carried over a gap, with which no comparison holds.
    gap = np.array([2.0, 3.0, np.nan, 4.0])
    close(K.psar(gap, np.array([1.0, 2.0, 2.5, 3.0]), 0.1, 0.2, False)[1:3], [1.0, 1.0 + 0.2 * 2 - 0.4])


def test_flat_bars_have_no_direction():
    flat = np.full(40, 5.0)
    d = K.directional(flat + 1, flat - 1, flat, 5)
    assert (d["plus"][4:] == 0).all() and np.isnan(d["dx"]).all() and np.isnan(d["adx"]).all()


def test_supertrend_follows_bands():
    line, upper, lower, up = K.supertrend(H, L, C, 10, 3.0)
    ok = ~np.isnan(line)
    close(line[ok], np.where(up[ok] == 1, lower[ok], upper[ok]))
    assert (up[~ok] == 0).all() and ok.sum() == 291


def test_macd_parts():
    line, signal, hist = K.macd(C, 12, 26, 9)
    close(line, K.apo(C, 12, 26))
    close(hist, line - signal)
    assert hist[25] == 0


@pytest.mark.parametrize("call", [lambda: K.ema(C, 0), lambda: K.apo(C, 9, 9), lambda: K.adosc(H, L, C, C, 10, 3)])
def test_bad_parameters(call):
    with pytest.raises(ValueError):
        call()


def test_short_and_empty():
    for f in (K.ema, K.dema, K.tema, K.t3, K.kama, K.rma, K.rsi, K.stochrsi):
        assert np.isnan(f(C[:3], 14)).all() and len(f(np.empty(0), 3)) == 0
