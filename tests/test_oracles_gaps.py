"""More indicators against plain loops, over the series with gaps of `test_oracles`: what a gap does to averages, windows and states."""

import pytest
from test_oracles import SMA, TYP, C, H, L, N, O, V, avg, back, close_to, lift, moves, over, priced, tables, walk, window  # noqa: F401

from tickloom.plans.run import indicator


def recursive(x, n, rate, start="mean"):
    """A recursive average that passes over gaps. mean: nothing until n samples; partial: sums over n; grow: means of what there is."""
    out, seen, total, y = [], 0, 0.0, None
    for v in x:
        if v is None:
            out.append(None)
            continue
        seen += 1
        if seen <= n:
            total += v
            y = total / (seen if start == "grow" else n)
        else:
            y += rate * (v - y)
        out.append(y if seen >= n or start != "mean" else None)
    return out


def ema(x, n, start="mean"):
    return recursive(x, n, 2 / (n + 1), start)


def dense(x, f, *args):
    """f over the values there are, put back in their places."""
    at = [i for i, v in enumerate(x) if v is not None]
    made, out = f([x[i] for i in at], *args), [None] * len(x)
    for i, v in zip(at, made, strict=True):
        out[i] = v
    return out


def partial_sma(x, n):
    return dense(x, lambda w: [sum(w[max(0, i + 1 - n) : i + 1]) / n for i in range(len(w))])


def from_bar(n, x):
    return [None if i < n else v for i, v in enumerate(x)]


def minus(a, b):
    return lift(lambda p, q: p - q, a, b)


def klinger():
    flow, last = [], 0
    for i in range(N):
        flow.append(V[i] if priced(i, True) and TYP[i] > last else -V[i] if priced(i, True) else None)
        last = TYP[i] if priced(i, True) else last
    return ema(flow, 34), ema(flow, 55)


def twiggs(n=21):
    flow, last = [], 0
    for i in range(N):
        if priced(i, True) and H[i] != L[i]:
            last = V[i] * (2 * TYP[i] - H[i] - L[i]) / (H[i] - L[i])
        flow.append(last if priced(i, True) else None)
    volume = [V[i] if priced(i, True) else None for i in range(N)]
    return lift(lambda a, b: over(a, b) or None, ema(flow, n), ema(volume, n))


def kaufman(c, n=10):
    out, y = [None] * N, None
    if None in c[: n + 1]:
        return out
    for i in range(n, N):
        w = c[i - n : i + 1]
        if i == n:
            y = c[i]
        elif None in w:
            continue
        else:
            way = sum(abs(b - a) for a, b in zip(w, w[1:], strict=False))
            y += ((abs(w[-1] - w[0]) / way if way else 0) * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - y)
        out[i] = y
    return out


def vidya(c, n=15):
    out, y = [], None
    for i in range(len(c)):
        d = [b - a for a, b in zip(c[:i], c[1 : i + 1], strict=True)][-n:]
        if i == 2 * n - 1:
            y = avg(c[n : 2 * n])
        elif i >= 2 * n:
            way = sum(map(abs, d))
            y += 2 / (n + 1) * (abs(sum(d)) / way if way else 0) * (c[i] - y)
        out.append(y)
    return out


def compounding(sign):
    def step(m, i):
        m.setdefault("y", 1000.0)
        if C[i] is not None and V[i] is not None:
            c, v = m.get("last", (0, 0))
            if c and v and V[i] and (V[i] - v) * sign > 0:
                m["y"] *= C[i] / c
            m["last"] = (C[i], V[i])
        return m["y"]

    return walk(step)


ROC = {n: lift(lambda a, b: over(100 * (a - b), b), C, back(C, n)) for n in (10, 15, 20, 30)}
KST = lift(lambda a, b, c, d: a + 2 * b + 3 * c + 4 * d, *(window(avg, ROC[r], n) for r, n in ((10, 10), (15, 10), (20, 10), (30, 15))))


def psychological(c, n=20):
    out, ups = [], 0
    for i in range(len(c)):
        if i >= n and c[i - n] < c[i - 1]:
            ups -= 1
        ups += i > 0 and c[i] > c[i - 1]
        out.append(ups / n if i >= n - 1 else None)
    return out


def mass(n=25, m=9):
    out, runs, ratios, single, double = [], 0, [], None, None
    for i in range(N):
        if H[i] is None or L[i] is None:
            runs, single, double = 0, 0.0, 0.0
        else:
            runs += 1
            if runs == 1:
                single = double = 0.0
            step = (lambda y, x: y + x / m) if runs <= m else (lambda y, x: y + 2 / (m + 1) * (x - y))
            single = step(single, H[i] - L[i])
            double = step(double, single)
            if runs >= m and double:
                ratios.append(single / double)
        out.append(sum(ratios[-n:]) if len(ratios) >= n else None)
    return out


def smooth(x, n):
    return recursive(x, n, 1 / n, "partial")


def rsi_of(x, n):
    d = moves(x)
    return lift(lambda g, b: 50.0 if g + b == 0 else 100 * g / (g + b), smooth(lift(lambda v: max(0.0, v), d), n), smooth(lift(lambda v: max(0.0, -v), d), n))


def connors():
    def streak(m, i):
        if C[i] is None:
            return None
        last, m["last"] = m.get("last"), C[i]
        sign = 1 if last is None else (C[i] > last) - (C[i] < last)
        m["s"] = sign if last is None or m["s"] * sign <= 0 else m["s"] + sign
        return float(m["s"])

    roc = [None if C[i] is None or not C[max(0, i - 100)] else 100 * (C[i] / C[max(0, i - 100)] - 1) for i in range(N)]
    parts = [rsi_of(C, 3), rsi_of(walk(streak), 2), rsi_of(roc, 100)]
    return [from_bar(100, lift(lambda *p, k=k: (*p, avg(p))[k], *parts)) for k in range(4)]


def laguerre(g=0.7):
    def step(m, i):
        if C[i] is None:
            return None
        old = m.get("l", [0.0] * 4)
        new = [(1 - g) * C[i] + g * old[0]]
        for k in (1, 2, 3):
            new.append(-g * new[k - 1] + old[k - 1] + g * old[k])
        d = [new[k] - new[k + 1] for k in range(3)]
        up, down = sum(x for x in d if x > 0), -sum(x for x in d if x < 0)
        m["l"], m["u"], m["d"] = new, (1 - g) * up + g * m.get("u", 0), (1 - g) * down + g * m.get("d", 0)
        return 100 * m["u"] / (m["u"] + m["d"]) if m["u"] + m["d"] else 50.0

    return walk(step)


def jurik(n=20):
    b = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)

    def step(m, i):
        if C[i] is None:
            return None
        if not m.get("formed"):
            m.update(x=C[i], y=C[i], formed=i + 1 >= n)
            return C[i] if m["formed"] else None
        m["x"] += b * (C[i] - m["x"])
        before = m["y"]
        m["y"] += b * (m["x"] - m["y"])
        return m["y"] + 0.5 * (m["y"] - before)

    return walk(step)


def strength():
    d = moves()
    twice = lambda x: ema(ema(x, 25, "partial"), 13, "partial")
    line = from_bar(13, lift(lambda a, b: 100 * a / b if b else 0.0, twice(d), twice(lift(abs, d))))
    return line, from_bar(19, ema(line, 7, "partial"))


def true_ranges():
    def step(m, i):
        if H[i] is None or L[i] is None:
            return None
        last = m.get("last")
        m["last"] = C[i] if C[i] is not None else last
        return H[i] - L[i] if last is None else max(H[i] - L[i], abs(H[i] - last), abs(L[i] - last))

    return walk(step)


ATR = {n: recursive(true_ranges(), n, 1 / n, "grow") for n in (10, 20)}


def directional(n=14):
    plus, minus_, true = [None], [None], [H[0] - L[0] if H[0] is not None else None]
    for i in range(1, N):
        if None in (H[i], L[i], H[i - 1], L[i - 1], C[i - 1]):
            parts = (None, None, None)
        else:
            up, down = H[i] - H[i - 1], L[i - 1] - L[i]
            parts = (max(0.0, up) if up > down else 0.0, max(0.0, down) if down > up else 0.0, max(H[i] - L[i], abs(H[i] - C[i - 1]), abs(L[i] - C[i - 1])))
        for x, v in zip((plus, minus_, true), parts, strict=True):
            x.append(v)
    p, m, t = (recursive(x, n, 1 / n, "grow") for x in (plus, minus_, true))
    a, b = (from_bar(n + 1, lift(lambda x, y: over(100 * x, y), z, t)) for z in (p, m))
    dx = lift(lambda x, y: 100 * abs(x - y) / (x + y) if x + y else 0.0, a, b)
    return from_bar(2 * n, recursive(dx, n, 1 / n, "grow")), dx, a, b


def kroll(sign):
    high, low = window(max, H, 10), window(min, L, 10)
    return partial_sma(lift(lambda a, b: a - 1.5 * (a - b) if sign > 0 else b + 1.5 * (a - b), high, low), 9)


def wave():
    esa = ema(TYP, 10)
    d = ema(lift(lambda t, e: abs(t - e), TYP, esa), 14)
    first = lift(lambda t, e, x: over(t - e, 0.015 * x), TYP, esa, d)
    return first, partial_sma(first, 3)


def brown():
    r, q = rsi_of(C, 14), rsi_of(C, 3)
    roc = lift(lambda a, b: over(100 * (a - b), b), r, back(r, 9))
    made = from_bar(14, lift(lambda a, b: a + b, roc, partial_sma(q, 3)))
    return made, window(avg, made, 13), window(avg, made, 33)


MACD = {(a, b): minus(ema(C, a), ema(C, b)) for a, b in ((12, 26), (23, 50))}


def schaff(n=10, cycle=5):
    histogram = minus(MACD[23, 50], ema(MACD[23, 50], 3))
    closes, raws, out, last, formed = [], [], [], 0.0, False
    for i in range(N):
        closes = (closes + ([C[i]] if C[i] is not None else []))[-n:]
        if histogram[i] is None:
            out.append(None)
            continue
        k, wide = last, max(closes) - min(closes)
        if wide:
            raws = [*raws, (histogram[i] - min(closes)) / wide][-cycle:]
            k = 100 * (raws[-1] - min(raws)) / (max(raws) - min(raws)) if max(raws) != min(raws) else 0.0
            formed = formed or len(raws) == cycle
        last = k if formed else last
        out.append(k if formed else None)
    return ema(out, n)


def kase(n=10):
    peaks, last, short, long = [], 0, [None] * N, [None] * N
    for i in range(n - 1, N):
        if not priced(i):
            continue
        peak, valley, a = H[i], L[i], ATR[n][i]
        if last and C[i] > last:
            peak, valley = max(H[i], last + a), max(L[i], last - 0.5 * a)
        elif last and C[i] < last:
            peak, valley = min(H[i], last + 0.5 * a), min(L[i], last - a)
        peaks, last = [*peaks, (peak, valley)][-2:], C[i]
        top, bottom = max(p[0] for p in peaks), min(p[1] for p in peaks)
        short[i] = 100 * (C[i] - bottom) / (top - bottom) if top != bottom else 0.0
        long[i] = 100 * (C[i] - peaks[0][1]) / (peaks[0][0] - peaks[0][1]) if peaks[0][0] != peaks[0][1] else 0.0
    return from_bar(n + 7, short), from_bar(n + 16, long)


def elder():
    e, m = ema(C, 13, "partial"), minus(ema(C, 12, "partial"), ema(C, 26, "partial"))
    return from_bar(25, lift(lambda a, b, c, d: 1.0 if a > b and c > d else -1.0 if a < b and c < d else 0.0, e, back(e, 1), m, back(m, 1)))


def ppo():
    line = lift(lambda a, b: 100 * (a - b) / b if b else 0.0, ema(C, 12), ema(C, 26))
    return line, ema(line, 9)


def trix():
    c = ema(ema(ema(C, 14), 14), 14)
    return lift(lambda a, b: over(1000 * (a - b), b), c, back(c, 1))


def momentum_index():
    d = moves(C, 3)
    return lift(lambda u, w: over(100 * u, u + w), window(avg, lift(lambda v: max(v, 0.0), d), 14), window(avg, lift(lambda v: max(-v, 0.0), d), 14))


def middle(n):
    return lift(lambda a, b: (a + b) / 2, window(max, H, n), window(min, L, n))


def ahead(raw, first, k=26):
    return [None if i < first + k - 1 else raw[max(i - k, first)] for i in range(N)]


def hull(n=10):
    line = lambda x, n: window(lambda w: sum((k + 1) * v for k, v in enumerate(w)) * 2 / (n * (n + 1)), x, n)
    return line(lift(lambda a, b: 2 * a - b, line(C, n // 2), line(C, n)), 3)


def line_of(move):
    total, out = 0.0, []
    for i in range(N):
        if priced(i, True) and O[i] is not None and H[i] != L[i]:
            total += move(i) / (H[i] - L[i]) * V[i]
        out.append(total)
    return out


ADL = line_of(lambda i: (C[i] - L[i]) - (H[i] - C[i]))
K, T, X, B, D, W, S = klinger(), strength(), connors(), brown(), directional(), wave(), ppo()
KELTNER = from_bar(19, ema(C, 20, "partial"))

WANT = {
    "KlingerVolumeOscillator": {"shortEma": K[0], "longEma": K[1], "oscillator": minus(*K)},
    "TwiggsMoneyFlow": {"value": twiggs()},
    "KaufmanAdaptiveMovingAverage": {"value": kaufman(C)},
    "Vidya": {"value": dense(C, vidya)},
    "NegativeVolumeIndex": {"value": compounding(-1)},
    "PositiveVolumeIndex": {"value": compounding(1)},
    "KnowSureThing": {"kst": KST, "signal": dense(KST, lambda w: window(avg, w, 9))},
    "PsychologicalLine": {"value": dense(C, psychological)},
    "MassIndex": {"value": mass()},
    "ConnorsRSI": dict(zip(("rsi", "updown", "rocrsi", "crsi"), X, strict=True)),
    "LaguerreRSI": {"value": laguerre()},
    "JurikMovingAverage": {"value": jurik()},
    "TrueStrengthIndex": {"tsi": T[0], "signal": T[1]},
    "KeltnerChannels": {"middle": lift(lambda m, _: m, KELTNER, ATR[20]), "upper": lift(lambda m, a: m + 2 * a, KELTNER, ATR[20]), "lower": lift(lambda m, a: m - 2 * a, KELTNER, ATR[20])},
    "AverageDirectionalIndex": dict(zip(("adx", "dx", "plusDI", "minusDI"), D, strict=True)),
    "DirectionalIndex": dict(zip(("dx", "plusDI", "minusDI"), D[1:], strict=True)),
    "ChandeKrollStop": {"longStop": kroll(1), "shortStop": kroll(-1)},
    "WaveTrendOscillator": {"wt1": W[0], "wt2": W[1]},
    "ConstanceBrownCompositeIndex": dict(zip(("composite", "fastSma", "slowSma"), B, strict=True)),
    "SchaffTrendCycle": {"value": schaff()},
    "KasePeakOscillator": dict(zip(("shortTerm", "longTerm"), kase(), strict=True)),
    "ElderImpulseSystem": {"value": elder()},
    "MovingAverageConvergenceDivergence": {"macd": MACD[12, 26], "signal": ema(MACD[12, 26], 9), "histogram": minus(MACD[12, 26], ema(MACD[12, 26], 9))},
    "PercentagePriceOscillator": {"ppo": S[0], "signal": S[1], "histogram": minus(*S)},
    "Trix": {"value": trix()},
    "RelativeMomentumIndex": {"value": momentum_index()},
    "Ichimoku": {"tenkan": middle(9), "kijun": middle(26), "senkouA": ahead(lift(lambda a, b: (a + b) / 2, middle(9), middle(26)), 25), "senkouB": ahead(middle(52), 51), "chikou": from_bar(25, C)},
    "HullMovingAverage": {"value": hull()},
    "KaufmanEfficiencyRatio": {"value": window(lambda w: over(abs(w[-1] - w[0]), sum(abs(b - a) for a, b in zip(w, w[1:], strict=False))) or 0.0, C, 10)},
    "DetrendedPriceOscillator": {"value": from_bar(4, lift(lambda c, m: c - m, C, back(window(avg, C, 3), 2)))},
    "PrettyGoodOscillator": {"value": lift(lambda c, m, a, b: over(100 * (c - m), a - b), C, SMA[14], window(max, H, 14), window(min, L, 14))},
    "AccumulationDistributionLine": {"value": ADL},
    "ChaikinOscillator": {"value": minus(ema(ADL, 3), ema(ADL, 10))},
    "WilliamsVariableAccumulationDistribution": {"value": line_of(lambda i: C[i] - O[i])},
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_indicator_equals_plain_loop_over_gaps(tables, name):  # noqa: F811
    rows = indicator(tables[0], name).orderBy("time").collect()
    for output, want in WANT[name].items():
        off = [i for i in range(N) if not close_to(rows[i][output], want[i])]
        assert off == [], (output, [(i, rows[i][output], want[i]) for i in off[:4]])


def test_formulas_without_a_gap(tables):  # noqa: F811
    """Strict starts give nothing on the series with gaps; these are held over the one that has all closes."""
    _, whole, closes = tables
    got = [r["value"] for r in indicator(whole, "kama").orderBy("time").collect()]
    assert [i for i in range(N) if not close_to(got[i], kaufman(closes)[i])] == []


def test_a_missing_close_ends_the_average_range(spark):
    bars = [("s", i, 10.0, 12.0 + i % 3, 9.0, None if i == 30 else 10.5 + i % 2, 1.0) for i in range(40)]
    df = spark.createDataFrame(bars, "symbol string, time long, open double, high double, low double, close double, volume double")
    got = [r["value"] for r in indicator(df, "atr").orderBy("time").collect()]
    want = []
    for i in range(40):
        before = bars[i - 1][5] if i else None
        tr = bars[i][3] - 9.0 if not i else None if before is None else max(bars[i][3] - 9.0, abs(bars[i][3] - before), abs(9.0 - before))
        want.append(tr)
    seed = avg(want[:14])
    out = [None] * 13 + [seed]
    for i in range(14, 40):
        seed = None if seed is None or want[i] is None else (seed * 13 + want[i]) / 14
        out.append(seed)
    assert all(close_to(a, b) for a, b in zip(got, out, strict=True)) and out[30] is not None and out[31] is None

