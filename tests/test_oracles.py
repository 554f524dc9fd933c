"""Indicators against plain loops that share nothing with their plans, over a series with gaps and zeros.

The series is the parity series (sine waves about 100); bars 0, 40, 41 and 90 lack prices, 60 lacks a volume, 75 has a close
of zero and 120-123 are flat.
"""

import math

import pytest

from tickloom.plans.run import indicator

N = 160


def series():
    out, before = [], 100.0
    for i in range(N):
        c = round(100 + 15 * math.sin(i / 9) + 6 * math.cos(i / 4) + 0.05 * i, 2)
        spread = round(1.5 + abs(math.sin(i / 3)), 2)
        bar = {"open": before, "high": max(c, before) + spread, "low": min(c, before) - spread, "close": c, "volume": float(round(1500 + 400 * math.sin(i / 5)))}
        before = c
        if i in (0, 40, 41, 90):
            bar.update(open=None, high=None, low=None, close=None)
        if i == 60:
            bar["volume"] = None
        if i == 75:
            bar.update(close=0.0, low=0.0)
        if 120 <= i <= 123:
            bar.update(open=c, high=c, low=c)
        out.append(bar)
    return out


BARS = series()
O, H, L, C, V = ([b[k] for b in BARS] for k in ("open", "high", "low", "close", "volume"))


def lift(f, *xs):
    """f over values of one bar; null where one of them is."""
    return [None if any(v is None for v in row) else f(*row) for row in zip(*xs, strict=True)]


def back(x, k):
    return [None] * k + x[: len(x) - k] if k else x


def window(f, x, n):
    """f over the last n values; null until there are n and while one is null."""
    return [None if i + 1 < n or any(v is None for v in x[i + 1 - n : i + 1]) else f(x[i + 1 - n : i + 1]) for i in range(len(x))]


def avg(w):
    return math.fsum(w) / len(w)


def sd(w):
    m = avg(w)
    return math.sqrt(math.fsum((v - m) ** 2 for v in w) / len(w))


def over(a, b):
    return None if b == 0 else a / b


def fit(w):
    """Slope and mean of a least-squares line."""
    n, m = len(w), avg(w)
    x = (n - 1) / 2
    return sum((k - x) * (v - m) for k, v in enumerate(w)) / sum((k - x) ** 2 for k in range(n)), m


def weights(w, f):
    return window(lambda x: sum(f(k, len(x)) * v for k, v in enumerate(x)), C, w)


def fixed_rate(x, n, rate):
    """Recursive average whose first value is the mean of the first n rows, which all must be there."""
    out, y = [None] * len(x), None
    if any(v is None for v in x[:n]):
        return out
    for i in range(n - 1, len(x)):
        if i == n - 1:
            y = avg(x[:n])
        elif x[i] is None:
            continue
        else:
            y += rate * (x[i] - y)
        out[i] = y
    return out


def walk(step):
    """Value of each bar from a function with a memory of its own."""
    memory = {}
    return [step(memory, i) for i in range(N)]


def priced(i, volume=False):
    return None not in (H[i], L[i], C[i]) and (not volume or V[i] is not None)


def vwap(m, i):
    if priced(i, True):
        m["a"] = m.get("a", 0) + (H[i] + L[i] + C[i]) / 3 * V[i]
        m["b"] = m.get("b", 0) + V[i]
    return m["a"] / m["b"] if m.get("b", 0) > 0 else None


def twap(m, i):
    if not priced(i):
        return None
    m.setdefault("all", []).append((H[i] + L[i] + C[i]) / 3)
    return avg(m["all"])


def obv(m, i):
    if "last" not in m:
        if C[i] is not None:
            m["last"] = C[i]
        return None
    if C[i] is None or V[i] is None:
        return None
    m["sum"] = m.get("sum", 0) + ((C[i] > m["last"]) - (C[i] < m["last"])) * V[i]
    m["last"] = C[i]
    return m["sum"]


def balance(m, i):
    if C[i] is None or V[i] is None:
        return None
    last = m.get("last", 0)
    m["sum"] = m.get("sum", 0) + (((C[i] > last) - (C[i] < last)) * V[i] if last else 0)
    m["last"] = C[i]
    return m["sum"]


def pvt(m, i):
    if C[i] is None or V[i] is None:
        return None
    last, m["last"] = m.get("last", 0), C[i]
    if last == 0:
        return None
    m["sum"] = m.get("sum", 0) + V[i] * (C[i] - last) / last
    return m["sum"]


def wad(m, i):
    if C[i] is None:
        return None
    last, m["last"] = m.get("last", 0), C[i]
    if last == 0 or H[i] is None or L[i] is None:
        return None
    m["sum"] = m.get("sum", 0) + (C[i] - min(L[i], last) if C[i] > last else C[i] - max(H[i], last) if C[i] < last else 0)
    return m["sum"]


def cmf(length=20):
    flow = [None if not priced(i, True) else 0.0 if H[i] == L[i] else ((C[i] - L[i]) - (H[i] - C[i])) / (H[i] - L[i]) * V[i] for i in range(N)]
    out = []
    for i in range(N):
        bottom = sum(V[k] for k in range(i + 1) if flow[k] is not None) - sum(flow[k] for k in range(max(0, i + 1 - length)) if flow[k] is not None)
        last = flow[max(0, i + 1 - length) : i + 1]
        out.append(None if i < length - 1 or None in last else sum(last) / bottom if bottom else 0.0)
    return out


def mfi(length=14):
    out, last, flows = [], 0.0, []
    for i in range(N):
        if not priced(i, True):
            flows.append((0.0, 0.0))
            out.append(None)
            continue
        t = (H[i] + L[i] + C[i]) / 3
        flows.append((t * V[i] if t > last else 0.0, t * V[i] if t < last else 0.0))
        last = t
        up, down = (sum(f[k] for f in flows[-length:]) for k in (0, 1))
        out.append(None if i < length - 1 else 100.0 if down == 0 else 100 * up / (up + down))
    return out


def chop(length=14):
    out, ranges, trues, last = [], [], [], 0.0
    for i in range(N):
        if not priced(i):
            out.append(None)
            continue
        ranges.append(H[i] - L[i])
        trues.append(max(H[i] - L[i], abs(H[i] - last), abs(L[i] - last)))
        last = C[i]
        a, b = sum(trues[-length:]), sum(ranges[-length:])
        out.append(100 * math.log10(a / b) / math.log10(length) if len(trues) >= length and a > 0 and b > 0 else None)
    return out


def demarker(length=14):
    out, samples, last = [], [], None
    for i in range(N):
        value = None
        if H[i] is not None and L[i] is not None:
            if last:
                samples.append((max(0.0, H[i] - last[0]), max(0.0, last[1] - L[i])))
                if len(samples) >= length:
                    a, b = (sum(s[k] for s in samples[-length:]) for k in (0, 1))
                    value = a / (a + b) if a + b else 0.5
            last = (H[i], L[i])
        out.append(value)
    return out


def vortex(sign, length=14):
    def parts(i):
        if not i or None in (H[i], L[i], H[i - 1], L[i - 1], C[i - 1]):
            return None
        true = max(H[i] - L[i], abs(H[i] - C[i - 1]), abs(L[i] - C[i - 1]))
        return true, abs(H[i] - L[i - 1]) if sign > 0 else abs(L[i] - H[i - 1])

    return window(lambda w: over(sum(x[1] for x in w), sum(x[0] for x in w)) or 0.0, [parts(i) for i in range(N)], length)


def ultimate():
    parts, last = [], None
    for i in range(N):
        parts.append((C[i] - min(L[i], last), max(H[i], last) - min(L[i], last)) if priced(i) and last is not None else None)
        last = C[i] if priced(i) else last
    shares = [window(lambda w: over(sum(x[0] for x in w), sum(x[1] for x in w)), parts, n) for n in (7, 14, 28)]
    return lift(lambda a, b, c: 100 * (4 * a + 2 * b + c) / 7, *shares)


def true_range(m, i):
    if H[i] is None or L[i] is None:
        return None
    last = m.get("last")
    m["last"] = C[i] if C[i] is not None else last
    return None if last is None else max(H[i] - L[i], abs(H[i] - last), abs(L[i] - last))


def moves(x=C, k=1):
    return lift(lambda a, b: a - b, x, back(x, k))


def rsi(length=14):
    # smoothed: sum over n from the first sample on
    def smooth(x):
        out, seen, y = [], 0, 0.0
        for v in x:
            if v is not None:
                seen += 1
                y = y + v / length if seen <= length else y + (v - y) / length
            out.append(y if v is not None else None)
        return out

    d = moves()
    g, b = smooth(lift(lambda v: max(0.0, v), d)), smooth(lift(lambda v: max(0.0, -v), d))
    made = lift(lambda p, q: 50.0 if p + q == 0 else 100 * p / (p + q), g, b)
    return [None if i < length else v for i, v in enumerate(made)]


def money(length=22):
    raw = [0.0 if not priced(i) or H[i] == L[i] or not V[i] else 2 * (C[i] - L[i]) / (H[i] - L[i]) - 1 for i in range(N)]
    return lift(lambda v: 100 * v, window(avg, raw, length))


def rank_correlation(w):
    n = len(w)
    r = [sum(b < a for b in w) + (sum(b == a for b in w) + 1) / 2 for a in w]
    m = (n + 1) / 2
    below = math.sqrt(sum((x - m) ** 2 for x in r) * n * (n * n - 1) / 12)
    return over(sum((k + 1 - m) * (x - m) for k, x in enumerate(r)), below)


TYP = lift(lambda h, low, c: (h + low + c) / 3, H, L, C)
MIDS = lift(lambda h, low: (h + low) / 2, H, L)
SMA = {n: window(avg, C, n) for n in (5, 9, 14, 20, 25, 34, 50, 7, 65, 10, 30)}
HIGH = {n: window(max, H, n) for n in (20, 14, 10)}
LOW = {n: window(min, L, n) for n in (20, 14, 10)}
STOCH = lift(lambda c, h, low: 100 * (c - low) / (h - low) if h != low else 0.0, C, HIGH[14], LOW[14])
CCI = {n: lift(lambda t, m, d: 0.0 if d == 0 else (t - m) / (0.015 * d), TYP, window(avg, TYP, n), window(lambda w: avg([abs(v - avg(w)) for v in w]), TYP, n)) for n in (20, 14)}
BALANCE = walk(balance)

#: name, output: what a plain loop gives.
WANT = {
    ("VolumeWeightedAveragePrice", "value"): walk(vwap),
    ("TimeWeightedAveragePrice", "value"): walk(twap),
    ("BalanceVolume", "value"): walk(obv),
    ("OnBalanceVolume", "value"): BALANCE,
    ("OnBalanceVolumeMean", "value"): window(avg, BALANCE, 14),
    ("PriceVolumeTrend", "value"): walk(pvt),
    ("WilliamsAccumulationDistribution", "value"): walk(wad),
    ("ChaikinMoneyFlow", "value"): cmf(),
    ("MoneyFlowIndex", "value"): mfi(),
    ("ChoppinessIndex", "value"): chop(),
    ("DeMarker", "value"): demarker(),
    ("FiniteVolumeElement", "value"): money(),
    ("IntradayMomentumIndex", "value"): window(lambda w: 100 * over(sum(x for x in w if x > 0), sum(abs(x) for x in w)) if any(w) else 0.0, lift(lambda c, o: c - o, C, O), 14),
    ("VortexIndicator", "viPlus"): vortex(1),
    ("VortexIndicator", "viMinus"): vortex(-1),
    ("UltimateOscillator", "value"): ultimate(),
    ("TrueRange", "value"): walk(true_range),
    ("RelativeStrengthIndex", "value"): rsi(),
    ("VolumeProfileIndicator", "value"): [sum(V[k] for k in range(i + 1) if C[k] is not None and V[k] is not None) or 0.0 for i in range(N)],
    ("MedianPrice", "value"): MIDS,
    ("TypicalPrice", "value"): TYP,
    ("WeightedClosePrice", "value"): lift(lambda h, low, c: (h + low + 2 * c) / 4, H, L, C),
    ("PivotPoints", "r2"): lift(lambda p, h, low: p + h - low, TYP, H, L),
    ("PivotPoints", "s1"): lift(lambda p, h: 2 * p - h, TYP, H),
    ("Momentum", "value"): moves(C, 5),
    ("RateOfChange", "value"): lift(lambda c, b: over(100 * (c - b), b), C, back(C, 12)),
    ("Shift", "value"): [C[i] if i >= 1 else None for i in range(N)],
    ("SimpleMovingAverage", "value"): SMA[14],
    ("ArnaudLegouxMovingAverage", "value"): window(lambda w: sum(v * math.exp(-((8 - k - 0.85 * 8) ** 2) / (2 * 1.5**2)) for k, v in enumerate(w)) / sum(math.exp(-((8 - k - 0.85 * 8) ** 2) / (2 * 1.5**2)) for k in range(9)), C, 9),
    ("AwesomeOscillator", "value"): lift(lambda a, b: a - b, window(avg, MIDS, 5), window(avg, MIDS, 34)),
    ("BollingerBands", "upper"): window(lambda w: avg(w) + 2 * sd(w), C, 20),
    ("BollingerBands", "lower"): window(lambda w: avg(w) - 2 * sd(w), C, 20),
    ("CommodityChannelIndex", "value"): CCI[20],
    ("WoodiesCCI", "signal"): window(avg, CCI[14], 6),
    ("ChandeMomentumOscillator", "value"): window(lambda w: 100 * sum(w) / sum(map(abs, w)) if any(w) else 0.0, moves(), 15),
    ("CenterOfGravityOscillator", "value"): window(lambda w: over(sum((k + 1) * v for k, v in enumerate(w)), sum(w)) - 5.5, C, 10),
    ("DisparityIndex", "value"): lift(lambda c, m: 100 * (c - m) / m, C, SMA[14]),
    ("DonchianChannels", "upper"): HIGH[20],
    ("DonchianChannels", "middle"): lift(lambda a, b: (a + b) / 2, HIGH[20], LOW[20]),
    ("DetrendedSyntheticPrice", "value"): lift(lambda a, b: (a + b) / 2, HIGH[14], LOW[14]),
    ("Envelope", "upper"): lift(lambda m: 1.01 * m, SMA[20]),
    ("ElliotWaveOscillator", "value"): lift(lambda a, b: a - b, SMA[5], SMA[34]),
    ("FastStochastic", "k"): STOCH,
    ("FastStochastic", "d"): window(avg, STOCH, 3),
    ("StochasticOscillator", "d"): window(avg, STOCH, 3),
    ("StochasticK", "value"): STOCH,
    ("ForecastOscillator", "value"): lift(lambda c, f: over(100 * (c - f), c), C, window(lambda w: fit(w)[1] + fit(w)[0] * 6.5, C, 14)),
    ("Highest", "value"): window(max, C, 5),
    ("Lowest", "value"): window(min, C, 5),
    ("Sum", "value"): window(math.fsum, C, 15),
    ("HighLowIndex", "value"): lift(lambda h, a, b: 100 * (h - b) / (a - b) if a != b else 50.0, H, HIGH[14], LOW[14]),
    ("WeightedMovingAverage", "value"): weights(20, lambda k, n: 2 * (k + 1) / (n * (n + 1))),
    ("LinearReg", "value"): window(lambda w: fit(w)[1] + fit(w)[0] * 5, C, 11),
    ("LinearRegressionForecast", "value"): window(lambda w: fit(w)[1] + fit(w)[0] * 7.5, C, 14),
    ("LinearRegSlope", "value"): window(lambda w: fit(w)[0], C, 11),
    ("LinearRegRSquared", "value"): window(lambda w: fit(w)[0] ** 2 * sum((k - 4.5) ** 2 for k in range(10)) / sum((v - avg(w)) ** 2 for v in w), C, 10),
    ("StandardError", "value"): window(lambda w: math.sqrt(sum((v - fit(w)[1] - fit(w)[0] * (k - 4.5)) ** 2 for k, v in enumerate(w)) / 8), C, 10),
    ("StandardDeviation", "value"): window(sd, C, 10),
    ("MovingAverageCrossover", "fast"): SMA[25],
    ("MovingAverageCrossover", "signal"): lift(lambda a, b: float((a > b) - (a < b)), SMA[25], SMA[50]),
    ("MeanDeviation", "value"): window(lambda w: avg([abs(v - avg(w)) for v in w]), C, 5),
    ("Median", "value"): window(lambda w: sorted(w)[2], C, 5),
    ("MomentumPinball", "value"): window(lambda w: 100 * (w[-1] - w[0]) / (max(w) - min(w)) if max(w) != min(w) else 0.0, C, 14),
    ("OscillatorOfMovingAverage", "value"): lift(lambda a, b: 100 * (a - b) / b, SMA[10], SMA[30]),
    ("PriceChannels", "lower"): LOW[20],
    ("QStick", "value"): window(avg, lift(lambda o, c: o - c, O, C), 15),
    ("RangeActionVerificationIndex", "value"): lift(lambda a, b: abs(100 * (a - b) / b), SMA[7], SMA[65]),
    ("RankCorrelationIndex", "value"): window(rank_correlation, C, 14),
    ("VerticalHorizontalFilter", "value"): lift(over, window(lambda w: max(w) - min(w), C, 15), window(lambda w: sum(map(abs, w)), moves(), 15)),
    ("VolumeWeightedMovingAverage", "value"): lift(over, window(sum, lift(lambda c, v: c * v, C, V), 32), window(sum, V, 32)),
    ("WilliamsR", "value"): lift(lambda c, a, b: -100 * (a - c) / (a - b) if a != b else -100.0, C, HIGH[14], LOW[14]),
    ("HistoricalVolatilityRatio", "value"): lift(lambda a, b: over(a, b) or 0.0, window(sd, C, 5), window(sd, C, 20)),
}
#: Strict averages give nothing after a first gap, so these are compared over a series without one.
WHOLE = {
    ("ExponentialMovingAverage", "value"): lambda c: fixed_rate(c, 14, 2 / 15),
    ("SmoothedMovingAverage", "value"): lambda c: fixed_rate(c, 32, 1 / 32),
    ("WilderMovingAverage", "value"): lambda c: fixed_rate(c, 32, 1 / 32),
    ("GuppyMultipleMovingAverage", "ema60"): lambda c: fixed_rate(c, 60, 2 / 61),
    ("McClellanOscillator", "value"): lambda c: lift(lambda a, b: a - b, fixed_rate(c, 19, 0.1), fixed_rate(c, 39, 0.05)),
    ("DoubleExponentialMovingAverage", "value"): lambda c: lift(lambda a, b: 2 * a - b, fixed_rate(c, 32, 2 / 33), [None] * 31 + fixed_rate(fixed_rate(c, 32, 2 / 33)[31:], 32, 2 / 33)),
}


@pytest.fixture(scope="module")
def tables(spark):
    def table(bars):
        return spark.createDataFrame([("s", 60 * i, *(b[k] for k in ("open", "high", "low", "close", "volume"))) for i, b in enumerate(bars)], "symbol string, time long, open double, high double, low double, close double, volume double").cache()

    whole = [{**b, "close": b["close"] if b["close"] is not None else 100.0} for b in BARS]
    return table(BARS), table(whole), [b["close"] for b in whole]


def close_to(got, want):
    return (got is None) == (want is None) and (got is None or abs(float(got) - want) <= 1e-6 * max(1.0, abs(want)))


@pytest.mark.parametrize("name", sorted({n for n, _ in WANT} | {n for n, _ in WHOLE}))
def test_indicator_equals_plain_loop(tables, name):
    gaps, whole, closes = tables
    for (of, output), want in [*WANT.items(), *WHOLE.items()]:
        if of == name:
            want = want(closes) if callable(want) else want
            got = [r[output] for r in indicator(whole if (of, output) in WHOLE else gaps, name).orderBy("time").collect()]
            assert [i for i in range(N) if not close_to(got[i], want[i])] == []


def test_buckets_of_the_volume_profile(tables):
    last = indicator(tables[0], "vp").orderBy("time").collect()[-1]["buckets"]
    want = {}
    for c, v in zip(C, V, strict=True):
        if c is not None and v is not None:
            want[float(math.trunc(c))] = want.get(float(math.trunc(c)), 0.0) + v
    assert [(b["price"], b["volume"]) for b in last] == sorted(want.items())
