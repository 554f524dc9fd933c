"""The indicator catalogue.

An indicator is a short plan over bars (symbol, time, open, high, low, close, volume): steps of window
expressions, and folds where a value depends on the one before without end. Steps are SQL text that Spark
runs as DataFrame expressions; `dialects` holds the few that other engines spell differently.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from tickloom.operators import machines as M
from tickloom.operators.folds import Average, Fold, Linear, Machine
from tickloom.operators.windows import RUNNING, deviation, frame, highest, lag, lowest, mean, partial_mean, prior, ratio, rise, running, slope, total, weighted

Step = dict[str, "str | tuple[str, str]"] | list[Fold]


@dataclass(frozen=True)
class Plan:
    """Steps in order; outputs by name. Text pairs are (Spark, DuckDB)."""

    steps: list[Step]
    outputs: dict[str, str]


@dataclass(frozen=True)
class Indicator:
    name: str
    names: tuple[str, ...]
    params: dict[str, float]
    build: Callable[..., Plan]
    kinds: dict[str, str] = field(default_factory=dict)

    def plan(self, **params: float) -> Plan:
        unknown = set(params) - set(self.params)
        if unknown:
            raise ValueError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        # parameters that are no finite number fall back; lengths are cut toward zero
        use = {k: v if k not in params or not math.isfinite(params[k]) else type(v)(params[k]) for k, v in self.params.items()} | {k: type(self.params[k])(v) for k, v in params.items() if math.isfinite(v)}
        return self.build(**use)


REGISTRY: dict[str, Indicator] = {}


def indicator(name: str, *names: str, **params: float) -> Callable:
    def put(build: Callable[..., Plan]) -> Callable[..., Plan]:
        known = {x for item in REGISTRY.values() for x in item.names}
        for x in (name.lower(), *names):
            if not x or x != x.strip() or x != x.lower():
                raise ValueError(f"{x!r} is no name of an indicator: names are lower-case and not empty")
            if x in known:
                raise ValueError(f"there is an indicator named {x}")
        if any(isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) for v in params.values()):
            raise ValueError(f"parameters of {name} have finite numbers as defaults")
        REGISTRY[name] = Indicator(name, (name.lower(), *names), params, build)
        return build

    return put


def find(name: str) -> Indicator:
    """By name or alias, in any case."""
    for item in REGISTRY.values():
        if name.lower() in item.names:
            return item
    raise KeyError(f"unknown indicator {name}")


def one(text: str, *before: Step) -> Plan:
    return Plan([*before, {"value": text}], {"value": "value"})


def wide(outputs: dict[str, str], *before: Step) -> Plan:
    return Plan([*before, dict(outputs)], {k: k for k in outputs})


MID, TYPICAL = "((high + low) / 2)", "((high + low + close) / 3)"
TRUE_RANGE = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
#: True range whose first value is the first bar's own range; null where the close before is missing.
FULL_RANGE = f"CASE WHEN i = 0 THEN high - low WHEN {lag('close')} IS NOT NULL THEN {TRUE_RANGE} END"
CHANGE = f"close - {lag('close')}"
#: Rows that have the flag `ok` alike: windows by it pass over gaps.
DENSE = "symbol, ok"
#: Whether a bar has its prices.
PRICED = "high + low + close IS NOT NULL"


def _range_over_gaps(out: str) -> list[Step]:
    """True range against the last close there was, the bar's own range before the first."""
    gap = "greatest(high - low, abs(high - {0}), abs(low - {0}))"
    return [{f"{out}_c": "CASE WHEN high - low IS NOT NULL THEN close END"}, {f"{out}_p": prior(f"{out}_c")}, {out: f"CASE WHEN {out}_p IS NULL THEN high - low WHEN high - low IS NOT NULL THEN {gap.format(out + '_p')} END"}]


# bars alone


@indicator("BalanceOfPower")
def _() -> Plan:
    return one("CASE WHEN high <> low THEN greatest(-1.0, least(1.0, (close - open) / nullif(high - low, 0))) END")


@indicator("LunarPhase")
def _() -> Plan:
    turns = "((time / 86400.0 + 2440587.5 - 2451549.5) / 29.53)"
    return one(f"floor(({turns} - floor({turns})) * 8)")


@indicator("MedianPrice")
def _() -> Plan:
    return one(MID)


@indicator("TypicalPrice", "tp")
def _() -> Plan:
    return one(TYPICAL)


@indicator("WeightedClosePrice", "wcp")
def _() -> Plan:
    return one("(high + low + 2 * close) / 4")


@indicator("MarketFacilitationIndex")
def _() -> Plan:
    return one(ratio("high - low", "volume"))


@indicator("PassThroughIndicator", "passthrough")
def _() -> Plan:
    return one("close")


@indicator("PivotPoints")
def _() -> Plan:
    return wide({"pp": "p", "r1": "2 * p - low", "r2": "p + high - low", "s1": "2 * p - high", "s2": "p - (high - low)"}, {"p": TYPICAL})


@indicator("Shift", length=1)
def _(length: int) -> Plan:
    return one(f"CASE WHEN i >= {length} THEN close END")


@indicator("SineWave", length=14)
def _(length: int) -> Plan:
    return wide({"sine": f"sin({2 * math.pi / length!r} * i)", "leadsine": f"sin({2 * math.pi / length!r} * (i + 0.5))"})


@indicator("VolumeIndicator", "volume")
def _() -> Plan:
    return wide({"value": "volume", "up": "close >= open"})


# a bar and an earlier one


@indicator("Momentum", length=5)
def _(length: int) -> Plan:
    return one(f"close - {lag('close', length)}")


@indicator("RateOfChange", "roc", length=12)
def _(length: int) -> Plan:
    return one(ratio(f"100 * (close - {lag('close', length)})", lag("close", length)))


@indicator("TrueRange", "tr")
def _() -> Plan:
    return one("CASE WHEN p IS NOT NULL AND high - low IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END", {"c": "CASE WHEN high - low IS NOT NULL THEN close END"}, {"p": prior("c")})


# bounded windows


@indicator("SimpleMovingAverage", "sma", length=14)
def _(length: int) -> Plan:
    return one(mean("close", length))


@indicator("ArnaudLegouxMovingAverage", "alma", length=9, offset=0.85, sigma=6.0)
def _(length: int, offset: float, sigma: float) -> Plan:
    m, s = offset * (length - 1), length / sigma
    w = [math.exp(-(((k - m) / s) ** 2) / 2) for k in range(length)]
    return one(weighted("close", [x / sum(w) for x in w]))


@indicator("AwesomeOscillator", "ao", shortLength=5, longLength=34)
def _(shortLength: int, longLength: int) -> Plan:
    return Plan(
        [{"mid": MID}, {"value": f"{mean('mid', shortLength)} - {mean('mid', longLength)}"}, {"up": f"CASE WHEN value IS NOT NULL THEN coalesce(value >= {lag('value')}, true) END"}],
        {"value": "value", "up": "up"},
    )


@indicator("Acceleration", "ac", shortLength=5, longLength=34, smaLength=5)
def _(shortLength: int, longLength: int, smaLength: int) -> Plan:
    return one(f"ao - {mean('ao', smaLength)}", {"mid": MID}, {"ao": f"{mean('mid', shortLength)} - {mean('mid', longLength)}"})


@indicator("BollingerBands", "bb", length=20, stdDev=2.0)
def _(length: int, stdDev: float) -> Plan:
    return wide({"upper": f"m + {stdDev} * s", "middle": "m", "lower": f"m - {stdDev} * s"}, {"m": mean("close", length), "s": deviation("close", length)})


@indicator("BollingerPercentB", "bbpercentb", length=20, stdDevMultiplier=2.0)
def _(length: int, stdDevMultiplier: float) -> Plan:
    return one(f"CASE WHEN s > 1e-12 * abs(m) THEN 100 * (close - (m - {stdDevMultiplier} * s)) / nullif({2 * stdDevMultiplier} * s, 0) END", {"m": mean("close", length), "s": deviation("close", length)})


@indicator("BalanceOfMarketPower", "bomp", length=14)
def _(length: int) -> Plan:
    return one(mean("p", length), {"p": "CASE WHEN coalesce(volume, 0) = 0 THEN 0.0 ELSE (close - open) / CASE WHEN high = low THEN 0.01 ELSE high - low END END"})


def _cci(length: int) -> list[Step]:
    spread = "(" + " + ".join(f"abs({lag('tp', k)} - m)" for k in range(length)) + f") / {length}"
    return [{"tp": TYPICAL}, {"m": mean("tp", length)}, {"d": spread}, {"cci": "CASE WHEN d = 0 THEN 0.0 ELSE (tp - m) / nullif(0.015 * d, 0) END"}]


@indicator("CommodityChannelIndex", "cci", length=20)
def _(length: int) -> Plan:
    return Plan(_cci(length), {"value": "cci"})


@indicator("WoodiesCCI", "wcci", length=14, smaLength=6)
def _(length: int, smaLength: int) -> Plan:
    return Plan([*_cci(length), {"signal": mean("cci", smaLength)}], {"cci": "cci", "signal": "signal"})


@indicator("ChandeKrollStop", period=10, multiplier=1.5, stopPeriod=9)
def _(period: int, multiplier: float, stopPeriod: int) -> Plan:
    return wide(
        {"longStop": partial_mean("a", stopPeriod, DENSE), "shortStop": partial_mean("b", stopPeriod, DENSE)},
        {"hh": highest("high", period), "ll": lowest("low", period)},
        {"a": f"hh - (hh - ll) * {multiplier}", "b": f"ll + (hh - ll) * {multiplier}"},
        {"ok": "a IS NOT NULL"},
    )


@indicator("ChoppinessIndex", "chop", length=14)
def _(length: int) -> Plan:
    # bars without prices are left out, not gaps in the window
    part, prev = "symbol, ok", f"coalesce({lag('close', 1, 'symbol, ok')}, 0)"
    return one(
        f"CASE WHEN ok AND a > 0 AND b > 0 AND {length} > 1 THEN 100 * log10(a / nullif(b, 0)) / {math.log10(length) or 1!r} END",
        {"ok": PRICED},
        {"t": f"CASE WHEN ok THEN greatest(high - low, abs(high - {prev}), abs(low - {prev})) END", "r": "CASE WHEN ok THEN high - low END"},
        {"a": total("t", length, part), "b": total("r", length, part)},
    )


@indicator("ChaikinMoneyFlow", "cmf", length=20)
def _(length: int) -> Plan:
    # as bars leave the window their money flow, not their volume, is taken off the volume sum
    return one(
        "CASE WHEN a IS NOT NULL THEN coalesce(a / nullif(b - c, 0), 0.0) END",
        {"f": f"CASE WHEN {PRICED} AND volume IS NOT NULL THEN coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0.0) END"},
        {"a": total("f", length), "v": "CASE WHEN f IS NOT NULL THEN volume END", "g": f"coalesce({lag('f', length)}, 0.0)"},
        {"b": running("v"), "c": running("g")},
    )


@indicator("ChandeMomentumOscillator", "cmo", length=15)
def _(length: int) -> Plan:
    return one("coalesce(100 * (u - d) / nullif(u + d, 0), CASE WHEN u IS NOT NULL THEN 0.0 END)", {"x": CHANGE}, {"a": "CASE WHEN x > 0 THEN x WHEN x <= 0 THEN 0.0 END", "b": "CASE WHEN x < 0 THEN -x WHEN x >= 0 THEN 0.0 END"}, {"u": total("a", length), "d": total("b", length)})


@indicator("CenterOfGravityOscillator", "cog", "cgo", length=10)
def _(length: int) -> Plan:
    return one(f"{ratio(weighted('close', [float(length - k) for k in range(length)]), total('close', length))} - {(length + 1) / 2}")


@indicator("DeMarker", length=14)
def _(length: int) -> Plan:
    # bars without prices are left out, not gaps in the window
    part = "symbol, ok"
    return one(
        "CASE WHEN ok THEN coalesce(u / nullif(u + d, 0), CASE WHEN u IS NOT NULL THEN 0.5 END) END",
        {"ok": "high - low IS NOT NULL"},
        {"x": f"high - {lag('high', 1, part)}", "y": f"{lag('low', 1, part)} - low"},
        {"a": rise("x"), "b": rise("y")},
        {"u": mean("a", length, part), "d": mean("b", length, part)},
    )


@indicator("DisparityIndex", length=14)
def _(length: int) -> Plan:
    return one(ratio("100 * (close - m)", "m"), {"m": mean("close", length)})


@indicator("DonchianChannels", "donchian", length=20)
def _(length: int) -> Plan:
    return wide({"upper": "a", "lower": "b", "middle": "(a + b) / 2"}, {"a": highest("high", length), "b": lowest("low", length)})


@indicator("DetrendedPriceOscillator", "dpo", length=3)
def _(length: int) -> Plan:
    return one(f"CASE WHEN i >= {2 * length - 2} THEN close - {lag('m', length // 2 + 1)} END", {"m": mean("close", length)})


@indicator("DetrendedSyntheticPrice", "dsp", length=14)
def _(length: int) -> Plan:
    return one(f"(({highest('high', length)}) + ({lowest('low', length)})) / 2")


@indicator("EndpointMovingAverage", "endpointma", length=10)
def _(length: int) -> Plan:
    first = lag("close", length - 1)
    return one(f"{first} + (close - {first}) / {max(1, length - 1)} * {length - 1}")


@indicator("Envelope", length=20, percent=1.0)
def _(length: int, percent: float) -> Plan:
    return wide({"upper": f"m * {1 + percent / 100!r}", "middle": "m", "lower": f"m * {1 - percent / 100!r}"}, {"m": mean("close", length)})


@indicator("ElliotWaveOscillator", "ewo", shortPeriod=5, longPeriod=34)
def _(shortPeriod: int, longPeriod: int) -> Plan:
    return one(f"{mean('close', shortPeriod)} - {mean('close', longPeriod)}")


def _stochastic(n: int) -> list[Step]:
    return [{"hh": highest("high", n), "ll": lowest("low", n)}, {"k": "coalesce(100 * (close - ll) / nullif(hh - ll, 0), CASE WHEN hh IS NOT NULL THEN 0.0 END)"}]


@indicator("FastStochastic", kPeriod=14, dPeriod=3)
def _(kPeriod: int, dPeriod: int) -> Plan:
    return Plan([*_stochastic(kPeriod), {"d": mean("k", dPeriod)}], {"k": "k", "d": "d"})


@indicator("StochasticOscillator", "stochastic", kPeriod=14, dPeriod=3, smooth=1)
def _(kPeriod: int, dPeriod: int, smooth: int) -> Plan:
    return Plan([*_stochastic(kPeriod), {"s": mean("k", smooth) if smooth > 1 else "k"}, {"d": mean("s", dPeriod)}], {"k": "s", "d": "d"})


@indicator("StochasticK", length=14)
def _(length: int) -> Plan:
    return Plan(_stochastic(length), {"value": "k"})


@indicator("FibonacciRetracement", "fibo", length=20)
def _(length: int) -> Plan:
    return wide({f"l{x}": f"ll + (hh - ll) * 0.{x}" for x in ("236", "382", "5", "618", "786")}, {"hh": f"max(high) OVER {frame(length)}", "ll": f"min(low) OVER {frame(length)}"})


@indicator("ForecastOscillator", length=14)
def _(length: int) -> Plan:
    return one(ratio(f"100 * (close - (m + b * {(length - 1) / 2}))", "close"), {"m": mean("close", length), "b": slope("close", length)})


@indicator("FractalDimension", length=30)
def _(length: int) -> Plan:
    return one(
        f"CASE WHEN p IS NULL OR a IS NULL THEN NULL WHEN p = 0 OR a = b THEN 1.5 ELSE greatest(1.0, least(2.0, 1 + (ln(p) - ln(nullif(a - b, 0))) / {math.log(2 * (length - 1))!r})) END",
        {"x": f"abs({CHANGE})"},
        {"p": total("x", length - 1), "a": highest("close", length), "b": lowest("close", length)},
    )


@indicator("FiniteVolumeElement", "fve", length=22)
def _(length: int) -> Plan:
    return one(f"100 * {mean('x', length)}", {"x": f"CASE WHEN NOT ({PRICED}) OR high = low OR coalesce(volume, 0) = 0 THEN 0.0 ELSE 2 * (close - low) / nullif(high - low, 0) - 1 END"})


@indicator("GopalakrishnanRangeIndex", "gri", length=14)
def _(length: int) -> Plan:
    return one(f"CASE WHEN a IS NULL THEN NULL WHEN high - low <= 0 THEN 0.0 ELSE ln((a - b) / nullif(high - low, 0)) / {math.log(length)!r} END", {"a": highest("high", length), "b": lowest("low", length)})


@indicator("HarmonicOscillator", "harmonic", length=14)
def _(length: int) -> Plan:
    return one(weighted("close", [math.sin(2 * math.pi * k / length) / length for k in range(length)]))


@indicator("Highest", length=5)
def _(length: int) -> Plan:
    return one(highest("close", length))


@indicator("Lowest", length=5)
def _(length: int) -> Plan:
    return one(lowest("close", length))


@indicator("Sum", length=15)
def _(length: int) -> Plan:
    return one(total("close", length))


@indicator("HighLowIndex", length=14)
def _(length: int) -> Plan:
    return one("coalesce(100 * (high - b) / nullif(a - b, 0), CASE WHEN a IS NOT NULL THEN 50.0 END)", {"a": highest("high", length), "b": lowest("low", length)})


def _linear_weights(n: int) -> list[float]:
    return [2 * (n - k) / (n * (n + 1)) for k in range(n)]


@indicator("WeightedMovingAverage", "wma", length=20)
def _(length: int) -> Plan:
    return one(weighted("close", _linear_weights(length)))


@indicator("HullMovingAverage", "hma", length=10, sqrtPeriod=0)
def _(length: int, sqrtPeriod: int) -> Plan:
    root = sqrtPeriod or max(1, int(math.sqrt(length)))
    return one(weighted("x", _linear_weights(root)), {"x": f"2 * {weighted('close', _linear_weights(max(1, length // 2)))} - {weighted('close', _linear_weights(length))}"})


@indicator("HurstExponent", "hurst", length=100)
def _(length: int) -> Plan:
    spark = "aggregate(xs, named_struct('c', 0D, 'a', double('-Infinity'), 'b', double('Infinity')), (s, x) -> named_struct('c', s.c + x - m, 'a', greatest(s.a, s.c + x - m), 'b', least(s.b, s.c + x - m)), s -> s.a - s.b)"
    duck = f"list_max(list_transform(range(1, {length + 1}), lambda k: list_sum(xs[1:k]) - k * m)) - list_min(list_transform(range(1, {length + 1}), lambda k: list_sum(xs[1:k]) - k * m))"
    return one(
        f"CASE WHEN d > 1e-12 * abs(m) AND r > 0 THEN ln(r / nullif(d, 0)) / {math.log(length)!r} END",
        {"m": mean("close", length), "d": deviation("close", length), "xs": (f"collect_list(close) OVER {frame(length)}", f"list(close) OVER {frame(length)}")},
        {"r": (f"CASE WHEN m IS NOT NULL THEN {spark} END", f"CASE WHEN m IS NOT NULL THEN {duck} END")},
    )


@indicator("HistoricalVolatilityRatio", "hvr", shortPeriod=5, longPeriod=20)
def _(shortPeriod: int, longPeriod: int) -> Plan:
    return one("CASE WHEN b IS NULL THEN NULL WHEN b = 0 THEN 0.0 ELSE a / nullif(b, 0) END", {"a": deviation("close", shortPeriod), "b": deviation("close", longPeriod)})


@indicator("Ichimoku", tenkan=9, kijun=26, senkouB=52)
def _(tenkan: int, kijun: int, senkouB: int) -> Plan:
    def ahead(x: str, first: int) -> str:
        # the first value comes a bar early and is repeated
        return f"CASE WHEN i = {first + kijun - 1} THEN {lag(x, kijun - 1)} WHEN i >= {first + kijun} THEN {lag(x, kijun)} END"

    middle = lambda n: f"(({highest('high', n)}) + ({lowest('low', n)})) / 2"
    return Plan(
        [
            {"t": middle(tenkan), "j": middle(kijun), "b": middle(senkouB)},
            {"a": "(t + j) / 2"},
            {"tenkan": "t", "kijun": "j", "senkouA": ahead("a", max(tenkan, kijun) - 1), "senkouB": ahead("b", senkouB - 1), "chikou": f"CASE WHEN i >= {kijun - 1} THEN close END"},
        ],
        {x: x for x in ("tenkan", "kijun", "senkouA", "senkouB", "chikou")},
    )


@indicator("IntradayIntensityIndex", "iii", length=14)
def _(length: int) -> Plan:
    return one(mean("x", length), {"x": "CASE WHEN (high - low) * volume <> 0 THEN 2 * ((close - low) - (high - close)) / nullif((high - low) * volume, 0) ELSE 0.0 END"})


@indicator("IntradayMomentumIndex", "imi", length=14)
def _(length: int) -> Plan:
    return one("coalesce(100 * u / nullif(u + d, 0), CASE WHEN u IS NOT NULL THEN 0.0 END)", {"x": "close - open", "y": "open - close"}, {"a": rise("x"), "b": rise("y")}, {"u": total("a", length), "d": total("b", length)})


@indicator("KaufmanEfficiencyRatio", "ker", length=10)
def _(length: int) -> Plan:
    return one(f"coalesce(abs(close - {lag('close', length - 1)}) / nullif(v, 0), CASE WHEN v IS NOT NULL THEN 0.0 END)", {"x": f"abs({CHANGE})"}, {"v": total("x", length - 1)})


@indicator("KnowSureThing", "kst", roc1Length=10, roc2Length=15, roc3Length=20, roc4Length=30, sma1Length=10, sma2Length=10, sma3Length=10, sma4Length=15, signalLength=9)
def _(roc1Length, roc2Length, roc3Length, roc4Length, sma1Length, sma2Length, sma3Length, sma4Length, signalLength) -> Plan:
    rocs = (roc1Length, roc2Length, roc3Length, roc4Length)
    smas = (sma1Length, sma2Length, sma3Length, sma4Length)
    return Plan(
        [
            {f"r{k}": ratio(f"100 * (close - {lag('close', n)})", lag("close", n)) for k, n in enumerate(rocs)},
            {f"m{k}": mean(f"r{k}", n) for k, n in enumerate(smas)},
            {"kst": "m0 + 2 * m1 + 3 * m2 + 4 * m3"},
            {"ok": "kst IS NOT NULL"},
            {"signal": mean("kst", signalLength, DENSE)},
        ],
        {"kst": "kst", "signal": "signal"},
    )


@indicator("LinearReg", "linreg", length=11)
def _(length: int) -> Plan:
    return one(f"m + b * {(length - 1) / 2}", {"m": mean("close", length), "b": slope("close", length)})


@indicator("LinearRegressionForecast", "linregforecast", length=14)
def _(length: int) -> Plan:
    return one(f"m + b * {length - (length - 1) / 2}", {"m": mean("close", length), "b": slope("close", length)})


@indicator("LinearRegSlope", "linregslope", length=11)
def _(length: int) -> Plan:
    return one(slope("close", length))


def _residual(n: int) -> str:
    """Sum of squared residuals about the fitted line."""
    return "(" + " + ".join(f"power({lag('close', k)} - (m + b * {(n - 1) / 2 - k}), 2)" for k in range(n)) + ")"


@indicator("LinearRegRSquared", "rsquared", "linregrsquared", length=10)
def _(length: int) -> Plan:
    return one("CASE WHEN t IS NULL THEN NULL WHEN t <= 1e-24 * m * m THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - e / nullif(t, 0))) END", {"m": mean("close", length), "b": slope("close", length)}, {"t": "(" + " + ".join(f"power({lag('close', k)} - m, 2)" for k in range(length)) + ")", "e": _residual(length)})


@indicator("StandardError", "stderr", length=10)
def _(length: int) -> Plan:
    return one(f"sqrt({_residual(length)} / {length - 2})" if length > 2 else f"CASE WHEN i >= {length - 1} THEN 0.0 END", {"m": mean("close", length), "b": slope("close", length)})


@indicator("StandardDeviation", "stddev", length=10)
def _(length: int) -> Plan:
    return one(deviation("close", length))


@indicator("MovingAverageCrossover", "macross", shortPeriod=25, longPeriod=50)
def _(shortPeriod: int, longPeriod: int) -> Plan:
    return wide({"fast": "a", "slow": "b", "signal": "CASE WHEN a > b THEN 1 WHEN a < b THEN -1 WHEN a = b THEN 0 END"}, {"a": mean("close", shortPeriod), "b": mean("close", longPeriod)})


@indicator("MovingAverageRibbon", "maribbon", shortPeriod=10, longPeriod=100, ribbonCount=10)
def _(shortPeriod: int, longPeriod: int, ribbonCount: int) -> Plan:
    step = (longPeriod - shortPeriod) // max(1, ribbonCount - 1)
    names = [f"sma{k + 1}" for k in range(ribbonCount)]
    return Plan([{name: mean(names[k - 1] if k else "close", shortPeriod + k * step)} for k, name in enumerate(names)], {x: x for x in names})


@indicator("MeanDeviation", length=5)
def _(length: int) -> Plan:
    return one("(" + " + ".join(f"abs({lag('close', k)} - m)" for k in range(length)) + f") / {length}", {"m": mean("close", length)})


@indicator("Median", length=5)
def _(length: int) -> Plan:
    return Plan([{"value": (f"CASE WHEN count(close) OVER {frame(length)} = {length} THEN percentile(close, 0.5) OVER {frame(length)} END", f"CASE WHEN count(close) OVER {frame(length)} = {length} THEN quantile_cont(close, 0.5) OVER {frame(length)} END")}], {"value": "value"})


@indicator("MoneyFlowIndex", "mfi", length=14)
def _(length: int) -> Plan:
    return one(
        f"CASE WHEN i < {length - 1} OR tp IS NULL THEN NULL WHEN n = 0 THEN 100.0 ELSE 100 * p / nullif(p + n, 0) END",
        {"tp": f"CASE WHEN volume IS NOT NULL THEN {TYPICAL} END"},
        {"before": prior("tp")},
        {"a": "CASE WHEN tp > coalesce(before, 0) THEN tp * volume ELSE 0.0 END", "b": "CASE WHEN tp < coalesce(before, 0) THEN tp * volume ELSE 0.0 END"},
        {"p": f"sum(a) OVER {frame(length)}", "n": f"sum(b) OVER {frame(length)}"},
    )


@indicator("MomentumPinball", length=14)
def _(length: int) -> Plan:
    return one(f"coalesce(100 * (close - {lag('close', length - 1)}) / nullif(a - b, 0), CASE WHEN a IS NOT NULL THEN 0.0 END)", {"a": highest("close", length), "b": lowest("close", length)})


@indicator("OscillatorOfMovingAverage", "osma", shortPeriod=10, longPeriod=30)
def _(shortPeriod: int, longPeriod: int) -> Plan:
    return one("coalesce(100 * (a - b) / nullif(b, 0), CASE WHEN b IS NOT NULL THEN 0.0 END)", {"a": mean("close", shortPeriod), "b": mean("close", longPeriod)})


@indicator("PrettyGoodOscillator", "pgo", length=14)
def _(length: int) -> Plan:
    return one(ratio("100 * (close - m)", "a - b"), {"m": mean("close", length), "a": highest("high", length), "b": lowest("low", length)})


@indicator("PriceChannels", "pc", length=20)
def _(length: int) -> Plan:
    return wide({"upper": highest("high", length), "lower": lowest("low", length)})


@indicator("QStick", length=15)
def _(length: int) -> Plan:
    return one(mean("x", length), {"x": "open - close"})


@indicator("RainbowCharts", "rainbow", lines=10)
def _(lines: int) -> Plan:
    return wide({f"sma{k}": mean("close", 2 * k) for k in range(1, lines)})


@indicator("RangeActionVerificationIndex", "ravi", shortLength=7, longLength=65)
def _(shortLength: int, longLength: int) -> Plan:
    return one(f"abs({ratio('100 * (a - b)', 'b')})", {"a": mean("close", shortLength), "b": mean("close", longLength)})


@indicator("RankCorrelationIndex", "rci", length=14)
def _(length: int) -> Plan:
    n = length
    mid = (n + 1) / 2
    spark = "transform(xs, x -> size(filter(xs, y -> y < x)) + (size(filter(xs, y -> y = x)) + 1) / 2.0D)"
    duck = "list_transform(xs, lambda x: len(list_filter(xs, lambda y: y < x)) + (len(list_filter(xs, lambda y: y = x)) + 1) / 2.0)"
    top = " + ".join(f"{k + 1 - mid} * (r[{{{k}}}] - {mid})" for k in range(n))
    low = " + ".join(f"power(r[{{{k}}}] - {mid}, 2)" for k in range(n))
    at = lambda text, base: text.format(*(k + base for k in range(n)))
    value = lambda base: f"CASE WHEN r IS NOT NULL THEN ({at(top, base)}) / nullif(sqrt(({at(low, base)}) * {n * (n * n - 1) / 12}), 0) END"
    return Plan(
        [
            {"xs": (f"collect_list(close) OVER {frame(n)}", f"list(close) OVER {frame(n)}")},
            {"r": (f"CASE WHEN size(xs) = {n} THEN {spark} END", f"CASE WHEN len(xs) = {n} THEN {duck} END")},
            {"value": (value(0), value(1))},
        ],
        {"value": "value"},
    )


@indicator("RelativeMomentumIndex", "rmi", length=14, momentum=3)
def _(length: int, momentum: int) -> Plan:
    return one(ratio("100 * u", "u + d"), {"x": f"close - {lag('close', momentum)}"}, {"a": "CASE WHEN x > 0 THEN x WHEN x <= 0 THEN 0.0 END", "b": "CASE WHEN x < 0 THEN -x WHEN x >= 0 THEN 0.0 END"}, {"u": mean("a", length), "d": mean("b", length)})


@indicator("RelativeVigorIndex", "rvi", length=4, signalLength=4)
def _(length: int, signalLength: int) -> Plan:
    four = [1 / 6, 2 / 6, 2 / 6, 1 / 6]
    return Plan(
        [
            {"a": "close - open", "b": "high - low"},
            {"u": weighted("a", four), "d": weighted("b", four)},
            {"rvi": f"CASE WHEN i < {length - 1} THEN NULL WHEN d = 0 THEN u ELSE u / nullif(d, 0) END"},
            {"signal": f"CASE WHEN i >= {length + signalLength - 2} THEN {weighted('rvi', four)} END"},
        ],
        {"rvi": "rvi", "signal": "signal"},
    )


@indicator("UltimateOscillator", "uo")
def _() -> Plan:
    return one(
        f"100 * (4 * {ratio('b7', 't7')} + 2 * {ratio('b14', 't14')} + {ratio('b28', 't28')}) / 7",
        {"c": f"CASE WHEN {PRICED} THEN close END"},
        {"p": prior("c")},
        {"b": "CASE WHEN c + p IS NOT NULL THEN close - least(low, p) END", "t": "CASE WHEN c + p IS NOT NULL THEN greatest(high, p) - least(low, p) END"},
        {f"{x}{n}": total(x, n) for n in (7, 14, 28) for x in "bt"},
    )


@indicator("VerticalHorizontalFilter", "vhf", length=15)
def _(length: int) -> Plan:
    return one(ratio("a - b", "s"), {"x": f"abs({CHANGE})"}, {"a": highest("close", length), "b": lowest("close", length), "s": total("x", length)})


@indicator("VortexIndicator", "vi", "vortex", length=14)
def _(length: int) -> Plan:
    whole = f"high + low + {lag('high')} + {lag('low')} + {lag('close')} IS NOT NULL"
    return wide(
        {"viPlus": "coalesce(p / nullif(t, 0), CASE WHEN t IS NOT NULL THEN 0.0 END)", "viMinus": "coalesce(m / nullif(t, 0), CASE WHEN t IS NOT NULL THEN 0.0 END)"},
        {"x": f"CASE WHEN {whole} THEN {TRUE_RANGE} END", "y": f"CASE WHEN {whole} THEN abs(high - {lag('low')}) END", "z": f"CASE WHEN {whole} THEN abs(low - {lag('high')}) END"},
        {"t": total("x", length), "p": total("y", length), "m": total("z", length)},
    )


@indicator("VolumeWeightedMovingAverage", "vwma", length=32)
def _(length: int) -> Plan:
    return one(ratio(total("x", length), total("volume", length)), {"x": "close * volume"})


@indicator("WilliamsR", length=14)
def _(length: int) -> Plan:
    return one("coalesce(-100 * (a - close) / nullif(a - b, 0), CASE WHEN a IS NOT NULL THEN -100.0 END)", {"a": highest("high", length), "b": lowest("low", length)})


# running totals


@indicator("AccumulationDistributionLine", "adl")
def _() -> Plan:
    return one(running("x"), {"x": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0.0)"})


def _signed(first: str) -> list[Step]:
    """Volume with the sign of the change since the last bar that has a close and, but for the first, a volume.

    `first` is what the bar gives that has none before it. Bars without give null and are passed over.
    """
    return [{"c": "CASE WHEN volume IS NOT NULL OR " + f"count(close) OVER {RUNNING} = 1 THEN close END"}, {"p": prior("c")}, {"x": f"CASE WHEN close + volume IS NULL THEN NULL WHEN p IS NULL THEN {first} WHEN c > p THEN volume WHEN c < p THEN -volume ELSE 0.0 END"}]


#: The same where a close of zero counts as none.
_BALANCE: list[Step] = [
    {"c": "CASE WHEN volume IS NOT NULL THEN close END"},
    {"p": prior("c")},
    {"x": "CASE WHEN c IS NULL THEN NULL WHEN coalesce(p, 0) = 0 OR c = p THEN 0.0 WHEN c > p THEN volume ELSE -volume END"},
    {"y": f"CASE WHEN x IS NOT NULL THEN {running('x')} END"},
]


@indicator("BalanceVolume", "obv")
def _() -> Plan:
    return one(f"CASE WHEN x IS NOT NULL THEN {running('x')} END", *_signed("NULL"))


@indicator("OnBalanceVolume")
def _() -> Plan:
    return Plan(_BALANCE, {"value": "y"})


@indicator("OnBalanceVolumeMean", "obvmean", length=14)
def _(length: int) -> Plan:
    return one(mean("y", length), *_BALANCE)


@indicator("PriceVolumeTrend", "pvt")
def _() -> Plan:
    return one(f"CASE WHEN x IS NOT NULL THEN {running('x')} END", {"c": "CASE WHEN volume IS NOT NULL THEN close END"}, {"p": prior("c")}, {"x": "volume * (c - p) / nullif(p, 0)"})


@indicator("TimeWeightedAveragePrice", "twap")
def _() -> Plan:
    return one(f"CASE WHEN x IS NOT NULL THEN avg(x) OVER {RUNNING} END", {"x": TYPICAL})


@indicator("VolumeWeightedAveragePrice", "vwap")
def _() -> Plan:
    return one(f"CASE WHEN {running('v')} > 0 THEN {ratio(running('x'), running('v'))} END", {"x": f"{TYPICAL} * volume"}, {"v": "CASE WHEN x IS NOT NULL THEN volume END"})


@indicator("WilliamsAccumulationDistribution", "wad", "williamsad")
def _() -> Plan:
    return one(
        f"CASE WHEN x IS NOT NULL THEN {running('x')} END",
        {"p": prior("close")},
        {"x": f"CASE WHEN NOT ({PRICED}) OR coalesce(p, 0) = 0 THEN NULL WHEN close > p THEN close - least(low, p) WHEN close < p THEN close - greatest(high, p) ELSE 0.0 END"},
    )


@indicator("WilliamsVariableAccumulationDistribution", "wvad")
def _() -> Plan:
    return one(running("x"), {"x": "coalesce((close - open) / nullif(high - low, 0) * volume, 0.0)"})


@indicator("VolumeProfileIndicator", "vp", "volumeprofile", step=1.0)
def _(step: float) -> Plan:
    """Volume so far, and by bucket of the close, in the order of prices; each bar has all buckets so far."""
    return machine(M.buckets, {"value": "double", "buckets": "array<struct<price:double,volume:double>>"}, ("close", "volume"), step=step if step > 0 else 1.0)


# recursive averages


def _dmi(length: int) -> list[Step]:
    up, down = f"high - {lag('high')}", f"{lag('low')} - low"
    return [
        {"whole": f"i > 0 AND high + low + {lag('high')} + {lag('low')} + {lag('close')} IS NOT NULL", "r": FULL_RANGE},
        {"p": f"CASE WHEN NOT whole THEN NULL WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0.0 END", "m": f"CASE WHEN NOT whole THEN NULL WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0.0 END", "t": "CASE WHEN i = 0 OR whole THEN r END"},
        [Average("sp", "p", length, "grow"), Average("sm", "m", length, "grow"), Average("st", "t", length, "grow")],
        {"plusDI": f"CASE WHEN i > {length} THEN {ratio('100 * sp', 'st')} END", "minusDI": f"CASE WHEN i > {length} THEN {ratio('100 * sm', 'st')} END"},
        {"dx": "coalesce(100 * abs(plusDI - minusDI) / nullif(plusDI + minusDI, 0), CASE WHEN plusDI IS NOT NULL THEN 0.0 END)"},
    ]


@indicator("DirectionalIndex", "dx", length=14)
def _(length: int) -> Plan:
    return Plan(_dmi(length), {x: x for x in ("plusDI", "minusDI", "dx")})


@indicator("AverageDirectionalIndex", "adx", length=14)
def _(length: int) -> Plan:
    return Plan([*_dmi(length), [Average("a", "dx", length, "grow")], {"adx": f"CASE WHEN i >= {2 * length} THEN a END"}], {x: x for x in ("adx", "dx", "plusDI", "minusDI")})


def _alligator(jawLength, jawShift, teethLength, teethShift, lipsLength, lipsShift) -> list[Step]:
    lines = (("jaw", jawLength, jawShift), ("teeth", teethLength, teethShift), ("lips", lipsLength, lipsShift))
    return [{"mid": MID}, [Average(f"{x}0", "mid", n, "smooth") for x, n, _ in lines], {x: f"CASE WHEN i >= {n - 1 + k} THEN {lag(x + '0', k)} END" for x, n, k in lines}]


_JAWS = {"jawLength": 13, "jawShift": 8, "teethLength": 8, "teethShift": 5, "lipsLength": 5, "lipsShift": 3}


@indicator("Alligator", **_JAWS)
def _(**params: int) -> Plan:
    return Plan(_alligator(**params), {x: x for x in ("jaw", "teeth", "lips")})


@indicator("GatorOscillator", "gator", **_JAWS)
def _(**params: int) -> Plan:
    return wide({"upper": "abs(jaw - lips)", "lower": "-abs(lips - teeth)"}, *_alligator(**params))


def ema(out: str, x: str, n: int, start: str = "mean") -> Average:
    return Average(out, x, n, start)


@indicator("ExponentialMovingAverage", "ema", length=14)
def _(length: int) -> Plan:
    return Plan([[ema("value", "close", length, "strict")]], {"value": "value"})


@indicator("SmoothedMovingAverage", "smma", length=32)
def _(length: int) -> Plan:
    return Plan([[Average("value", "close", length, "fixed")]], {"value": "value"})


@indicator("WilderMovingAverage", "wilderma", length=32)
def _(length: int) -> Plan:
    return Plan([[Average("value", "close", length, "fixed")]], {"value": "value"})


@indicator("AverageTrueRange", "atr", length=14)
def _(length: int) -> Plan:
    return Plan([{"t": FULL_RANGE}, [Average("value", "t", length, "fixed")]], {"value": "value"})


@indicator("AdaptivePriceZone", "apz", period=5, bandPercentage=2.0)
def _(period: int, bandPercentage: float) -> Plan:
    return wide({"ma": "e", "upper": f"e + {bandPercentage} * s", "lower": f"e - {bandPercentage} * s"}, [ema("e", "close", period, "strict")], {"s": deviation("close", period)})


@indicator("BearPower", length=13)
def _(length: int) -> Plan:
    return one("low - e", [ema("e", "close", length, "strict")])


@indicator("BullPower", length=13)
def _(length: int) -> Plan:
    return one("high - e", [ema("e", "close", length, "strict")])


@indicator("ElderRay", length=13)
def _(length: int) -> Plan:
    return wide({"bull": "high - e", "bear": "low - e"}, [ema("e", "close", length, "strict")])


@indicator("ChaikinOscillator", fast=3, slow=10)
def _(fast: int, slow: int) -> Plan:
    return one("a - b", {"x": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0.0)"}, {"y": running("x")}, [ema("a", "y", fast), ema("b", "y", slow)])


@indicator("ChaikinVolatility", emaLength=32, rocLength=5)
def _(emaLength: int, rocLength: int) -> Plan:
    return one(ratio(f"100 * (e - {lag('e', rocLength)})", lag("e", rocLength)), {"x": "high - low"}, [ema("e", "x", emaLength)])


_GAINS: Step = {"g": rise(f"({CHANGE})"), "l": rise(f"({lag('close')} - close)")}


def _rsi(out: str, g: str, l: str) -> dict[str, str]:  # noqa: E741
    return {out: f"CASE WHEN {g} + {l} = 0 THEN 50.0 ELSE 100 * {g} / nullif({g} + {l}, 0) END"}


@indicator("RelativeStrengthIndex", "rsi", length=14)
def _(length: int) -> Plan:
    return one(f"CASE WHEN i >= {length} THEN r END", _GAINS, [Average("a", "g", length, "smooth"), Average("b", "l", length, "smooth")], _rsi("r", "a", "b"))


@indicator("DynamicZonesRSI", "dzrsi", length=14, oversoldLevel=20.0, overboughtLevel=80.0)
def _(length: int, oversoldLevel: float, overboughtLevel: float) -> Plan:
    return one(
        "CASE WHEN lo IS NULL THEN NULL WHEN r <= lo THEN 0.0 WHEN r >= hi THEN 100.0 ELSE 100 * (r - lo) / nullif(hi - lo, 0) END",
        _GAINS,
        [Average("a", "g", length, "mean", 1 / length), Average("b", "l", length, "mean", 1 / length)],
        {"r": "CASE WHEN b = 0 THEN 100.0 ELSE 100 - 100 / (1 + a / nullif(b, 0)) END"},
        {"mn": lowest("r", length), "mx": highest("r", length)},
        {"lo": f"mn + (mx - mn) * {oversoldLevel / 100}", "hi": f"mn + (mx - mn) * {overboughtLevel / 100}"},
    )


@indicator("DoubleExponentialMovingAverage", "dema", length=32)
def _(length: int) -> Plan:
    return one("2 * a - b", [ema("a", "close", length)], [ema("b", "a", length)])


@indicator("TripleExponentialMovingAverage", "tema", length=32)
def _(length: int) -> Plan:
    return one("3 * a - 3 * b + c", [ema("a", "close", length)], [ema("b", "a", length)], [ema("c", "b", length)])


@indicator("Trix", length=14)
def _(length: int) -> Plan:
    return one(ratio(f"1000 * (c - {lag('c')})", lag("c")), [ema("a", "close", length)], [ema("b", "a", length)], [ema("c", "b", length)])


@indicator("ElderImpulseSystem", "elderimpulse", emaLength=13, fastLength=12, slowLength=26)
def _(emaLength: int, fastLength: int, slowLength: int) -> Plan:
    up, down = f"e > {lag('e')} AND m > {lag('m')}", f"e < {lag('e')} AND m < {lag('m')}"
    return Plan(
        [
            [ema("e", "close", emaLength, "partial"), ema("f", "close", fastLength, "partial"), ema("s", "close", slowLength, "partial")],
            {"m": "f - s"},
            {"value": f"CASE WHEN i < {max(emaLength - 1, slowLength - 1)} OR e + m + {lag('e')} + {lag('m')} IS NULL THEN NULL WHEN {up} THEN 1.0 WHEN {down} THEN -1.0 ELSE 0.0 END"},
            {"state": "CASE WHEN value = 1 THEN 'green' WHEN value = -1 THEN 'red' WHEN value = 0 THEN 'blue' END"},
        ],
        {"value": "value", "state": "state"},
    )


@indicator("ForceIndex", "elderforceindex", length=13)
def _(length: int) -> Plan:
    return Plan([{"x": f"({CHANGE}) * volume"}, [ema("value", "x", length)]], {"value": "value"})


@indicator("GuppyMultipleMovingAverage", "gmma")
def _() -> Plan:
    lengths = (3, 5, 8, 10, 12, 15, 30, 35, 40, 45, 50, 60)
    return Plan([[ema(f"ema{n}", "close", n, "strict") for n in lengths]], {f"ema{n}": f"ema{n}" for n in lengths})


@indicator("KeltnerChannels", "keltner", length=20, multiplier=2.0)
def _(length: int, multiplier: float) -> Plan:
    from_full = lambda x: f"CASE WHEN i >= {length - 1} THEN {x} END"
    return wide({"middle": from_full("e"), "upper": from_full(f"e + {multiplier} * a"), "lower": from_full(f"e - {multiplier} * a")}, *_range_over_gaps("t"), [ema("e", "close", length, "partial"), Average("a", "t", length, "grow")])


@indicator("KlingerVolumeOscillator", "kvo", shortPeriod=34, longPeriod=55)
def _(shortPeriod: int, longPeriod: int) -> Plan:
    return Plan(
        [{"tp": f"CASE WHEN volume IS NOT NULL THEN {TYPICAL} END"}, {"p": prior("tp")}, {"x": "CASE WHEN tp > coalesce(p, 0) THEN volume WHEN tp IS NOT NULL THEN -volume END"}, [ema("shortEma", "x", shortPeriod), ema("longEma", "x", longPeriod)], {"oscillator": "shortEma - longEma"}],
        {x: x for x in ("shortEma", "longEma", "oscillator")},
    )


def _macd(fast: int, slow: int, signal: int, line: str = "a - b") -> list[Step]:
    return [[ema("a", "close", fast), ema("b", "close", slow)], {"line": line}, [ema("signal", "line", signal)], {"histogram": "line - signal"}]


@indicator("MovingAverageConvergenceDivergence", "macd", "movingaverageconvergencedivergencehistogram", fastLength=12, slowLength=26, signalLength=9)
def _(fastLength: int, slowLength: int, signalLength: int) -> Plan:
    return Plan(_macd(fastLength, slowLength, signalLength), {"macd": "line", "signal": "signal", "histogram": "histogram"})


@indicator("MovingAverageConvergenceDivergenceSignal", "macdsignal", longLength=26, shortLength=12, signalLength=9)
def _(longLength: int, shortLength: int, signalLength: int) -> Plan:
    return Plan(_macd(shortLength, longLength, signalLength), {"macd": "line", "signal": "signal"})


@indicator("PercentagePriceOscillator", "ppo", "percentagepriceoscillatorhistogram", "percentagepriceoscillatorsignal", shortLength=12, longLength=26, signalLength=9)
def _(shortLength: int, longLength: int, signalLength: int) -> Plan:
    line = "CASE WHEN b = 0 THEN 0.0 ELSE 100 * (a - b) / nullif(b, 0) END"
    return Plan(_macd(shortLength, longLength, signalLength, line), {"ppo": "line", "signal": "signal", "histogram": "histogram"})


@indicator("PercentageVolumeOscillator", "pvo", shortPeriod=12, longPeriod=26)
def _(shortPeriod: int, longPeriod: int) -> Plan:
    return Plan([[ema("shortEma", "volume", shortPeriod), ema("longEma", "volume", longPeriod)], {"pvo": ratio("100 * (shortEma - longEma)", "longEma")}], {x: x for x in ("shortEma", "longEma", "pvo")})


@indicator("McClellanOscillator", "mcclellanosc", shortLength=19, longLength=39)
def _(shortLength: int, longLength: int) -> Plan:
    return one("a - b", [ema("a", "close", shortLength, "strict"), ema("b", "close", longLength, "strict")])


@indicator("T3MovingAverage", "t3", length=5, volumeFactor=0.7)
def _(length: int, volumeFactor: float) -> Plan:
    v = volumeFactor
    c1, c2, c3, c4 = -(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2
    chain: list[Step] = [[ema(f"e{k}", f"e{k - 1}" if k > 1 else "close", length, "partial")] for k in range(1, 7)]
    return one(f"CASE WHEN i >= {length + 9} THEN {c1!r} * e6 + {c2!r} * e5 + {c3!r} * e4 + {c4!r} * e3 END", *chain)


@indicator("TrueStrengthIndex", "tsi", firstLength=25, secondLength=13, signalLength=7)
def _(firstLength: int, secondLength: int, signalLength: int) -> Plan:
    return Plan(
        [
            {"x": CHANGE, "y": f"abs({CHANGE})"},
            [ema("x1", "x", firstLength, "partial"), ema("y1", "y", firstLength, "partial")],
            [ema("x2", "x1", secondLength, "partial"), ema("y2", "y1", secondLength, "partial")],
            {"tsi": f"CASE WHEN i >= {secondLength} THEN CASE WHEN y2 = 0 THEN 0.0 ELSE 100 * x2 / nullif(y2, 0) END END"},
            [ema("s", "tsi", signalLength, "partial")],
            {"signal": f"CASE WHEN i >= {secondLength + signalLength - 1} THEN s END"},
        ],
        {"tsi": "tsi", "signal": "signal"},
    )


@indicator("TwiggsMoneyFlow", "tmf", length=21)
def _(length: int) -> Plan:
    # a bar without a range repeats the last flow, a bar with a gap is passed over
    return one(
        f"nullif({ratio('a', 'b')}, 0)",
        {"x": f"CASE WHEN high <> low THEN volume * (2 * {TYPICAL} - high - low) / nullif(high - low, 0) END", "v": f"CASE WHEN {PRICED} THEN volume END"},
        {"y": f"CASE WHEN v IS NOT NULL THEN coalesce(last_value(x) IGNORE NULLS OVER {RUNNING}, 0.0) END"},
        [ema("a", "y", length), ema("b", "v", length)],
    )


@indicator("WaveTrendOscillator", "wto", "wavetrend", esaPeriod=10, dPeriod=14, averagePeriod=3)
def _(esaPeriod: int, dPeriod: int, averagePeriod: int) -> Plan:
    return Plan(
        [{"tp": TYPICAL}, [ema("esa", "tp", esaPeriod)], {"x": "abs(tp - esa)"}, [ema("d", "x", dPeriod)], {"wt1": ratio("tp - esa", "0.015 * d")}, {"ok": "wt1 IS NOT NULL"}, {"wt2": partial_mean("wt1", averagePeriod, DENSE)}],
        {"wt1": "wt1", "wt2": "wt2"},
    )


# recurrences whose coefficients windows give


def linear(out: str, alpha: str, x: str) -> list[Step]:
    """out += alpha (x - out), alpha and x being text."""
    return [{f"{out}_a": f"1 - ({alpha})", f"{out}_b": f"({alpha}) * ({x})"}, [Linear(out, f"{out}_a", f"{out}_b")]]


@indicator("FractalAdaptiveMovingAverage", "frama", length=20)
def _(length: int) -> Plan:
    third = length // 3
    span = lambda first, n: f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {length - 1 - first} PRECEDING AND {length - first - n} PRECEDING)"
    widths = {f"n{k}": f"(max(close) OVER {span(first, n)} - min(close) OVER {span(first, n)}) / {max(1, third)}" for k, (first, n) in enumerate(((0, third), (third, third), (2 * third, length - 2 * third)), 1)}
    return Plan(
        [widths, {"d": f"CASE WHEN n1 + n2 > 0 AND n3 > 0 THEN greatest(1.0, least(2.0, (ln(nullif(n1 + n2, 0)) - ln(nullif(n3, 0))) / {math.log(2)!r})) ELSE 1.0 END"}, {"k": f"CASE WHEN i >= {length - 1} THEN exp(-4.6 * (d - 1)) END"}, *linear("value", "k", "close")],
        {"value": "value"},
    )


@indicator("KaufmanAdaptiveMovingAverage", "kama", length=10, fastSc=2, slowSc=30)
def _(length: int, fastSc: int, slowSc: int) -> Plan:
    fast, slow = 2 / (fastSc + 1), 2 / (slowSc + 1)
    return Plan(
        [
            {"x": f"abs({CHANGE})"},
            {"v": total("x", length)},
            # a gap among the first closes and there is no value at all
            {"e": f"coalesce(abs(close - {lag('close', length)}) / nullif(v, 0), 0.0)", "begun": f"max(CASE WHEN i = {length} AND v IS NOT NULL THEN 1 ELSE 0 END) OVER {RUNNING}"},
            {"k": f"CASE WHEN begun = 0 OR v IS NULL THEN NULL WHEN i = {length} THEN 1.0 ELSE power(e * {fast - slow!r} + {slow!r}, 2) END"},
            *linear("value", "k", "close"),
        ],
        {"value": "value"},
    )


@indicator("ZeroLagExponentialMovingAverage", "zlema", length=14)
def _(length: int) -> Plan:
    back = (length - 1) - (length - 1) // 2
    return Plan([{"x": f"CASE WHEN i >= {length - 1} THEN 2 * close - {lag('close', back)} END"}, *linear("value", f"{2 / (length + 1)!r}", "x")], {"value": "value"})


@indicator("Vidya", length=15)
def _(length: int) -> Plan:
    return Plan(
        [
            {"ok": "close IS NOT NULL", "j": running("CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END")},
            {"u": rise(f"(close - {lag('close', 1, DENSE)})"), "d": rise(f"({lag('close', 1, DENSE)} - close)")},
            {"a": total("u", length, DENSE), "b": total("d", length, DENSE), "m": mean("close", length, DENSE)},
            {"k": f"CASE WHEN NOT ok THEN NULL WHEN j = {2 * length} THEN 1.0 WHEN j > {2 * length} THEN coalesce({2 / (length + 1)!r} * abs((a - b) / nullif(a + b, 0)), 0.0) END", "x": f"CASE WHEN j = {2 * length} THEN m ELSE close END"},
            *linear("value", "k", "x"),
        ],
        {"value": "value"},
    )


@indicator("VariableMovingAverage", "vma", length=20, volatilityIndex=0.2)
def _(length: int, volatilityIndex: float) -> Plan:
    before = lambda n: f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return Plan(
        [
            {"p": f"CASE WHEN i = 0 OR i >= {length} THEN close END", "s": f"CASE WHEN i >= {length} THEN {deviation('close', length)} END"},
            {"m": f"CASE WHEN i < {2 * length} THEN avg(p) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE avg(p) OVER {before(length)} END"},
            {"k": f"CASE WHEN i = 0 THEN 1.0 WHEN s IS NOT NULL THEN 2 / ({length} * (1 + {volatilityIndex} * coalesce(abs(s / nullif(m, 0)), 0.0)) + 1) END"},
            *linear("y", "k", "close"),
            {"value": f"CASE WHEN i >= {length} THEN y END"},
        ],
        {"value": "value"},
    )


@indicator("JurikMovingAverage", "jma", length=20, phase=0)
def _(length: int, phase: int) -> Plan:
    beta, share = 0.45 * (length - 1) / (0.45 * (length - 1) + 2), (max(-100, min(100, phase)) + 100) / 200
    # formed by the first close from bar length - 1 on; gaps are passed over
    k = f"CASE WHEN formed <= 1 THEN 1.0 ELSE {beta!r} END"
    return one(
        f"CASE WHEN close IS NULL THEN NULL WHEN formed = 1 THEN close WHEN formed > 1 THEN y + {share!r} * (y - before) END",
        {"formed": running(f"CASE WHEN i >= {length - 1} AND close IS NOT NULL THEN 1 ELSE 0 END")},
        *linear("x", k, "close"),
        *linear("y", k, "x"),
        {"before": prior("y")},
    )


def _compounding(sign: str) -> Plan:
    """1000 times the changes of the close over the bars whose volume compares so with that of the last whole bar; a zero there is none."""
    return Plan(
        [
            {"c": "CASE WHEN volume IS NOT NULL THEN close END", "v": "CASE WHEN close IS NOT NULL THEN volume END"},
            {"p": prior("c"), "q": prior("v")},
            {"a": f"CASE WHEN i = 0 THEN 0.0 WHEN p <> 0 AND q <> 0 AND v <> 0 AND v {sign} q THEN c / nullif(p, 0) ELSE 1.0 END", "b": "CASE WHEN i = 0 THEN 1000.0 ELSE 0.0 END"},
            [Linear("value", "a", "b")],
        ],
        {"value": "value"},
    )


@indicator("NegativeVolumeIndex", "nvi")
def _() -> Plan:
    return _compounding("<")


@indicator("PositiveVolumeIndex", "pvi")
def _() -> Plan:
    return _compounding(">")


@indicator("AdaptiveLaguerreFilter", "alf", gamma=0.8)
def _(gamma: float) -> Plan:
    if not 0 < gamma < 1:
        return one("CAST(NULL AS DOUBLE)")
    chain = linear("l0", f"{1 - gamma!r}", "close")
    for k in (1, 2, 3):
        chain += linear(f"l{k}", f"{1 - gamma!r}", f"l{k - 1}")
    return one(f"CASE WHEN max(CASE WHEN v >= close THEN 1 ELSE 0 END) OVER {RUNNING} = 1 THEN v END", *chain, {"v": "(l0 + 2 * l1 + 2 * l2 + l3) / 6"})


@indicator("LaguerreRSI", gamma=0.7)
def _(gamma: float) -> Plan:
    chain = linear("l0", f"{1 - gamma!r}", "close")
    for k in (1, 2, 3):
        chain += [{f"b{k}": prior(f"l{k - 1}")}, {f"g{k}": f"{gamma!r}", f"h{k}": f"coalesce(b{k}, 0) - {gamma!r} * l{k - 1}"}, [Linear(f"l{k}", f"g{k}", f"h{k}")]]
    up = " + ".join(f"({rise(f'(l{k} - l{k + 1})')})" for k in range(3))
    down = " + ".join(f"({rise(f'(l{k + 1} - l{k})')})" for k in range(3))
    return one("CASE WHEN cu + cd = 0 THEN 50.0 ELSE 100 * cu / nullif(cu + cd, 0) END", *chain, {"u": up, "d": down}, *linear("cu", f"{1 - gamma!r}", "u"), *linear("cd", f"{1 - gamma!r}", "d"))


@indicator("OptimalTracking")
def _() -> Plan:
    k1 = math.exp(-0.25)
    near = f"CASE WHEN i = 0 THEN 1.0 ELSE {1 - k1!r} END"
    return one(
        "CASE WHEN i > 0 THEN y END",
        {"mid": MID, "half": "(high - low) / 2"},
        {"move": f"coalesce(mid - {lag('mid')}, 0.0)"},
        *linear("sd", near, "move"),
        *linear("sr", near, "half"),
        {"r": "CASE WHEN i > 0 AND sr <> 0 THEN abs(sd / nullif(sr, 0)) END"},
        {"q": (f"coalesce(last_value(r) IGNORE NULLS OVER {RUNNING}, 0.0)", f"coalesce(last_value(r IGNORE NULLS) OVER {RUNNING}, 0.0)")},
        {"k": "CASE WHEN i = 0 THEN 1.0 ELSE (-q * q + sqrt(power(q, 4) + 16 * q * q)) / 8 END"},
        *linear("y", "k", "mid"),
    )


# compositions


@indicator("KasePeakOscillator", "kpo", atrLength=10, shortPeriod=9, longPeriod=18)
def _(atrLength: int, shortPeriod: int, longPeriod: int) -> Plan:
    prev, first = lag("close", 1, DENSE), atrLength - 1
    return Plan(
        [
            *_range_over_gaps("t"),
            [Average("a", "t", atrLength, "grow")],
            # bars without prices are passed over, and so are those before the range is formed
            {"ok": f"i >= {first} AND {PRICED}"},
            {"prev": f"CASE WHEN ok THEN nullif({prev}, 0) END"},
            {
                "peak": "CASE WHEN NOT ok THEN NULL WHEN close > prev THEN greatest(high, prev + a) WHEN close < prev THEN least(high, prev + 0.5 * a) ELSE high END",
                "valley": "CASE WHEN NOT ok THEN NULL WHEN close > prev THEN greatest(low, prev - 0.5 * a) WHEN close < prev THEN least(low, prev - a) ELSE low END",
            },
            {"p0": f"coalesce({lag('peak', 1, DENSE)}, peak)", "v0": f"coalesce({lag('valley', 1, DENSE)}, valley)"},
            {
                "shortTerm": f"CASE WHEN ok AND i >= {first + shortPeriod - 1} THEN coalesce(100 * (close - least(valley, v0)) / nullif(greatest(peak, p0) - least(valley, v0), 0), 0.0) END",
                "longTerm": f"CASE WHEN ok AND i >= {first + longPeriod - 1} THEN coalesce(100 * (close - v0) / nullif(p0 - v0, 0), 0.0) END",
            },
        ],
        {"shortTerm": "shortTerm", "longTerm": "longTerm"},
    )


@indicator("MassIndex", length=25, emaLength=9)
def _(length: int, emaLength: int) -> Plan:
    # both averages begin anew after a gap; the last ratios there are go on over it
    rate = 2 / (emaLength + 1)
    step = lambda out, x: [{f"{out}_a": f"CASE WHEN k = 1 THEN 0.0 WHEN k <= {emaLength} THEN 1.0 ELSE {1 - rate!r} END", f"{out}_b": f"{x} * CASE WHEN k <= {emaLength} THEN {1 / emaLength!r} ELSE {rate!r} END"}, [Linear(out, f"{out}_a", f"{out}_b")]]
    return one(
        f"last_value(t) IGNORE NULLS OVER {RUNNING}",
        {"x": "high - low"},
        {"gap": "CASE WHEN x IS NULL THEN i END"},
        {"last_gap": f"last_value(gap) IGNORE NULLS OVER {RUNNING}"},
        {"k": "i - coalesce(last_gap, -1)"},
        *step("a", "x"),
        *step("b", "a"),
        {"r": f"CASE WHEN k >= {emaLength} THEN {ratio('a', 'b')} END"},
        {"ok": "r IS NOT NULL"},
        {"t": total("r", length, DENSE)},
    )


@indicator("MarketMeannessIndex", "mmi", length=200)
def _(length: int) -> Plan:
    # on eviction the direction that leaves is held against the latest one
    gone = f"sign({lag('close', length - 1)} - {lag('close', length)})"
    return one(
        f"CASE WHEN i >= {length - 1} THEN coalesce(100.0 * c / nullif(p, 0), 0.0) END",
        {"d": f"coalesce(sign({CHANGE}), 0)", "g": f"CASE WHEN i >= {length} THEN {gone} END"},
        {"e": f"coalesce({lag('d')}, 0)"},
        {"dp": "CASE WHEN i > 0 AND d <> 0 THEN 1 ELSE 0 END - CASE WHEN g <> 0 THEN 1 ELSE 0 END", "dc": "CASE WHEN i > 0 AND d <> e AND e <> 0 THEN 1 ELSE 0 END - CASE WHEN g <> e AND e <> 0 THEN 1 ELSE 0 END"},
        {"p": running("dp"), "c": running("dc")},
    )


@indicator("PsychologicalLine", "psy", length=20)
def _(length: int) -> Plan:
    # on eviction the oldest price is held against the newest in the window
    before, oldest = lag("close", 1, DENSE), lag("close", length, DENSE)
    return one(
        f"CASE WHEN ok AND j >= {length} THEN {running('x')} / {length} END",
        {"ok": "close IS NOT NULL", "j": running("CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END")},
        {"x": f"CASE WHEN ok THEN CASE WHEN close > {before} THEN 1e0 ELSE 0e0 END - CASE WHEN {oldest} < {before} THEN 1e0 ELSE 0e0 END END"},
    )


def _gain(x: str, sign: int = 1) -> str:
    d = f"{x} - {lag(x)}" if sign > 0 else f"{lag(x)} - ({x})"
    return rise(f"({d})")


def _rsi_steps(out: str, x: str, n: int) -> list[Step]:
    """RSI that gives values while its averages fill."""
    return [{f"{out}_g": _gain(x), f"{out}_l": _gain(x, -1)}, [Average(f"{out}_a", f"{out}_g", n, "smooth"), Average(f"{out}_b", f"{out}_l", n, "smooth")], _rsi(out, f"{out}_a", f"{out}_b")]


@indicator("ConstanceBrownCompositeIndex", "cbci", rsiLength=14, rocLength=9, shortRsiLength=3, momentumLength=3, fastSmaLength=13, slowSmaLength=33)
def _(rsiLength: int, rocLength: int, shortRsiLength: int, momentumLength: int, fastSmaLength: int, slowSmaLength: int) -> Plan:
    gate = max(rsiLength, shortRsiLength, rocLength + 1, momentumLength)
    return Plan(
        [
            *_rsi_steps("r", "close", rsiLength),
            *_rsi_steps("q", "close", shortRsiLength),
            {"there": "q IS NOT NULL"},
            {"c": ratio(f"100 * (r - {lag('r', rocLength)})", lag("r", rocLength)), "m": partial_mean("q", momentumLength, "symbol, there")},
            {"composite": f"CASE WHEN i >= {gate} THEN c + m END"},
            {"fastSma": mean("composite", fastSmaLength), "slowSma": mean("composite", slowSmaLength)},
        ],
        {x: x for x in ("composite", "fastSma", "slowSma")},
    )


@indicator("CompositeMomentum", shortRocLength=14, longRocLength=28, rsiLength=14, fastLength=12, slowLength=26, smaLength=9)
def _(shortRocLength: int, longRocLength: int, rsiLength: int, fastLength: int, slowLength: int, smaLength: int) -> Plan:
    roc = lambda n: ratio(f"100 * (close - {lag('close', n)})", lag("close", n))
    return Plan(
        [
            *_rsi_steps("r", "close", rsiLength),
            [ema("f", "close", fastLength), ema("s", "close", slowLength)],
            {"composite": f"CASE WHEN i >= {rsiLength} THEN (({roc(shortRocLength)} + {roc(longRocLength)}) / 100 + (r - 50) / 50 + CASE WHEN s = 0 THEN 0.0 ELSE (f - s) / nullif(s, 0) END) / 4 * 100 END"},
            {"sma": mean("composite", smaLength)},
        ],
        {"composite": "composite", "sma": "sma"},
    )


@indicator("ConnorsRSI", rsiLength=3, streakLength=2, rocLength=100)
def _(rsiLength: int, streakLength: int, rocLength: int) -> Plan:
    old = f"CASE WHEN i < {rocLength} THEN first_value(close) OVER {RUNNING} ELSE {lag('close', rocLength)} END"
    gate = max(rsiLength, streakLength, rocLength)
    held = lambda x: f"CASE WHEN i >= {gate} AND r1 + r2 + r3 IS NOT NULL THEN {x} END"
    return Plan(
        [
            {"ok": "close IS NOT NULL"},
            # which way the close went since the last one there was; the first is a rise
            {"d": f"CASE WHEN ok THEN coalesce(sign(close - {lag('close', 1, DENSE)}), 1) END"},
            {"kept": f"CASE WHEN NOT ok THEN NULL WHEN d = {lag('d', 1, DENSE)} THEN 1.0 ELSE 0.0 END", "step": "1.0"},
            [Linear("same", "kept", "step")],
            {"streak": "d * same", "roc": ratio(f"100 * (close - {old})", old)},
            *_rsi_steps("r1", "close", rsiLength),
            *_rsi_steps("r2", "streak", streakLength),
            *_rsi_steps("r3", "roc", rocLength),
            {"rsi": held("r1"), "updown": held("r2"), "rocrsi": held("r3"), "crsi": held("(r1 + r2 + r3) / 3")},
        ],
        {x: x for x in ("rsi", "updown", "rocrsi", "crsi")},
    )


@indicator("SchaffTrendCycle", "stc", length=10, shortLength=23, longLength=50, cycleLength=5, signalLength=3)
def _(length: int, shortLength: int, longLength: int, cycleLength: int, signalLength: int) -> Plan:
    edge = lambda fn, x, n, flag: f"{fn}({x}) OVER {frame(n, f'symbol, {flag}')}"
    return Plan(
        [
            *_macd(shortLength, longLength, signalLength),
            {"ok": "close IS NOT NULL"},
            # the histogram is normalised by the range of the last closes; without one the last position stands
            {"low_": edge("min", "close", length, "ok"), "high_": edge("max", "close", length, "ok")},
            {"raw": f"CASE WHEN histogram IS NOT NULL THEN {ratio('histogram - low_', 'high_ - low_')} END"},
            {"there": "raw IS NOT NULL", "formed": f"count(raw) OVER {RUNNING}"},
            {"least_": edge("min", "raw", cycleLength, "there"), "most_": edge("max", "raw", cycleLength, "there")},
            {"place_": f"CASE WHEN raw IS NULL OR formed < {cycleLength} THEN NULL WHEN most_ = least_ THEN 0.0 ELSE 100 * (raw - least_) / nullif(most_ - least_, 0) END"},
            {"k": f"CASE WHEN histogram IS NULL OR formed < {cycleLength} THEN NULL ELSE coalesce(last_value(place_) IGNORE NULLS OVER {RUNNING}, 0.0) END"},
            [ema("value", "k", length)],
        ],
        {"value": "value"},
    )


# state machines


def machine(advance: Callable, outs: dict[str, str], reads: tuple[str, ...], *before: Step, **params: float) -> Plan:
    return Plan([*before, [Machine(outs, advance, reads, params)]], {x: x for x in outs})


_VALUE = {"value": "double"}


@indicator("Aroon", length=14)
def _(length: int) -> Plan:
    return machine(M.aroon, {"up": "double", "down": "double"}, ("high", "low"), length=length)


@indicator("AroonOscillator", length=14)
def _(length: int) -> Plan:
    return one("up - down", *machine(M.aroon, {"up": "double", "down": "double"}, ("high", "low"), length=length).steps)


@indicator("ApprovalFlowIndex", "afi", length=14)
def _(length: int) -> Plan:
    return machine(M.approval_flow, _VALUE, ("close", "volume"), length=length)


@indicator("EaseOfMovement", "eom", length=14)
def _(length: int) -> Plan:
    return machine(M.ease_of_movement, _VALUE, ("high", "low", "volume"), length=length)


@indicator("DemandIndex", length=14)
def _(length: int) -> Plan:
    return machine(M.demand, _VALUE, ("close", "volume"), length=length)


@indicator("EhlersFisherTransform", "ehlerfisher", length=10)
def _(length: int) -> Plan:
    return machine(M.fisher, {"main": "double", "trigger": "double"}, ("x",), {"a": highest("high", length), "b": lowest("low", length)}, {"x": f"coalesce(0.5 * (({MID} - b) / nullif(a - b, 0) - 0.5), CASE WHEN a IS NOT NULL THEN 0.0 END)"})


@indicator("McGinleyDynamic", "mcginley", length=14)
def _(length: int) -> Plan:
    return machine(M.mcginley, _VALUE, ("close", "seed"), {"seed": f"CASE WHEN i = {length - 1} THEN {mean('close', length)} END"}, length=length)


@indicator("MomentumOfMovingAverage", "momma", length=14)
def _(length: int) -> Plan:
    return machine(M.interleaved, _VALUE, ("close",), length=length)


@indicator("KalmanFilter", "kalman", processNoise=1e-5, measurementNoise=1e-3, length=10)
def _(processNoise: float, measurementNoise: float, length: int) -> Plan:
    return machine(M.kalman, _VALUE, ("close",), process=processNoise, measurement=measurementNoise, length=length)


@indicator("NickRypockTrailingReverse", "nrtr", length=50, multiple=100.0)
def _(length: int, multiple: float) -> Plan:
    return machine(M.trailing_reverse, _VALUE, ("close",), length=length, multiple=max(1.0, multiple) / 1000)


@indicator("SuperTrend", length=10, multiplier=3.0)
def _(length: int, multiplier: float) -> Plan:
    return machine(M.super_trend, {"value": "double", "direction": "double"}, ("high", "low", "close", "a", "ready"), *_range_over_gaps("t"), {"ready": f"CASE WHEN i >= {length - 1} THEN 1 ELSE 0 END"}, [Average("a", "t", length, "grow")], multiplier=multiplier)


@indicator("ParabolicSar", "psar", acceleration=0.02, accelerationMax=0.2, accelerationStep=0.02)
def _(acceleration: float, accelerationMax: float, accelerationStep: float) -> Plan:
    return machine(M.parabolic, _VALUE, ("high", "low"), acceleration=acceleration, step=accelerationStep, most=accelerationMax)


_PIVOT = {"value": "double", "shift": "double", "is_up": "boolean"}


@indicator("ZigZag", deviation=0.001)
def _(deviation: float) -> Plan:
    return machine(M.zigzag, _PIVOT, ("close",), deviation=deviation, sides=0)


@indicator("Peak", deviation=0.001)
def _(deviation: float) -> Plan:
    return machine(M.zigzag, _PIVOT, ("high",), deviation=deviation, sides=1)


@indicator("Trough", deviation=0.001)
def _(deviation: float) -> Plan:
    return machine(M.zigzag, _PIVOT, ("low",), deviation=deviation, sides=-1)


@indicator("Fractals", length=5)
def _(length: int) -> Plan:
    if length <= 2 or length % 2 == 0:
        return wide({"up": "CAST(NULL AS DOUBLE)", "down": "CAST(NULL AS DOUBLE)", "shift": "CAST(NULL AS DOUBLE)"})
    half = length // 2

    def pivot(x: str, sign: str) -> str:
        back = "<" if sign == ">" else ">"
        pairs = [f"{lag(x, k)} {sign if k >= half else back} {lag(x, k + 1)}" for k in range(length - 1)]
        return f"CASE WHEN {' AND '.join(pairs)} THEN {lag(x, half)} END"

    return Plan([{"a": pivot("high", ">"), "b": pivot("low", "<")}, [Machine({"up": "double", "down": "double"}, M.spaced, ("a", "b"), {"length": length})], {"shift": f"CASE WHEN up IS NOT NULL OR down IS NOT NULL THEN {half} END"}], {"up": "up", "down": "down", "shift": "shift"})
