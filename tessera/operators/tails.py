"""Distributions with support beyond what was predicted: quantile functions with exponential or generalised Pareto tails, bars whose outer buckets are half-normal, and repair of transformed borders.

Everything is an expression over arrays of a row. The tails of a row are fitted once, into a
struct that the functions read; levels and borders are the same for all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import uniform
from tessera.operators.confident import let
from tessera.operators.distributions import literal, total

#: Outermost quantiles that a tail is fitted to; bounds of its scale and of its shape, and the shape that counts as none; bounds of slopes and of exponents; smallest probability or distance.
OUTER = 20
SCALE, SHAPE, FLAT = (0.01, 100.0), 0.49, 0.01
SLOPE, EXPONENT, TINY = (1e-6, 1e6), 15.0, 1e-6
#: Borders beyond these are broken.
BORDER_LIMITS = (-1e3, 1e3)
#: The 0.75 quantile of the normal distribution: a half-normal of this width has half of its mass inside it.
HALF = 0.6744897501960817


#: Coefficients of a rational approximation of the normal quantile (relative error below 2e-9), in the middle and, as functions of sqrt(-2 ln p), in the tails; and where tails begin.
MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
TAIL_FROM = 0.02425
#: Coefficients of Cody's rational approximations of erf(z) / z as a function of z * z, of exp(z * z) erfc(z) beyond, and where that begins.
ERF_INNER = ((1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03), (1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03))
ERF_OUTER = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03),
    (1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
ERF_INNER_TO = 0.46875


def _between(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _slope(values: Column, logs: Sequence[float]) -> Column:
    """The slope of a regression of values on logs."""
    n, mean = len(logs), sum(logs) / len(logs)
    spread = max(sum((x - mean) ** 2 for x in logs) / n, TINY)
    return total(F.zip_with(values, literal([(x - mean) / n / spread for x in logs]), lambda v, w: v * w))


def _shape(outer: Column, middle: Column, inner: Column, logs: Sequence[float]) -> Column:
    """The shape of a tail from three quantiles: how much farther the outer step is than under an exponential tail. logs: of the two steps."""
    expected = max(logs[0] / max(logs[1], TINY), TINY)
    ratio = (outer - middle) / F.greatest(middle - inner, F.lit(TINY)) / F.lit(expected)
    return F.when(ratio > TINY, _between(F.ln(F.greatest(ratio, F.lit(TINY))) / F.lit(max(abs(logs[0]), TINY)), -SHAPE, SHAPE)).when(ratio.isNotNull(), 0.0)


def with_tails(df: DataFrame, quantiles: str, levels: Sequence[float], into: str = "tails", pareto: bool = False) -> DataFrame:
    """df with a struct for the functions below: q (the quantiles in ascending order), and scale and shape of the left and right tail.

    Scales come from a regression of the outermost quantiles on the logarithm of their probability,
    shapes from the ratio of their steps (pareto; else 0, an exponential tail). A null array, or one with
    a null, gives null results; levels must lie strictly between 0 and 1.
    """
    n, k = len(levels), max(1, min(OUTER, len(levels) // 4))
    if n < 2 or not all(0 < a < b < 1 for a, b in zip(levels, levels[1:])):
        raise ValueError("levels must ascend strictly between 0 and 1")
    q = F.col("__q")
    at = lambda i: F.get(q, F.lit(i))
    left = [math.log(max(a, TINY)) for a in levels[:k]]
    right = [math.log(max(1 - a, TINY)) for a in levels[-k:]]
    scale = lambda s: _between(F.abs(s), *SCALE)
    shapes = [F.lit(0.0), F.lit(0.0)]
    if pareto:
        two, three = k // 3, 2 * k // 3
        step = lambda a, b: math.log(max(a / b, TINY))
        shapes = [
            _shape(-at(0), -at(two), -at(three), [step(levels[two], levels[0]), step(levels[three], levels[two])]),
            _shape(at(n - 1), at(n - 1 - two), at(n - 1 - three), [step(max(1 - levels[-1 - two], TINY), max(1 - levels[-1], TINY)), step(max(1 - levels[-1 - three], TINY), max(1 - levels[-1 - two], TINY))]),
        ]
    found = F.struct(q.alias("q"), scale(_slope(F.slice(q, 1, k), left)).alias("left"), scale(_slope(F.slice(q, n - k + 1, k), right)).alias("right"), shapes[0].alias("left_shape"), shapes[1].alias("right_shape"))
    sound = F.exists(quantiles, lambda v: v.isNull() | F.isnan(v))
    return df.withColumn("__q", F.when(~sound, F.array_sort(quantiles))).withColumn(into, F.when(q.isNotNull(), found)).drop("__q")


def _reach(ratio: Column, scale: Column, shape: Column) -> Column:
    """How far beyond the outermost quantile a probability lies that is 1 / ratio of its own."""
    log = F.least(F.ln(ratio), F.lit(EXPONENT))
    bent = scale / shape * (F.exp(F.least(shape * log, F.lit(EXPONENT))) - 1)
    return F.when(F.abs(shape) < FLAT, scale * log).otherwise(bent)


def inverse(tails: Column, levels: Sequence[float], a: Column) -> Column:
    """The quantile function at probability a."""
    n, q = len(levels), tails["q"]
    left = F.get(q, F.lit(0)) - _reach(F.lit(levels[0]) / F.greatest(a, F.lit(TINY)), tails["left"], tails["left_shape"])
    right = F.get(q, F.lit(n - 1)) + _reach(F.lit(1 - levels[-1]) / F.greatest(1 - a, F.lit(TINY)), tails["right"], tails["right_shape"])
    k = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.size(F.filter(literal(list(levels)), lambda b: b <= a)) - 1))
    lo, hi = F.get(literal(list(levels)), k), F.get(literal(list(levels)), k + 1)
    inside = F.get(q, k) + (a - lo) / (hi - lo) * (F.get(q, k + 1) - F.get(q, k))
    return F.when(a < levels[0], left).when(a > levels[-1], right).otherwise(inside)


def _left_over(beyond: Column, scale: Column, shape: Column) -> Column:
    """The share of an outermost probability that lies farther out than `beyond`."""
    psi = _between(beyond / F.greatest(scale, F.lit(TINY)), 0.0, float("inf"))
    capped = F.least(psi, F.lit(EXPONENT))
    bent = F.exp(_between(-F.ln(F.greatest(1 + shape * capped, F.lit(TINY))) / shape, -EXPONENT, EXPONENT))
    return F.when(F.abs(shape) < FLAT, F.exp(-psi)).otherwise(bent)


def below(tails: Column, levels: Sequence[float], y: Column) -> Column:
    """The distribution function at y."""
    n, q = len(levels), tails["q"]
    first, last = F.get(q, F.lit(0)), F.get(q, F.lit(n - 1))
    left = F.least(F.lit(levels[0]), F.lit(levels[0]) * _left_over(first - y, tails["left"], tails["left_shape"]))
    right = F.greatest(F.lit(levels[-1]), 1 - F.lit(1 - levels[-1]) * _left_over(y - last, tails["right"], tails["right_shape"]))
    k = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.size(F.filter(q, lambda b: b <= y)) - 1))
    lo, hi = F.get(literal(list(levels)), k), F.get(literal(list(levels)), k + 1)
    t = _between((y - F.get(q, k)) / F.greatest(F.get(q, k + 1) - F.get(q, k), F.lit(TINY)), 0.0, 1.0)
    return F.when(y < first, left).when(y > last, right).when(y >= last, F.lit(levels[-1])).otherwise(lo + t * (hi - lo))


def log_density(tails: Column, levels: Sequence[float], y: Column) -> Column:
    """The logarithm of the density at y: of one over the slope of the quantile function there, within SLOPE."""
    n, q = len(levels), tails["q"]
    a = below(tails, levels, y)

    def tail(mass: Column, outermost: float, scale: Column, shape: Column) -> Column:
        kept = F.greatest(mass, F.lit(TINY))
        log = F.least(F.ln(F.lit(outermost) / kept), F.lit(EXPONENT))
        return scale / kept * F.when(F.abs(shape) < FLAT, 1.0).otherwise(F.exp(F.least(shape * log, F.lit(EXPONENT))))

    k = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.size(F.filter(literal(list(levels)), lambda b: b <= a)) - 1))
    inside = (F.get(q, k + 1) - F.get(q, k)) / F.greatest(F.get(literal(list(levels)), k + 1) - F.get(literal(list(levels)), k), F.lit(TINY))
    slope = F.when(a < levels[0], tail(a, levels[0], tails["left"], tails["left_shape"])).when(a > levels[-1], tail(1 - a, 1 - levels[-1], tails["right"], tails["right_shape"])).otherwise(inside)
    return -F.ln(_between(slope, *SLOPE))


def drawn(tails: Column, levels: Sequence[float], seed: int, stream: str, *row: Column | str) -> Column:
    """A draw a row, the same at any partitioning: the quantile function at the row's uniform, kept from 0 and 1."""
    return inverse(tails, levels, _between(uniform(seed, stream, *row), TINY, 1 - TINY))


def erf(x: Column) -> Column:
    """The error function by rational functions, within 1e-15 in the JVM; 1 beyond 6."""

    def ratio(z: Column, factors: tuple[Sequence[float], Sequence[float]]) -> Column:
        over, under = F.lit(factors[0][0]), F.lit(factors[1][0])
        for p, q in zip(factors[0][1:], factors[1][1:]):
            over, under = over * z + F.lit(p), under * z + F.lit(q)
        return over / under

    def of(x: Column, z: Column) -> Column:
        inner = z * let(z * z, lambda s: ratio(s, ERF_INNER))
        return F.signum(x) * F.when(z <= ERF_INNER_TO, inner).otherwise(1 - F.exp(-z * z) * ratio(z, ERF_OUTER))

    return let(x, lambda x: F.when(x.isNotNull(), let(F.least(F.abs(x), F.lit(6.0)), lambda z: of(x, z))))


def probit(p: Column) -> Column:
    """The normal quantile function within the JVM; p strictly between 0 and 1."""

    def horner(x: Column, factors: Sequence[float]) -> Column:
        out = F.lit(factors[0])
        for f in factors[1:]:
            out = out * x + F.lit(f)
        return out

    def tail(t: Column) -> Column:
        r = F.sqrt(-2 * F.ln(t))
        return horner(r, TAIL[0]) / horner(r, TAIL[1])

    d = p - 0.5
    middle = d * horner(d * d, MIDDLE[0]) / horner(d * d, MIDDLE[1])
    return F.when(p < TAIL_FROM, tail(p)).when(p > 1 - TAIL_FROM, -tail(1 - p)).otherwise(middle)


def keyed_normal(seed: int, stream: str, *row: Column | str) -> Column:
    """A standard normal a row, the same at any partitioning."""
    return let(chance(seed, stream, *row), probit)


def chance(seed: int, stream: str, *row: Column | str) -> Column:
    """A uniform within (0, 1), for probit. It has a digest in it, so bind it once or make it a column."""
    return _between(uniform(seed, stream, *row), 1e-9, 1 - 1e-9)


@dataclass(frozen=True)
class OpenBars:
    """Buckets between borders of which the outer two are half-normal, with half of their mass within their width and the rest beyond."""

    borders: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.borders) < 3 or self.borders[1] <= self.borders[0] or self.borders[-1] <= self.borders[-2]:
            raise ValueError("three borders or more, and outer buckets with a width, are needed")

    @property
    def scales(self) -> tuple[float, float]:
        b = self.borders
        return (b[1] - b[0]) / HALF, (b[-1] - b[-2]) / HALF

    def _weighted(self, mass: Column, value: Callable[[float, float], float], left: float, right: float) -> Column:
        b = self.borders
        return total(F.zip_with(mass, literal([left, *(value(x, y) for x, y in zip(b[1:-2], b[2:-1])), right]), lambda p, v: p * v))

    def mean(self, mass: Column) -> Column:
        (s, t), b, m = self.scales, self.borders, math.sqrt(2 / math.pi)
        return self._weighted(mass, lambda x, y: (x + y) / 2, b[1] - s * m, b[-2] + t * m)

    def variance(self, mass: Column) -> Column:
        (s, t), b, m = self.scales, self.borders, math.sqrt(2 / math.pi)
        left, right = s * s * (1 - m * m) + (b[1] - s * m) ** 2, t * t * (1 - m * m) + (b[-2] + t * m) ** 2
        return self._weighted(mass, lambda x, y: (x * x + x * y + y * y) / 3, left, right) - F.pow(self.mean(mass), 2)

    def below(self, mass: Column, y: Column) -> Column:
        """The distribution function at any y."""
        (s, t), b = self.scales, self.borders

        def of(y: Column) -> Column:
            inner = [_between((y - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0) if hi > lo else (y >= lo).cast("double") for lo, hi in zip(b[1:-2], b[2:-1])]
            left = F.when(y >= b[1], 1.0).otherwise(1 - erf((F.lit(b[1]) - y) / F.lit(s * math.sqrt(2))))
            right = F.when(y <= b[-2], 0.0).otherwise(erf((y - F.lit(b[-2])) / F.lit(t * math.sqrt(2))))
            return total(F.zip_with(mass, F.array(left, *inner, right), lambda p, v: p * v))

        return let(y, of)

    def inverse(self, mass: Column, a: Column) -> Column:
        """The quantile function at probability a, strictly between 0 and 1."""
        (s, t), b = self.scales, self.borders
        half = lambda p: let((1 + _between(p, 0.0, 1 - 1e-7)) / 2, probit)

        def of(mass: Column, a: Column) -> Column:
            first, last = F.get(mass, F.lit(0)), F.element_at(mass, -1)
            left = F.lit(b[1]) - F.lit(s) * half(1 - a / F.greatest(first, F.lit(1e-300)))
            right = F.lit(b[-2]) + F.lit(t) * half(1 - (1 - a) / F.greatest(last, F.lit(1e-300)))
            before = F.transform(F.sequence(F.lit(1), F.lit(len(b) - 3)), lambda i: F.aggregate(F.slice(mass, F.lit(1), i), F.lit(0.0), lambda x, v: x + v))
            pieces = F.arrays_zip(before.alias("b"), F.slice(mass, 2, len(b) - 3).alias("m"), literal(list(b[1:-2])).alias("lo"), literal(list(b[2:-1])).alias("hi"))
            found = F.get(F.filter(pieces, lambda p: (p["m"] > 0) & (p["b"] + p["m"] >= a)), F.lit(0))
            inside = let(found, lambda x: F.when(x.isNull(), right).otherwise(x["lo"] + (x["hi"] - x["lo"]) * (a - x["b"]) / x["m"]))
            return F.when(a < first, left).when(1 - a < last, right).otherwise(inside)

        return let(mass, lambda m: let(a, lambda a: of(m, a)))

    def nll(self, mass: Column, y: Column) -> Column:
        """-ln density at any y."""
        (s, t), b = self.scales, self.borders
        normal = lambda d, scale: F.lit(0.5 * math.log(2 / math.pi) - math.log(scale)) - F.pow(F.greatest(d, F.lit(1e-8)) / F.lit(scale), 2) / 2
        widths = [hi - lo for lo, hi in zip(b, b[1:])]

        def of(y: Column, k: Column) -> Column:
            log = F.ln(F.get(mass, k)) - F.when(k == 0, -normal(F.lit(b[1]) - y, s)).when(k == len(b) - 2, -normal(y - F.lit(b[-2]), t)).otherwise(F.ln(F.get(literal(widths), k)))
            return -log

        place = lambda y: F.greatest(F.lit(0), F.least(F.lit(len(b) - 2), F.size(F.filter(literal(list(b)), lambda x: x < y)) - 1))
        return let(y, lambda y: let(place(y), lambda k: of(y, k)))

    def drawn(self, mass: Column, seed: int, stream: str, *row: Column | str) -> Column:
        return let(uniform(seed, stream, *row), lambda u: self.inverse(mass, _between(u, 1e-7, 1 - 1e-7)))


@dataclass(frozen=True)
class Repaired:
    """Borders in ascending order, which buckets of the order given lose their mass, and whether that order was descending."""

    borders: tuple[float, ...]
    cancelled: tuple[bool, ...]
    descending: bool

    def mass(self, mass: Column) -> Column:
        """The mass on the repaired borders: none in cancelled buckets, the rest in proportion, in their order. Null where nothing is left."""
        kept = F.zip_with(mass, F.array(*(F.lit(0.0 if c else 1.0) for c in self.cancelled)), lambda p, k: p * k)
        scaled = F.when(total(kept) > 0, F.transform(kept, lambda p: p / total(kept)))
        return F.reverse(scaled) if self.descending else scaled


def repaired_borders(borders: Sequence[float], cancel: bool = True) -> Repaired:
    """Borders after a transform made sound again.

    With cancel, borders that aren't finite or lie beyond BORDER_LIMITS, which must be the first or last ones,
    become the nearest sound one, the outermost one away from it, and their buckets lose their mass; without it,
    NaN at the end becomes the largest border, the last one twice that. Then a last border that isn't above the one
    before, as in descending ones, moves up by a tenth of itself, a first one that equals the next moves down
    likewise, and descending ones are reversed.
    """
    b = [float(x) for x in borders]
    broken = [not math.isfinite(x) or x > BORDER_LIMITS[1] or x < BORDER_LIMITS[0] for x in b]
    cancelled = [False] * (len(b) - 1)
    if cancel and any(broken):
        sound = [i for i, x in enumerate(broken) if not x]
        if not sound or any(broken[sound[0] : sound[-1] + 1]):
            raise ValueError("broken borders must be the first or last ones")
        lo, hi = sound[0], sound[-1]
        cancelled = [x or y for x, y in zip(broken, broken[1:])]
        b = [b[lo]] * lo + b[lo : hi + 1] + [b[hi]] * (len(b) - 1 - hi)
        if lo:
            b[0] = b[1] - 1.0
        if hi < len(b) - 1:
            b[-1] = b[-2] + 1.0
    if math.isnan(b[-1]):
        largest = max(x for x in b if not math.isnan(x))
        b = [largest if math.isnan(x) else x for x in b]
        b[-1] += abs(b[-1])
    if b[-1] - b[-2] < 1e-6:
        b[-1] += abs(b[-1] * 0.1)
    if b[0] == b[1]:
        b[0] -= abs(b[0] * 0.1)
    descending = all(x > y for x, y in zip(b, b[1:]))
    return Repaired(tuple(b[::-1] if descending else b), tuple(cancelled), descending)
