"""A small language of row constraints, compiled to Spark columns.

Values are built from Const and Feature with the usual operators, SafeDivision and Log;
constraints compare values and combine with `&`, `|` and Count. A constraint compiles to
its violation: a double that is 0 where it holds and grows with the distance from holding.
A missing operand makes the violation NULL. Divisions follow floating point rules, since
an ANSI session would raise on a zero divisor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce, singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Margin of a strict comparison, tolerance of bounds, of wide tables, and of relations.
STRICT_MARGIN = 2e-6
BOUND_MARGIN = 1.1920929e-07
WIDE_COLUMNS, WIDE_FACTOR = 108, 1000
INF = float("inf")


class Value:
    """An expression of numbers."""

    def __add__(self, other: object) -> Value:
        parts = self.parts if isinstance(self, Sum) else (self,)
        return Sum((*parts, value(other)))

    def __radd__(self, other: object) -> Value:
        return value(other) + self

    def __sub__(self, other: object) -> Value:
        return Arithmetic("-", self, value(other))

    def __rsub__(self, other: object) -> Value:
        return Arithmetic("-", value(other), self)

    def __mul__(self, other: object) -> Value:
        return Arithmetic("*", self, value(other))

    def __rmul__(self, other: object) -> Value:
        return Arithmetic("*", value(other), self)

    def __truediv__(self, other: object) -> Value:
        return Arithmetic("/", self, value(other))

    def __rtruediv__(self, other: object) -> Value:
        return Arithmetic("/", value(other), self)

    def __pow__(self, other: object) -> Value:
        return Arithmetic("**", self, value(other))

    def __mod__(self, other: object) -> Value:
        return Arithmetic("%", self, value(other))

    def __le__(self, other: object) -> Constraint:
        return Compare("<=", self, value(other))

    def __lt__(self, other: object) -> Constraint:
        return Compare("<", self, value(other))

    def __ge__(self, other: object) -> Constraint:
        return Compare("<=", value(other), self)

    def __gt__(self, other: object) -> Constraint:
        return Compare("<", value(other), self)

    def equals(self, other: object, tolerance: float = 0.0) -> Constraint:
        return Compare("==", self, value(other), tolerance)


class Constraint:
    """A condition on a row."""

    def __and__(self, other: Constraint) -> Constraint:
        return All((*(self.parts if isinstance(self, All) else (self,)), other))

    def __or__(self, other: Constraint) -> Constraint:
        return AnyOf((*(self.parts if isinstance(self, AnyOf) else (self,)), other))


@dataclass(frozen=True)
class Const(Value):
    number: float


@dataclass(frozen=True)
class Feature(Value):
    """A column by name, or by position among the features."""

    key: str | int


@dataclass(frozen=True)
class Arithmetic(Value):
    sign: str
    left: Value
    right: Value


@dataclass(frozen=True)
class Sum(Value):
    parts: tuple[Value, ...]


@dataclass(frozen=True)
class SafeDivision(Value):
    """left / right, or `otherwise` where right is 0."""

    left: Value
    right: Value
    otherwise: Value


@dataclass(frozen=True)
class Log(Value):
    """The natural logarithm; with `otherwise`, that where the argument isn't positive."""

    argument: Value
    otherwise: Value | None = None


@dataclass(frozen=True)
class Compare(Constraint):
    sign: str
    left: Value
    right: Value
    tolerance: float = 0.0


@dataclass(frozen=True)
class All(Constraint):
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class AnyOf(Constraint):
    parts: tuple[Constraint, ...]


@dataclass(frozen=True)
class Count(Value):
    """How many of the constraints hold or, inverse, don't."""

    parts: tuple[Constraint, ...]
    inverse: bool = False


def value(x: object) -> Value:
    return x if isinstance(x, Value) else Const(float(x))


@singledispatch
def compiled(node: object, names: Sequence[str]) -> Column:
    """The column of a value, or of a constraint's violation; names are the features in order."""
    raise TypeError(f"not an expression: {node!r}")


@compiled.register
def _(node: Const, names: Sequence[str]) -> Column:
    return F.lit(float(node.number))


@compiled.register
def _(node: Feature, names: Sequence[str]) -> Column:
    name = names[node.key] if isinstance(node.key, int) else node.key
    if name not in names:
        raise KeyError(f"no feature {name!r}")
    return F.col(name).cast("double")


def ieee_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull() & b.isNotNull(), F.lit(float("nan")))


@compiled.register
def _(node: Arithmetic, names: Sequence[str]) -> Column:
    a, b = compiled(node.left, names), compiled(node.right, names)
    if node.sign == "/":
        return ieee_divide(a, b)
    if node.sign == "%":  # the sign of the divisor
        return F.when(b != 0, a - b * F.floor(a / F.when(b != 0, b))).when(a.isNotNull() & b.isNotNull(), F.lit(float("nan")))
    return {"-": lambda: a - b, "*": lambda: a * b, "**": lambda: F.pow(a, b)}[node.sign]()


@compiled.register
def _(node: Sum, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (compiled(p, names) for p in node.parts))


@compiled.register
def _(node: SafeDivision, names: Sequence[str]) -> Column:
    a, b = compiled(node.left, names), compiled(node.right, names)
    return F.when(b.isNotNull(), F.when(b != 0, a / F.when(b != 0, b)).otherwise(compiled(node.otherwise, names)))


@compiled.register
def _(node: Log, names: Sequence[str]) -> Column:
    x = compiled(node.argument, names)
    low = F.when(x == 0, F.lit(-INF)).otherwise(F.lit(float("nan"))) if node.otherwise is None else compiled(node.otherwise, names)
    return F.when(x.isNotNull(), F.when(x > 0, F.ln(F.when(x > 0, x))).otherwise(low))


def _positive(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


@compiled.register
def _(node: Compare, names: Sequence[str]) -> Column:
    gap = compiled(node.left, names) - compiled(node.right, names)
    if node.sign == "==":
        return _positive(F.abs(gap) - F.lit(float(node.tolerance)))
    return _positive(gap + F.lit(STRICT_MARGIN)) if node.sign == "<" else _positive(gap)


@compiled.register
def _(node: All, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (compiled(p, names) for p in node.parts))


@compiled.register
def _(node: AnyOf, names: Sequence[str]) -> Column:
    parts = [compiled(p, names) for p in node.parts]
    known = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
    return F.when(known, F.least(*parts)) if len(parts) > 1 else parts[0]


@compiled.register
def _(node: Count, names: Sequence[str]) -> Column:
    parts = [compiled(p, names) for p in node.parts]
    hit = [(p != 0) if node.inverse else (p == 0) for p in parts]
    return reduce(lambda a, b: a + b, (F.when(p.isNotNull(), F.when(h, 1.0).otherwise(0.0)) for p, h in zip(parts, hit, strict=True)))


@singledispatch
def printed(node: object) -> str:
    """The text of an expression, features as F(key)."""
    raise TypeError(f"not an expression: {node!r}")


@printed.register
def _(node: Const) -> str:
    return f"{node.number:g}"


@printed.register
def _(node: Feature) -> str:
    return f"F({node.key})"


@printed.register
def _(node: Arithmetic) -> str:
    return f"({printed(node.left)} {node.sign} {printed(node.right)})"


@printed.register
def _(node: Sum) -> str:
    return f"({' + '.join(map(printed, node.parts))})"


@printed.register
def _(node: SafeDivision) -> str:
    return f"({printed(node.left)} / {printed(node.right)} or {printed(node.otherwise)})"


@printed.register
def _(node: Log) -> str:
    return f"ln({printed(node.argument)})"


@printed.register
def _(node: Compare) -> str:
    return f"({printed(node.left)} {node.sign} {printed(node.right)}{f' within {node.tolerance:g}' if node.tolerance else ''})"


@printed.register
def _(node: All) -> str:
    return f"({' AND '.join(map(printed, node.parts))})"


@printed.register
def _(node: AnyOf) -> str:
    return f"({' OR '.join(map(printed, node.parts))})"


@printed.register
def _(node: Count) -> str:
    return f"count{' violated' if node.inverse else ''}({', '.join(map(printed, node.parts))})"


@dataclass(frozen=True)
class FeatureInfo:
    """What is known of a feature: kind is real, int or cat; a bound of None is the row's own value, so it always holds."""

    name: str
    kind: str = "real"
    mutable: bool = True
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Rules:
    """Constraints of a table: its features in order, and relations between them."""

    features: tuple[FeatureInfo, ...]
    relations: tuple[Constraint, ...] = ()
    tolerance: float = 0.0

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def violation(self) -> Column:
        """Sum of the violations of all relations, in groups so that wide rule sets stay within a method's size."""
        parts = [compiled(r, self.names) for r in self.relations]
        groups = [reduce(lambda a, b: a + b, parts[i : i + 32]) for i in range(0, len(parts), 32)]
        return reduce(lambda a, b: a + b, groups) if groups else F.lit(0.0)

    def relations_hold(self) -> Column:
        return F.coalesce(self.violation() <= F.lit(self.tolerance), F.lit(False))

    def bounds_hold(self) -> Column:
        margin = BOUND_MARGIN * (WIDE_FACTOR if len(self.features) == WIDE_COLUMNS else 1)
        tests = [F.col(f.name) >= F.lit(f.low - margin) for f in self.features if f.low is not None] + [F.col(f.name) <= F.lit(f.high + margin) for f in self.features if f.high is not None]
        return _conjunction(tests)

    def types_hold(self) -> Column:
        return _conjunction([F.col(f.name) == F.rint(F.col(f.name).cast("double")) for f in self.features if f.kind != "real"])

    def unchanged(self, original: str) -> Column:
        """Immutable features equal those of the row before, whose columns begin with `original`."""
        return _conjunction([F.col(f.name).eqNullSafe(F.col(original + f.name)) for f in self.features if not f.mutable])

    def valid(self, original: str | None = None) -> Column:
        parts = [self.relations_hold(), self.bounds_hold(), self.types_hold()]
        return _conjunction(parts + ([self.unchanged(original)] if original is not None else []))

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(self.relations_hold())


def _conjunction(parts: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False)) if parts else F.lit(True)


def guarded_fix(df: DataFrame, fixes: Sequence[tuple[Constraint | None, Feature, Value]], names: Sequence[str]) -> DataFrame:
    """In turn, for each (guard, feature, expression): the feature becomes the expression where the guard is violated, or everywhere without a guard."""
    for guard, target, expression in fixes:
        name = names[target.key] if isinstance(target.key, int) else target.key
        new = compiled(expression, names)
        df = df.withColumn(name, new if guard is None else F.when(compiled(guard, names) > 0, new).otherwise(F.col(name).cast("double")))
    return df


def equality_fixes(relations: Sequence[Constraint]) -> list[tuple[None, Feature, Value]]:
    """The fixes that equalities `Feature == expression` stand for."""
    return [(None, r.left, r.right) for r in relations if isinstance(r, Compare) and r.sign == "==" and isinstance(r.left, Feature)]


def type_repair(rules: Rules, original: str) -> dict[str, Column]:
    """Columns that bring changed rows back to their types: integers move by whole steps from the original, categories round to the nearest, immutable features return. Without any integer feature the types stay as they are."""
    whole = any(f.kind == "int" for f in rules.features)
    out = {}
    for f in rules.features:
        new, old = F.col(f.name).cast("double"), F.col(original + f.name).cast("double")
        if whole and f.kind == "int":
            new = old + F.signum(new - old) * F.floor(F.abs(new - old))
        elif whole and f.kind == "cat":
            new = F.rint(new)
        out[f.name] = new if f.mutable else old
    return out


def budgeted_repair(rules: Rules, original: str, scale: dict[str, float], budget: float, rounds: int = 6, shrink: float = 0.9) -> dict[str, Column]:
    """Columns after at most `rounds` steps that draw a row back towards its original until the scaled distance, types repaired, lies within the budget; a row that never does returns to its original."""
    names = [f.name for f in rules.features if f.mutable]
    kinds = {f.name: f.kind for f in rules.features}
    old = {n: F.col(original + n).cast("double") for n in names}
    delta = {n: F.col(n).cast("double") - old[n] for n in names}
    norm = lambda d: F.sqrt(reduce(lambda a, b: a + b, (F.pow(d[n] / F.lit(scale[n]), 2) for n in names)))
    length = norm(delta)
    first = F.when(length > budget, F.lit(budget) / F.when(length > 0, length)).otherwise(1.0)
    tried = []
    for k in range(rounds):
        step = {n: delta[n] * first * F.lit(shrink**k) for n in names}
        fixed = {n: F.signum(step[n]) * F.floor(F.abs(step[n])) if kinds[n] == "int" else F.rint(old[n] + step[n]) - old[n] if kinds[n] == "cat" else step[n] for n in names}
        tried.append((norm(fixed) <= budget + 1e-9, fixed))
    out = {f.name: F.col(original + f.name).cast("double") for f in rules.features}
    for n in names:
        found = F.lit(0.0)
        for fits, fixed in reversed(tried):
            found = F.when(fits, fixed[n]).otherwise(found)
        out[n] = old[n] + found
    return out
