"""One encoding of a mixed table with its exact inverse: numbers scaled by metadata or by what was fitted, categories as one-hot blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """A column: a number with its offset and width, or a category (levels) whose block has an entry a level."""

    name: str
    offset: float = 0.0
    width: float = 1.0
    levels: tuple = ()


@dataclass(frozen=True)
class MixedScaler:
    """Features in the table's order. Encoded arrays hold the numbers first, then the blocks, as they follow each other."""

    features: tuple[Feature, ...]
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self) -> None:
        if self.low >= self.high:
            raise ValueError("low must be less than high")

    @staticmethod
    def from_metadata(rows: Sequence[dict], how: str = "min_max", one_hot: bool = True, low: float = 0.0, high: float = 1.0) -> MixedScaler:
        """From rows with feature, type (real, int or cat), min and max (min_max; levels of categories), mean and std (standard). A width of zero counts as 1; without one_hot categories stay as they are."""
        out = []
        for r in rows:
            if r["type"] == "cat":
                out.append(Feature(r["feature"], levels=tuple(range(int(r["min"]), int(r["max"]) + 1))) if one_hot else Feature(r["feature"]))
            elif how == "min_max":
                out.append(Feature(r["feature"], float(r["min"]), float(r["max"]) - float(r["min"]) or 1.0))
            elif how == "standard":
                out.append(Feature(r["feature"], float(r["mean"]), float(r["std"]) or 1.0))
            elif how == "none":
                out.append(Feature(r["feature"]))
            else:
                raise ValueError(f"unknown scaling {how!r}")
        return MixedScaler(tuple(out), *((low, high) if how == "min_max" else (0.0, 1.0)))

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], categories: Sequence[str], how: str = "min_max", one_hot: bool = True, low: float = 0.0, high: float = 1.0, most: int = 1000) -> MixedScaler:
        """From the table itself: one aggregate for the numbers, the distinct levels of each category, `most` at most."""
        numbers = [c for c in columns if c not in categories]
        row = df.agg(F.lit(0).alias("none"), *(e for i, c in enumerate(numbers) for e in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")))).first()
        known = {c: {"feature": c, "type": "real", "min": row[f"a{i}"] or 0.0, "max": row[f"b{i}"] or 0.0, "mean": row[f"m{i}"] or 0.0, "std": row[f"s{i}"] or 0.0} for i, c in enumerate(numbers)}
        plain = {f.name: f for f in MixedScaler.from_metadata([known[c] for c in numbers], how).features}
        for c in columns:
            if c in categories:
                found = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()] if one_hot else []
                if len(found) > most:
                    raise ValueError(f"{c} has more than {most} categories")
                plain[c] = Feature(c, levels=tuple(sorted(found)))
        return MixedScaler(tuple(plain[c] for c in columns), *((low, high) if how == "min_max" else (0.0, 1.0)))

    @property
    def numbers(self) -> list[Feature]:
        return [f for f in self.features if not f.levels]

    @property
    def blocks(self) -> list[tuple[Feature, int]]:
        """Categories and where their blocks start, from 0."""
        at, out = len(self.numbers), []
        for f in self.features:
            if f.levels:
                out.append((f, at))
                at += len(f.levels)
        return out

    @property
    def size(self) -> int:
        return len(self.numbers) + sum(len(f.levels) for f in self.features)

    def encoded(self) -> Column:
        """The array of a row. Null numbers are null entries; null and unknown categories are blocks of zeros."""
        numbers = [(F.col(f.name).cast("double") - F.lit(f.offset)) / F.lit(f.width) * F.lit(self.high - self.low) + F.lit(self.low) for f in self.numbers]
        blocks = [F.when(F.col(f.name) == F.lit(v), 1.0).otherwise(0.0) for f, _ in self.blocks for v in f.levels]
        return F.array(*numbers, *blocks)

    def decoded(self, array: Column) -> dict[str, Column]:
        """The columns of an encoded array by name: numbers scaled back, of each block the level with the largest entry, the first of equals; null where a block has no entry above zero."""
        out = {f.name: (F.get(array, F.lit(i)) - F.lit(self.low)) / F.lit(self.high - self.low) * F.lit(f.width) + F.lit(f.offset) for i, f in enumerate(self.numbers)}
        for f, at in self.blocks:
            block = F.slice(array, at + 1, len(f.levels))
            top = F.array_max(block)
            out[f.name] = F.when(top > 0, F.get(F.array(*map(F.lit, f.levels)), F.array_position(block, top).cast("int") - 1))
        return {f.name: out[f.name] for f in self.features}

    def mask(self, flags: dict[str, bool]) -> list[bool]:
        """A flag a column as a flag an entry of the array."""
        return [flags[f.name] for f in self.numbers] + [flags[f.name] for f, _ in self.blocks for _ in f.levels]
