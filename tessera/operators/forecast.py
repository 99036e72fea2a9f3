"""Models a series: the context of an item and a part of its future meet in one call with a fixed, checked result; quantiles of several members are averaged in the target's own scale.

A long horizon is cut into parts, each with the item's context, so an item is as many tasks as
its future has parts; the context is cut to its last rows before anything meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import numbered_within
from tessera.operators.series import Series

#: (context rows, future rows, levels) -> {"target": an array, and one a level}, as long as the future rows. Rows are in time order; future rows have `step`, their place from 1 in the item's whole future.
Model = Callable[[pd.DataFrame, pd.DataFrame, Sequence[float]], dict]


def covariates(context: DataFrame, future: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with the keys they have and the further columns that are in both, in the context's order, and the names of these."""
    shared = [c for c in context.columns if c in future.columns and c not in keys]
    return context.select(*(k for k in keys if k in context.columns), *shared), future.select(*(k for k in keys if k in future.columns), *shared), shared


def future_rows(future: DataFrame, target: str) -> DataFrame:
    """future without its target, which must be null where there is one."""
    if target in future.columns:
        if not future.where(F.col(target).isNotNull()).isEmpty():
            raise ValueError(f"{target} must be null in the future")
        future = future.drop(target)
    return future


def _placed(df: DataFrame, item: str, time: str, into: str, falling: bool = False) -> DataFrame:
    """df with the place of a row within its item in time order; a long item is dealt out."""
    seconds = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    return numbered_within(df.withColumn("__t", -seconds if falling else seconds), [item], ["__t", time], into).drop("__t")


def checked(found: object, levels: Sequence[float], rows: int) -> dict:
    """What a model returned, or an error that says what is wrong with it."""
    if not isinstance(found, dict) or "target" not in found:
        raise ValueError("a series model must return a dict with a target")
    for name in ["target", *levels]:
        if name not in found:
            raise ValueError(f"a series model must return level {name}")
        if np.shape(found[name]) != (rows,):
            raise ValueError(f"{name} of a series model has shape {np.shape(found[name])}, not ({rows},)")
    return found


def forecast(context: Series, future: DataFrame, model: Model, levels: Sequence[float], *, most: int = 4096, part: int = 1024) -> DataFrame:
    """item, time, target and quantiles (an array in the order of levels) for every row of future.

    The context of an item is its last `most` rows with a target (see Series.imputed_target); items of the
    context alone give nothing, items of the future alone meet an empty context. Columns that only one
    side has are left out. A wrong result of the model raises.
    """
    item, time, target = context.item, context.time, context.target
    rows = future_rows(future, target)
    known = context.imputed_target().df
    past, ahead, shared = covariates(known.withColumn("__y", F.col(target)).drop(target), rows, [item, time, "__y"])
    past = _placed(past, item, time, "__back", falling=True).where(F.col("__back") <= most).drop("__back")
    ahead = _placed(ahead, item, time, "step").withColumn("__part", F.floor((F.col("step") - 1) / part))
    parts = ahead.select(item, "__part").distinct()
    past = past.join(parts, item)  # an item's context, once for each part of its future
    kinds = dict(future.dtypes)
    levels = [float(a) for a in levels]
    # both sides in one stream of sorted rows, each side's columns under names of its own; a task takes one item after the other
    mine = lambda df, kind, step, own: df.select(F.col(item).alias("__item"), F.col("__part").cast("long").alias("__part"), F.lit(kind).alias("__kind"), step.cast("long").alias("__step"), F.col(time).alias("__time"), *own)
    left_names, right_names = [target, *shared], list(shared)
    lefts = mine(past, 0, F.lit(0), [F.col(c).alias(f"__l{i}") for i, c in enumerate(["__y", *shared])])
    rights = mine(ahead, 1, F.col("step"), [F.col(c).alias(f"__r{i}") for i, c in enumerate(shared)])
    tasks = int(past.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lefts.unionByName(rights, allowMissingColumns=True).repartition(tasks, "__item", "__part")
    rows = rows.sortWithinPartitions("__item", "__part", "__kind", "__step", F.asc_nulls_last("__time"))

    def side(rows: pa.Table, names: dict[str, str]) -> pd.DataFrame:
        found = rows.select(list(names)).rename_columns(list(names.values())).to_pandas()
        for c in found.columns:
            if isinstance(found[c].dtype, pd.DatetimeTZDtype):
                found[c] = found[c].dt.tz_localize(None)
        return found

    def modelled(rows: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        right_rows = rows["__kind"].to_numpy() == 1
        if not right_rows.any():
            return
        ahead = rows.filter(pa.array(right_rows))
        left = side(rows.filter(pa.array(~right_rows)), {"__time": time, **{f"__l{i}": c for i, c in enumerate(left_names)}})
        right = side(ahead, {"__step": "step", "__time": time, **{f"__r{i}": c for i, c in enumerate(right_names)}})
        own, asked = run[~right_rows], run[right_rows]
        starts = np.flatnonzero(np.append(True, asked[1:] != asked[:-1]))
        targets, quantiles = [], []
        for a, b in zip(starts, np.append(starts[1:], len(asked))):
            x, y = np.searchsorted(own, asked[a]), np.searchsorted(own, asked[a], "right")
            found = checked(model(left.iloc[x:y].reset_index(drop=True), right.iloc[a:b].reset_index(drop=True), levels), levels, b - a)
            targets.append(np.asarray(found["target"], dtype=float))
            quantiles.append(np.stack([np.asarray(found[q], dtype=float) for q in levels], axis=1) if levels else np.zeros((b - a, 0)))
        lists = pa.ListArray.from_arrays(np.arange(len(asked) + 1, dtype=np.int32) * len(levels), np.concatenate(quantiles).ravel())
        yield from pa.table({item: ahead["__item"], time: ahead["__time"], "target": np.concatenate(targets), "quantiles": lists}).to_batches()

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last item and part so far, of `most` and `part` rows at most
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(rows):
                continue
            code = rows["__item"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            number = rows["__part"].to_numpy()
            run = np.cumsum(np.append(0, (code[1:] != code[:-1]) | (number[1:] != number[:-1])))
            last = int(np.searchsorted(run, run[-1]))
            if last:
                yield from modelled(rows.slice(0, last), run[:last])
            held = rows.slice(last)
        if held is not None:
            yield from modelled(held, np.zeros(len(held), dtype=int))

    out = rows.mapInArrow(stream, f"`{item}` {kinds[item]}, `{time}` {kinds[time]}, target double, quantiles array<double>")
    plain = lambda x: F.when(~F.isnan(x), x)
    return out.select(item, time, plain(F.col("target")).alias("target"), F.transform("quantiles", plain).alias("quantiles"))


def seasonal_naive(season: int, target: str = "target") -> Model:
    """The value a season before, and that plus the quantiles of past changes over a season. Contexts shorter than a season repeat their last value; an empty one gives nulls."""

    def predict(past: pd.DataFrame, ahead: pd.DataFrame, levels: Sequence[float]) -> dict:
        y, steps = past[target].to_numpy(dtype=float), ahead["step"].to_numpy()
        if not len(y):
            return {name: np.full(len(steps), np.nan) for name in ["target", *levels]}
        last = y[-season:] if len(y) >= season else y[-1:]
        point = last[(steps - 1) % len(last)]
        changes = y[season:] - y[:-season] if len(y) > season else np.zeros(1)
        return {"target": point} | {a: point + np.quantile(changes, a) for a in levels}

    return predict


def averaged(members: Sequence[DataFrame], item: str, time: str, scales: DataFrame | None = None) -> DataFrame:
    """Mean target and quantiles of members that forecast the same rows, each brought back by its own scale first: scales has member (its place from 0), item, mean and scale; without it members are in the target's scale. Quantiles ascend; a level that a member lacks counts for the others."""
    every = None
    for i, m in enumerate(members):
        own = m.select(item, time, "target", "quantiles", F.lit(i).alias("member"))
        every = own if every is None else every.unionByName(own)
    if scales is not None:
        every = every.join(scales, [item, "member"])
        back = lambda x: x * F.col("scale") + F.col("mean")
        every = every.withColumns({"target": back(F.col("target")), "quantiles": F.transform("quantiles", back)})
    long = every.select(item, time, "target", F.posexplode_outer("quantiles").alias("k", "q"))
    means = long.groupBy(item, time, "k").agg(F.avg("q").alias("q"), F.avg("target").alias("target"))
    return means.groupBy(item, time).agg(F.first("target").alias("target"), F.array_sort(F.collect_list("q")).alias("quantiles"))
