"""Periods of series by their spectrum: one task a series, with numpy, and a long series in parts.

A transform of N1 * N2 places is N1 transforms over every N1-th value, turned by a factor each, then N2
transforms over these: both steps are groups of some of them, so no task has more than a few hundred thousand numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.loops import cut
from tessera.operators.ranks import NUMBER, numbered_within

#: Rows at most of a series that one task has.
LONG = 1 << 17
#: About as many numbers are transformed together.
TOGETHER = 1 << 17


def find_periods(y: np.ndarray, top: int = 3, least: float = 0.05, pad: int = 2) -> list[tuple[int, float]]:
    """(period, magnitude) of the strongest peaks of the spectrum of a detrended, windowed, zero-padded series, at least `least` of the highest, whole periods above 1 and up to half the length, each once."""
    y = y[np.isfinite(y)]
    n = len(y)
    if n < 4:
        return []
    x = np.arange(n)
    y = y - np.polyval(np.polyfit(x, y, 1), x)
    size = 1 << int(np.ceil(np.log2(n * pad)))
    spectrum = np.abs(np.fft.rfft(y * np.hanning(n), size))
    spectrum[0] = 0
    inner = np.flatnonzero((spectrum[1:-1] > spectrum[:-2]) & (spectrum[1:-1] >= spectrum[2:])) + 1
    inner = inner[spectrum[inner] >= least * spectrum.max()] if spectrum.max() > 0 else inner[:0]
    found: list[tuple[int, float]] = []
    for k in inner[np.argsort(-spectrum[inner], kind="stable")]:
        period = int(round(size / k))
        if 1 < period <= n // 2 and period not in [p for p, _ in found]:
            found.append((period, float(spectrum[k])))
        if len(found) == top:
            break
    return found


def _parts(n: int, pad: int = 2) -> tuple[int, int, int, int, int]:
    """Of a series of n values: the padded length, its factors N1 and N2, and how many transforms of the first and the second step are a group."""
    bits = int(np.ceil(np.log2(n * pad)))
    second = 1 << (bits // 2)
    first = (1 << bits) // second
    return 1 << bits, first, second, min(first, max(1, TOGETHER // second)), max(2, TOGETHER // first)


def _transformed(z: np.ndarray, i: np.ndarray, n: int, group: int) -> list[tuple[int, bytes]]:
    """The first step for a group of residues modulo N1: (block, numbers) for each block of the second step, with a column more on each side."""
    size, first, second, wide, block = _parts(n)
    m = np.zeros((wide, second))
    m[i % first - group * wide, i // first] = z
    residues, columns = np.arange(wide) + group * wide, np.arange(second // 2 + 1)
    f = np.fft.rfft(m, axis=1) * np.exp(-2j * np.pi * (np.outer(residues, columns) / size))
    return [(b, f[:, max(0, b * block - 1) : b * block + block + 1].tobytes()) for b in range(-(-len(columns) // block))]


def _peaks(pieces: dict[int, bytes], n: int, block: int, top: int) -> tuple[float, list[tuple[int, int, float]]]:
    """The second step for a block: its largest magnitude, and place, period and magnitude of the strongest peak of each of its `top` strongest periods."""
    size, first, second, wide, step = _parts(n)
    half, start = second // 2, block * step
    stop = min(start + step, half + 1)
    low, high = max(0, start - 1), min(stop + 1, half + 1)
    m = np.zeros((first, high - low), dtype=complex)
    for group, z in pieces.items():
        m[group * wide : (group + 1) * wide] = np.frombuffer(z, dtype=complex).reshape(wide, -1)
    m = np.abs(np.fft.fft(m, axis=0))
    if low == 0:
        m[0, 0] = 0
    turned = -np.arange(first) % first
    # magnitudes of k and size - k are equal, which gives the columns beyond either end
    below = m[turned, 1 - low][:, None] if start == 0 else m[:, :0]
    above = m[::-1, half - 1 - low][:, None] if stop == half + 1 else m[:, :0]
    m = np.hstack([below, m, above])
    own, left, right = m[:, 1:-1], m[:, :-2], m[:, 2:]
    columns = np.arange(start, stop)
    k = columns + second * np.arange(first)[:, None]
    mirrored = k > size // 2
    left, right = np.where(mirrored, right, left), np.where(mirrored, left, right)
    once = ~(mirrored & ((columns == 0) | (columns == half)))
    place = np.where(mirrored, size - k, k)
    is_peak = once & (place >= 1) & (place < size // 2) & (own > left) & (own >= right)
    place, strength = place[is_peak], own[is_peak]
    period = np.rint(size / place).astype(np.int64)
    fits = (period > 1) & (period <= n // 2)
    place, strength, period = place[fits], strength[fits], period[fits]
    found: dict[int, tuple[int, int, float]] = {}
    for j in np.lexsort((place, -strength)):
        if int(period[j]) not in found:
            found[int(period[j])] = (int(place[j]), int(period[j]), float(strength[j]))
            if len(found) == top:
                break
    return float(own.max()), list(found.values())


def _placed(df: DataFrame, item: str, time: str, into: str) -> DataFrame:
    """df with the place from 1 of a row in its series, rows without a time last; a long series is dealt out."""
    number = F.col(time) if NUMBER.match(dict(df.dtypes)[time]) else F.unix_micros(F.col(time).cast("timestamp"))
    return numbered_within(df.withColumn("__t", F.coalesce(number.cast("double"), F.lit(float("inf")))), [item], ["__t", time], into).drop("__t")


def _by_length(df: DataFrame, item: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of series that one task can have, and those of longer ones, if there are any. There are few of these, as each has more than LONG rows."""
    long = df.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > LONG).select(F.col(item).alias("__item"), F.lit(True).alias("__long"))
    if long.isEmpty():
        return df, None
    marked = df.join(F.broadcast(long), F.col(item).eqNullSafe(F.col("__item")), "left").drop("__item")
    return marked.where("__long is null").drop("__long"), marked.where("__long").drop("__long")


def _long_periods(df: DataFrame, item: str, time: str, target: str, top: int, least: float = 0.05) -> DataFrame:
    """periods() of long series, in parts."""
    kind = dict(df.dtypes)[item]
    y = F.col(target).cast("double")
    finite = df.select(F.col(item).alias("item"), F.col(time).alias("time"), y.alias("y")).where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    rows = cut(_placed(finite, "item", "time", "place").select("item", (F.col("place") - 1).alias("i"), "y"))
    line = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.sum(F.col("i") * F.col("y")).alias("iy")).where("n >= 4")
    n = F.col("n").cast("double")
    slope = (F.col("iy") - (n - 1) / 2 * F.col("mean") * n) / (n * (n * n - 1) / 12)
    line = line.select(F.col("item").alias("__item"), "n", "mean", slope.alias("slope"))
    # the factors of each length, as in _parts
    bits = F.ceil(F.log2(n * 2)).cast("int")
    second = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    first = F.pow(F.lit(2.0), bits - F.floor(bits / 2)).cast("long")
    wide = F.least(first, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(TOGETHER) / second)))
    line = line.withColumns({"first": first, "wide": wide})
    parted = rows.join(F.broadcast(line), F.col("item").eqNullSafe(F.col("__item"))).drop("__item")
    parted = parted.withColumn("part", F.floor(F.col("i") % F.col("first") / F.col("wide")).cast("int")).drop("first", "wide")

    def first_step(rows: pd.DataFrame) -> pd.DataFrame:
        r, i = rows.iloc[0], rows["i"].to_numpy()
        n, part = int(r["n"]), int(r["part"])
        z = rows["y"].to_numpy() - (r["mean"] + r["slope"] * (i - (n - 1) / 2))
        out = pd.DataFrame(_transformed(z * (0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1))), i, n, part), columns=["block", "z"])
        return out.assign(item=rows["item"].iloc[0], n=n, part=part)[["item", "n", "block", "part", "z"]]

    def second_step(rows: pd.DataFrame) -> pd.DataFrame:
        n, block = int(rows["n"].iloc[0]), int(rows["block"].iloc[0])
        highest, found = _peaks(dict(zip(rows["part"], rows["z"])), n, block, top)
        out = pd.DataFrame([(highest, k, p, m) for k, p, m in found] or [(highest, None, None, None)], columns=["highest", "k", "period", "magnitude"])
        return out.assign(item=rows["item"].iloc[0]).astype({"k": "Int64", "period": "Int64"})[["item", "highest", "k", "period", "magnitude"]]

    turned = parted.groupBy("item", "part").applyInPandas(first_step, f"item {kind}, n long, block int, part int, z binary")
    peaks = turned.groupBy("item", "block").applyInPandas(second_step, f"item {kind}, highest double, k long, period int, magnitude double")
    own = Window.partitionBy("item")  # some rows a block
    strongest = peaks.withColumn("highest", F.max("highest").over(own)).where(F.col("magnitude") >= least * F.col("highest"))
    each = strongest.withColumn("r", F.row_number().over(Window.partitionBy("item", "period").orderBy(F.desc("magnitude"), "k"))).where("r = 1")
    ranked = each.withColumn("rank", F.row_number().over(own.orderBy(F.desc("magnitude"), "k"))).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(item), "rank", "period", "magnitude")


def periods(df: DataFrame, item: str, time: str, target: str, top: int = 3) -> DataFrame:
    """item, rank, period, magnitude."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time)
        found = find_periods(rows[target].to_numpy(dtype=float), top)
        return pd.DataFrame([(rows[item].iloc[0], k + 1, p, m) for k, (p, m) in enumerate(found)], columns=[item, "rank", "period", "magnitude"])

    kind = dict(df.dtypes)[item]
    short, long = _by_length(df.select(item, time, target), item)
    found = short.groupBy(item).applyInPandas(one, f"{item} {kind}, rank int, period int, magnitude double")
    return found if long is None else found.unionByName(_long_periods(long, item, time, target, top))


def periodic_features(df: DataFrame, item: str, time: str, target: str, top: int = 3) -> DataFrame:
    """df's rows with sin_i and cos_i of the running place over the i-th period, zeros where a series has fewer."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(time).reset_index(drop=True)
        found = find_periods(rows[target].to_numpy(dtype=float), top)
        for i in range(top):
            angle = 2 * np.pi * np.arange(len(rows)) / found[i][0] if i < len(found) else None
            rows[f"sin_{i}"] = np.sin(angle) if angle is not None else 0.0
            rows[f"cos_{i}"] = np.cos(angle) if angle is not None else 0.0
        return rows

    more = ", ".join(f"sin_{i} double, cos_{i} double" for i in range(top))
    base = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    short, long = _by_length(df, item)
    out = short.groupBy(item).applyInPandas(one, f"{base}, {more}")
    if long is None:
        return out
    found = _long_periods(long, item, time, target, top).groupBy(F.col(item).alias("__item")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "period"))).alias("__periods"))
    placed = _placed(long, item, time, "__place").join(F.broadcast(found), F.col(item).eqNullSafe(F.col("__item")), "left")
    angles = [F.lit(2 * np.pi) * (F.col("__place") - 1) / F.try_element_at("__periods", F.lit(i + 1)) for i in range(top)]
    waves = {f"{name}_{i}": F.coalesce(wave(a), F.lit(0.0)) for i, a in enumerate(angles) for name, wave in (("sin", F.sin), ("cos", F.cos))}
    return out.unionByName(placed.withColumns(waves).select(*df.columns, *waves))
