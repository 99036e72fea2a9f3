"""Sources and sinks: readers by suffix, split and metadata tables, trial records, deltas, reports and manifests."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.constraints import FeatureInfo, Rules
from tessera.sources.tables import nan_to_null

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc", ".txt": "text"}


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, **options: object) -> DataFrame:
    """A table in the format of its suffix, NaN as NULL. CSV has a header; give a schema to save the pass that infers one."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind is None:
        raise ValueError(f"unknown suffix of {path}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    if kind == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.format(kind).load(path))


def read_query(spark: SparkSession, url: str, query: str, after: Callable[[DataFrame], DataFrame] | None = None, **options: object) -> DataFrame:
    """The rows of a query on a JDBC connection, passed through `after`."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return after(df) if after else df


def from_config(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """{"file": path, ...options} or {"sql": query, "url": url, ...options}. Sources behind a network are to be fetched first."""
    rest = {k: v for k, v in config.items() if k not in ("file", "sql", "url")}
    if "file" in config:
        return read(spark, str(config["file"]), **rest)
    if "sql" in config:
        return read_query(spark, str(config["url"]), str(config["sql"]), **rest)
    raise ValueError("a source needs file or sql")


@dataclass
class Dataset:
    """A named table with its rules, target, sorting and splitting."""

    name: str
    source: Callable[[SparkSession], DataFrame]
    rules: Rules
    target: str
    order: Sequence[str] = ()
    split: Callable[[DataFrame], dict[str, DataFrame]] | None = None
    _kept: dict = field(default_factory=dict, repr=False)

    def data(self, spark: SparkSession, only_valid: bool = False) -> DataFrame:
        if "df" not in self._kept:
            df = self.source(spark)
            self._kept["df"] = df.orderBy(*self.order) if self.order else df
        return self.rules.filter(self._kept["df"]) if only_valid else self._kept["df"]

    def xy(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        df = self.data(spark)
        return df.drop(self.target), df.select(self.target)

    def splits(self, spark: SparkSession) -> dict[str, DataFrame]:
        df = self.data(spark)
        return self.split(df) if self.split else {"all": df}


REGISTRY: dict[str, Callable[[], Dataset]] = {}


def register(name: str) -> Callable:
    def keep(make: Callable[[], Dataset]) -> Callable[[], Dataset]:
        REGISTRY[name] = make
        return make

    return keep


def load_dataset(name: str) -> Dataset:
    if name not in REGISTRY:
        raise KeyError(f"no dataset {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]()


def load_split(spark: SparkSession, path: str, target: str, raw_only: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """A split with its feature names, raw columns dropped."""
    df = read(spark, path).drop(*raw_only)
    return df, [c for c in df.columns if c != target]


def find_target(path: str, given: str | None = None, levels: int = 4) -> str:
    """The given target, or that of the nearest split_info.json beside the file or up to `levels` folders above."""
    if given:
        return given
    folder = os.path.dirname(os.path.abspath(path))
    for _ in range(levels + 1):
        info = os.path.join(folder, "split_info.json")
        if os.path.exists(info):
            with open(info) as f:
                return json.load(f)["target"]
        folder = os.path.dirname(folder)
    raise FileNotFoundError("no split_info.json and no target given")


def read_metadata(spark: SparkSession, path: str, features: Sequence[str], strict: bool = False) -> tuple[FeatureInfo, ...]:
    """feature, type, mutable, min, max in the order of the features; a bound `dynamic` is None. Missing features raise, and with strict another order does."""
    rows = {r.feature.strip(): r for r in spark.read.csv(path, header=True, schema="feature string, type string, mutable string, min string, max string").collect()}
    missing = [f for f in features if f not in rows]
    if missing:
        raise ValueError(f"no metadata of {missing}")
    if strict and [f for f in rows if f in set(features)] != list(features):
        raise ValueError("metadata are in another order than the features")
    bound = lambda v: None if v is None or v.strip().lower() == "dynamic" else float(v)
    return tuple(FeatureInfo(f, rows[f].type.strip(), str(rows[f].mutable).strip().lower() == "true", bound(rows[f].min), bound(rows[f].max)) for f in features)


def write_subset(df: DataFrame, keys: DataFrame, id_column: str, path: str) -> None:
    """The rows whose identifier is wanted, in its order, as CSV with a header."""
    df.join(keys.select(id_column).distinct(), id_column, "left_semi").select(*df.columns).orderBy(id_column).write.csv(path, header=True)


def read_trials(spark: SparkSession, pattern: str) -> DataFrame:
    """The rows of JSON trial documents, one row each, with the file's name and the parts of its packed tag."""
    doc = spark.read.json(pattern, multiLine=True)
    rows = doc.select(F.input_file_name().alias("file"), *(c for c in doc.columns if c != "rows"), F.explode("rows").alias("row")).select("*", "row.*").drop("row")
    return rows.withColumns(tag_parts(F.element_at(F.split(F.col("file"), "/"), -2)))


def tag_parts(tag: Column) -> dict[str, Column]:
    """dataset, r, c and seed of `<dataset>_R<r>_c<c>_s<seed>`, taken from the right."""
    part = lambda i: F.regexp_extract(tag, r"^(.*)_R([0-9.]+)_c(\d+)_s(\d+)$", i)
    return {"dataset": part(1), "r": F.nullif(part(2), F.lit("")).cast("double"), "c": F.nullif(part(3), F.lit("")).cast("int"), "seed": F.nullif(part(4), F.lit("")).cast("int")}


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of an iteration log; blank cells are null, blank rows go."""
    return spark.read.csv(path, header=True, schema=schema).na.drop("all")


def replay_delta(clean: DataFrame, delta: DataFrame, id_column: str, cells: Sequence[str], label: str | None = None) -> DataFrame:
    """The clean table with saved differences: cells are added, a label is replaced; rows without a delta stay."""
    d = delta.select(F.col(id_column), *(F.col(c).alias(f"__{c}") for c in (*cells, *([label] if label else []))))
    out = clean.join(d, id_column, "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0.0)) for c in cells})
    if label:
        out = out.withColumn(label, F.coalesce(f"__{label}", label))
    return out.select(*clean.columns)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; the committer of the store makes them appear at once."""
    df.write.mode("overwrite").json(path)


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path, computed and written first if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, length and SHA-256 of the files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A pipe table as rows of an array of trimmed cells, header and rule dropped."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|")).withColumn("line", F.monotonically_increasing_id())
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(~F.col("value").rlike(r"^[\s|:-]+$")).select("line", cells.alias("cells"))
    return rows.where(F.col("line") > rows.agg(F.min("line")).first()[0]).drop("line")


def to_markdown(df: DataFrame, best: Mapping[str, str] | None = None, digits: int = 3) -> str:
    """A small table as Markdown; best: column -> "max" or "min", whose best value is bold."""
    rows = [r.asDict() for r in df.collect()]
    top = {c: (max if how == "max" else min)(r[c] for r in rows if r[c] is not None) for c, how in (best or {}).items() if any(r[c] is not None for r in rows)}

    def cell(c: str, v: object) -> str:
        text = "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return f"**{text}**" if c in top and v == top[c] else text

    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(c, r[c]) for c in df.columns) + " |" for r in rows])


def shard(df: DataFrame, batch: str, rank: int, world: int) -> DataFrame:
    """The batches of one of `world` readers."""
    return df.where(F.pmod(F.col(batch), F.lit(world)) == rank)
