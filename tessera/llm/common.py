"""Shared plumbing: the folder that all executors see, tables written there to cut lineage, and a bounded filter of rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows at most of the table that the filter of sifted() broadcasts, whatever the tables' sizes, and words of 64 bits in each.
SLOTS, WORDS = 1 << 17, 8


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, and readers prune columns."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written()."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if path.startswith(shared_dir(spark)) or path.split(":", 1)[-1].lstrip("/").startswith(shared_dir(spark).split(":", 1)[-1].lstrip("/")):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Returns the memory that this worker has freed to the system. Spark keeps idle workers and takes them in turn, so what each holds on to adds up on an executor."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(work: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """An Arrow function over batches that gives memory back after the last one."""

    def run(batches: Iterable) -> Iterator:
        yield from work(batches)
        give_back()

    return run


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is executed within, as whole texts are long rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, lengthened until no column of `taken` has it, upper and lower case being the same."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str) -> DataFrame:
    """rows with a column `name`: true for every row whose key, a long, is among the wanted ones, and by chance for a few others.

    A bit for each wanted key in a table of at most SLOTS rows of WORDS words, which is broadcast
    (some 12 MB at most). Beyond some 40 million wanted keys most bits are set: then most rows
    are marked, and what follows costs what it would cost without this.
    """
    slot, part, bit, code = (fresh(c, [*rows.columns, name]) for c in ("__slot", "__part", "__bit", "__code"))
    words = [fresh(f"__word{i}", rows.columns) for i in range(WORDS)]

    def coded(df: DataFrame, k: Column) -> DataFrame:
        df = df.withColumn(code, F.pmod(F.xxhash64(k, F.lit(7)), F.lit(64 * WORDS * SLOTS)))
        return df.withColumns({slot: F.floor(F.col(code) / (64 * WORDS)).cast("int"), part: (F.shiftright(F.col(code), 6) % WORDS).cast("int"), bit: F.expr(f"shiftleft(1L, cast(`{code}` & 63 as int))")})

    bits = coded(wanted.select(wanted_key.alias(name)), F.col(name)).groupBy(slot).agg(*(F.bit_or(F.when(F.col(part) == i, F.col(bit))).alias(w) for i, w in enumerate(words)))
    found = coded(rows, key).join(F.broadcast(bits), slot, "left")
    word = F.when(F.col(part) == 0, F.col(words[0]))
    for i in range(1, WORDS):
        word = word.when(F.col(part) == i, F.col(words[i]))
    return found.withColumn(name, F.coalesce(word.bitwiseAND(F.col(bit)) != 0, F.lit(False))).select(*(f"`{c}`" for c in rows.columns), name)


def sifted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose key is among the wanted ones, and a few others (see marked); what a join drops need not be shuffled for it."""
    hit = fresh("__hit", rows.columns)
    return marked(rows, key, wanted, wanted_key, hit).where(F.col(hit)).drop(hit)


def words_sql(column: str | Column = "text") -> Column:
    """Words of a text as an array: maximal runs of characters outside space and tab to carriage return; A-Z lower-cased. Null or no word: an empty array."""
    text = F.col(column) if isinstance(column, str) else column
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def held_out(column: str = "doc_id") -> Column:
    """True for rows whose crc32 of the identifier as text leaves no remainder by 5; false for a null identifier."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: tuple[int, int], columns: dict[str, str | Column]) -> DataFrame:
    """A bounded sample to learn from: the given columns by name, and y, of rows of docs whose label, 0 or 1, is known and that aren't held out; of each class the most[class] identifiers of docs with the least hash.

    Only this choice reads doc_id and labels. Labels that are neither 0 nor 1 are ignored; of
    several for one document the largest counts. Of rows that repeat an identifier one in the
    order of text stands for it. The sample is written to the shared folder.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col(target).cast("int").alias("y")).where("y in (0, 1)")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    here = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id")).distinct()
    known = written(known.join(here, "id", "left_semi"), "known")
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in enumerate(most)]
    chosen = written(drawn[0].unionByName(drawn[1]), "chosen")  # sum(most) rows at most, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    picked = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    out = written(picked.select(*(F.col(c).alias(name) if isinstance(c, str) else c.alias(name) for name, c in columns.items()), "y"), "sample")
    drop(known, chosen)
    return out
