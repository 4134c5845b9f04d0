"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="specloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table to the shared folder and reads it again."""
    spark = df.sparkSession
    folder, fs = _folder(spark, f"{shared_dir(spark)}/specloom-{uuid.uuid4().hex}")
    path = f"{folder.toString()}/{name}"
    df.write.parquet(path)
    fs.deleteOnExit(folder)  # what is not discarded before goes when the driver ends
    out = spark.read.schema(df.schema).parquet(path)
    out._specloom_path = path
    return out


def bounded(df: DataFrame, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """``df`` saved, and the same to join with: broadcast if it has ``most`` rows or fewer, else shuffled."""
    saved = save(df, name)
    return saved, F.broadcast(saved) if saved.count() <= most else saved


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that are done, which it does when neither Python nor the driver's JVM holds them."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def read_once(spark: SparkSession) -> Iterator[None]:
    """Of plans made and run within, Spark removes the shuffle files as soon as they have run, whoever still holds them; what is run again is worked out again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that no later plan reads, and the shuffle files of plans that are done."""
    for df in tables:
        folder, fs = _folder(df.sparkSession, df._specloom_path.rpartition("/")[0])
        fs.delete(folder, True)
    if tables:
        sweep(tables[0].sparkSession)


def small_batches(df: DataFrame, rows: int = 250) -> DataFrame:
    """Bounds the session's Arrow batches: whole texts in the default 10,000 rows take much memory outside the heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if not 0 < now <= rows:
        conf.set(name, str(rows))
    return df


def crc_mod(key: Column, m: int) -> Column:
    """crc32(key as text) mod m; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def tidy() -> None:
    """Gives a worker's free memory back at the end of a task, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def over_batches(make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: pa.Schema, rows: int = 256) -> Callable:
    """A mapInArrow function: ``make`` runs once a task, what it returns maps ``rows`` rows at most to columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(step(batch.slice(at, rows)), schema=schema)
        tidy()

    return run


class Memo(dict):
    """A task's table of what was worked out for words met before, emptied before its keys and ``each`` bytes a row exceed ``most`` bytes; very long words are not kept."""

    def __init__(self, most: int = 32 << 20, each: int = 256):
        super().__init__()
        self.most, self.each, self.held = most, each, 0

    def put(self, key: str, value):
        size = 4 * len(key) + self.each
        if size > self.most >> 6:
            return value
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays (public constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash64(seed: int, *cols: Column) -> Column:
    """A seeded 64-bit hash that does not depend on partitions."""
    return F.xxhash64(F.lit(seed), *cols)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, label), label the least node.

    Each round maps every node to the least of its neighbours and itself, then contracts the edges;
    the rounds grow with the logarithm of the longest path. Every round's table is written to the shared
    folder, so lost executors cost one round at most. Nodes without an edge to another node are absent.
    """
    rest = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    parents: list[DataFrame] = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "parents")
        parents.append(up)
        left = up.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = up.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        last, rest = rest, save(rest.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        discard(last)
    if not parents:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = parents[0]
    for up in parents[1:]:
        up = up.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        out = out.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    return out
