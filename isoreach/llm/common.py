"""What the text operators share: the cluster's shared folder, words, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode, as in tests, and an error on a cluster."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = "file:///tmp/isoreach-shared"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


#: Bytes of rows that Spark hands to a Python worker at once, unless the session says otherwise; one row may be longer.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound batches by bytes: 10,000 rows, the usual bound, may be gigabytes of text."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table in the shared folder and read it: later jobs start from files, not from lineage."""
    spark = df.sparkSession
    bound_batches(spark)
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path, compression=codec)
    del df
    spark._jvm.System.gc()  # shuffle files go once the driver's plans of them do
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize wrote and no later plan reads."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_folder(df.sparkSession, f)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of a key from which on, or from a 100,000th of all on, it is hot.
HOT = 10_000


def hot_join(big: DataFrame, small: DataFrame, key: str, count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """Inner or left join of rows with a table of one row a key, in which ``count`` is the number of its rows in ``big``.

    Fewer than 100,000 keys can have a 100,000th of the rows, so the rows of hot
    keys meet a broadcast of that bound where they lie; only the others are
    shuffled, and none of their keys is large.
    """
    if total is None:
        total = small.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(HOT, total // 100_000)
    first = big.join(F.broadcast(small.filter(hot)), key)
    rest = big.join(F.broadcast(small.filter(hot).select(key)), key, "left_anti").join(small.filter(~hot), key, how)
    return first.unionByName(rest)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """f over record batches, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from f(b)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """f over all batches of a partition; what a worker keeps is given back at the end of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(b for b in batches if b.num_rows)
        finally:
            give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Caches of a worker that outlive a task; all are emptied at its end.
CACHES: list[dict | list] = []


def give_back() -> None:
    """Empties caches and returns freed memory: a worker lives on after its task, and the next may be another."""
    for c in CACHES:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(col)).cast(pa.binary()).to_pylist()]


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items of at most `most` in total, or one item."""
    start = total = i = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if total or start <= i:
        yield start, i + 1


def crc_rest(col: str, mod: int) -> Column:
    """crc32 of an id as text, mod."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (u, v), of the nodes for which it is another.

    Alternating large and small stars, each a pre-aggregated minimum joined to
    the edges, those of hubs by a broadcast of the few hubs; edges are written
    to the shared folder each round, and only their count and a hash sum come
    to the driver. Rounds go on until the edges stay as they are.
    """
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both, low, "u", "n", total=2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, "u", "n", total=2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop_table(last)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of a sorted array, and its end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)
