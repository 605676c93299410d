"""Shared pieces of the training-data operators: the shared folder, written tables, hot-key joins."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word patterns: space and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"

_local: dict[str, str] = {}
_scratch = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, local mode gets a temporary folder; a cluster gets an error."""
    conf = spark.sparkContext.getConf()
    if at := conf.get("spark.checkpoint.dir"):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a task that writes narrow rows.
TASK_ROWS = 500_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    ``rows``: about as many as ``df`` has, if they are narrow; tasks get TASK_ROWS of them instead of a shuffle partition."""
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    if (open_ := getattr(_scratch, "paths", None)) is not None:
        open_.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Schemes of Hadoop's object stores and the ones that Arrow knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def arrow_uri(url: str) -> str:
    """A Hadoop path as Arrow names it: paths without a scheme are local files."""
    if url.startswith("file:"):
        return "file:///" + url[5:].lstrip("/")
    scheme, found, rest = url.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else "file://" + url


def filesystem(url: str):
    """(Arrow file system, path in it) of a file in the shared folder, for tasks that read or write their own files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(url))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder by Spark's own file system, whatever its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the function it gives has been told to keep."""
    outer, _scratch.paths = getattr(_scratch, "paths", None), []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.written_to)
        return df

    try:
        yield keep
    finally:
        made, _scratch.paths = _scratch.paths, outer
        for path in made:
            if path not in kept:
                delete(SparkSession.active(), path)
            elif outer is not None:
                outer.append(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that the optimizer computes once a row: neither a projection nor a filter above inlines it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str, names: list[str]) -> DataFrame:
    """``make()`` runs once a task and gives a function from a batch to a list of columns in the order of ``names``."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    assert arrow.names == names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                cols = f(batch)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch that a Python worker gets at once; one row may exceed it.
BATCH_BYTES = 16_000_000


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows and bytes that one Arrow batch brings to a Python worker, so that long texts don't fill its memory.

    Batches are cut when a plan runs, so that these settings must outlive the call; smaller ones of the session's own stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def measured_broadcasts(spark: SparkSession) -> None:
    """Sides are broadcast by the size they came out with, never by an estimate from files: that of a table whose rows are
    exploded is its file's, however many grams each row has.

    Joins are planned when a plan runs, so that the setting must outlive the call. Hints still broadcast."""
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(limit) != "-1":
        spark.conf.set(measured, spark.conf.get(measured, spark.conf.get(limit)))
        spark.conf.set(limit, "-1")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Shield:
    """A table whose columns go by numbers while an operator adds its own: no name of a user can clash with them.

    ``df``: the table with columns k0, k1, ...; ``of[name]``: a column's number name; ``back``: the columns under their names."""

    def __init__(self, df: DataFrame):
        self.of = {c: f"k{i}" for i, c in enumerate(df.columns)}
        self.df = df.select(*[F.col(quoted(c)).alias(k) for c, k in self.of.items()])
        self.back = [F.col(k).alias(c) for c, k in self.of.items()]


def map_beside(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` beside its own; ``make()`` runs once a task and gives a function from a batch to them."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    more = StructType.fromDDL(schema)
    arrow = to_arrow_schema(more)
    out = StructType([*df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                cols = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(f(batch), arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *arrow.names])

    return df.mapInArrow(run, out)


#: A key with more than a share of 1 / HOT of the rows is hot; by counting there are fewer than HOT of them.
HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with ``right`` (one row a key) on ``key`` that no hot key can slow.

    ``counts``: (key, n), rows of ``left`` by key, of which only those with n > total / HOT come to the driver: under HOT
    rows. Each hot key is dealt into parts, a power of two, of at most total / HOT rows each, about: rows of ``left`` choose
    one by their hash, and the row of ``right`` is repeated for each."""
    by: dict[int, list] = {}
    for r in counts.where(F.col("n") * HOT > total).select(key, "n").collect() if total else []:
        if (parts := 1 << (math.ceil(r["n"] * HOT / total) - 1).bit_length()) > 1:
            by.setdefault(parts, []).append(r[key])
    parts = F.lit(1)
    for n, keys in sorted(by.items()):
        parts = F.when(F.col(key).isin(keys), F.lit(n)).otherwise(parts)
    others = [c for c in left.columns if c != key] or [key]
    a = left.withColumn("_part", F.pmod(F.xxhash64(*others), parts).cast("int"))
    b = right.select(F.col(key).alias("_right"), *[c for c in right.columns if c != key], F.explode(F.sequence(F.lit(0), parts - 1)).alias("_piece"))
    return a.join(b, (F.col(key) == F.col("_right")) & (F.col("_part") == F.col("_piece")), how).drop("_part", "_piece", "_right")


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left ``spread_join`` where ``right`` itself tells by ``weight`` how many rows of ``left`` have a key."""
    return spread_join(left, right.drop(weight), key, right.select(key, F.col(weight).alias("n")), total, "left")


#: Bits of the filter by which rows are told that can't be in a set: 8 MB, whatever the set's size.
FILTER_BITS, BITMAP = 1 << 26, 1 << 15


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_maybe``: false only if ``key`` is in none of the rows of ``keys``.

    The keys' hashes set bits of FILTER_BITS in all, 2,048 bitmaps of 4 kB at most, which are broadcast. Beyond some
    hundred million keys nearly all bits are set and nearly all rows may be in: the exact join that follows sees them."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bucket, place = F.floor(bit / BITMAP).cast("int"), F.pmod(bit, F.lit(BITMAP))
    maps = keys.select(bucket.alias("_bucket"), place.alias("_place")).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    at = rows.withColumn("_at", bucket).withColumn("_place", place).join(F.broadcast(maps), F.col("_at") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.get(F.array(*[F.lit(1 << k) for k in range(8)]), F.pmod(F.col("_place"), F.lit(8)).cast("int"))
    return at.select(*rows.columns, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False)).alias("_maybe"))
