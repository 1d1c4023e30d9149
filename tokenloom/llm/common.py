"""What the operators of this subpackage share: inputs, the shared folder, salted joins."""

from __future__ import annotations

import ctypes
import math
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import ship

#: ASCII white space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]"
#: A key with at least this share of all rows is split; so at most as many keys are.
HOT_KEYS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session. Where none is set, one is made if all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as written to the shared folder: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith(("file://" + shared_dir(spark).removeprefix("file://"), shared_dir(spark))):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 20_000, size: str = "6m") -> None:
    """Sends the package to the executors, and bounds Arrow batches by bytes: texts vary from a word to megabytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns memory that is free, but kept by the allocators of Arrow and C, to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel that gives freed memory back at its end: Python workers stay, and what one stage needed would pile up."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of a number written in decimal, modulo; the split that the contracts prescribe. Null: of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", seed: str | None = None, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """many JOIN few ON keys, where one key may hold a large share of `many`.

    Keys with at least a 1/HOT_KEYS share of `many` are split into as many salts as they have such shares; there can be
    HOT_KEYS such keys at most, so the table of them is bounded and is broadcast whatever the input's size. `few`
    repeats its rows of hot keys once for each salt. how: inner or left. Null keys match nothing. seed: a column of
    `many` that tells its rows apart. counts: rows of each key, if they are known already (keys and count); total: of `many`, if counts leave rare keys out.
    """
    if counts is None:
        counts = many.groupBy(*keys).count()
    if total is None:
        total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(64, math.ceil(total / HOT_KEYS))
    hot = counts.where(F.col("count") >= least).select(*keys, F.ceil(F.col("count") / least).cast("int").alias("_salts"))
    # As an Arrow table: a list of rows would go through Python workers of another kind, which stay beside those of the kernels.
    found = hot.toArrow()
    if not found.num_rows:
        return many.join(few, keys, how)
    splits = F.broadcast(many.sparkSession.createDataFrame(found, hot.schema))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in ([seed] if seed else [c for c in many.columns if c not in keys])]), F.coalesce(F.col("_salts"), F.lit(1)))
    left = many.join(splits, keys, "left").withColumn("_salt", spread.cast("int")).drop("_salts")
    right = few.join(splits, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the smallest node reachable) of every node of the undirected edges, which may be null-free longs only.

    Large-star and small-star steps in turn until nothing changes; each step is written to the shared folder.
    """
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(salted_join(both.where("v > u"), least, ["u"], seed="v").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, ["a"], seed="b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, stored(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        forget(before)
        forget(large)
        if (found := mark(now)) == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def mark(edges: DataFrame) -> tuple:
    """Tells one set of edges from another."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
