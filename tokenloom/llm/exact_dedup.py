"""Exact deduplication as a stateful stream, by DataFrame and SQL functions alone.

A stream of (digest, stable identifier, content locator) feeds a streaming aggregation by digest whose state lies in
RocksDB on the executors' disks and never expires: of each digest it retains the first batch, the smallest identifier in
it with its locator (the file it was read from), and the number of rows. The final state is read back through the state
store reader. Rows whose digest was hit again are then compared byte for byte with the text of the row that stays; should
texts of one digest differ, they are told apart by the texts themselves.

With a folder for the state, a later batch of documents is deduplicated against all earlier ones: what an earlier batch
has goes, whatever its identifier, and the texts it is compared with are fetched from the files that the locators name.

Null texts count as empty and equal each other. Null identifiers sort last, so they stay only if nothing else does.
Repeated rows (same identifier and text) are rows of their own: both are returned and both carry the keeper's
identifier; `kept` is true for one row of a group only. An empty table gives no rows. Texts of any length are compared whole. Other columns are not read, clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import SPACE, salted_join, scratch, stored

#: State on disk; a store is closed as soon as its task has committed, so that no open store holds disk or memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Row keys of hits are broadcast up to this number (about 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST_HITS = 200_000


def normalised(text: str) -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE + "+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprints(df: DataFrame, digest: Callable[[Column], Column] = sha256, text: str = "text", key: str = "doc_id", batch: int = 0) -> DataFrame:
    """digest, identifier, batch and locator (the file a row was read from) of each row, and its SHA-256."""
    norm = normalised(text)
    return df.select(F.col(key).alias("doc_id"), digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), F.input_file_name().alias("locator"), F.lit(batch).alias("batch"))


def keyed_state(spark: SparkSession, path: str, partitions: int | None = None, max_bytes: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs the stream over the fingerprints stored at path, to its end; the final state: digest, keep_id, locator, first_batch, group_size.

    checkpoint: where the state lives; with one of an earlier call only files that are new since then are read.
    """
    want = dict(STATE) | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    lasting, checkpoint = checkpoint is not None, checkpoint or scratch(spark, "dedup-state")
    try:
        reader = spark.readStream.schema(spark.read.parquet(path).schema)
        if max_bytes:
            reader = reader.option("maxBytesPerTrigger", max_bytes)
        state = (
            reader.parquet(path)
            .groupBy("digest")
            .agg(F.min(F.struct("batch", F.col("doc_id").isNull().alias("absent"), "doc_id", "locator")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        )
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        if query.lastProgress is None and not (lasting and exists(spark, f"{checkpoint}/commits/0")):
            return spark.read.parquet(path).limit(0).select("digest", F.col("doc_id").alias("keep_id"), "locator", F.col("batch").alias("first_batch"), F.lit(0).cast("long").alias("group_size"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(checkpoint)
    first, size = kept.schema["value"].dataType.names
    return kept.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.{first}.doc_id").alias("keep_id"),
        F.col(f"value.{first}.locator").alias("locator"),
        F.col(f"value.{first}.batch").alias("first_batch"),
        F.col(f"value.{size}").alias("group_size"),
    )


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def clashes(df: DataFrame, members: DataFrame, digest: Callable[[Column], Column], text: str, key: str, batch: int = 0) -> DataFrame:
    """Rows whose text differs from that of the row kept for their digest: digest and the text itself.

    Only rows whose digest was hit are read in full; they are picked by identifier before anything is computed of them.
    """
    spark = df.sparkSession
    hits = members.where(F.col("group_size") > 1)

    def texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_HITS else wanted
        rows = rows.select(F.col(key).alias("_key"), F.col(text).alias("_raw"))
        some = rows.join(side, rows["_key"].eqNullSafe(side["_id"]), "left_semi").select(F.col("_key").alias("_id"), normalised("_raw").alias("_text"))
        return stored(some.withColumn("digest", digest(F.col("_text"))), "dedup-hits")

    found = texts(df, hits.select(F.col("doc_id").alias("_id")).distinct())
    held = hits.select(F.col("digest").alias("_digest"), "keep_id", "locator", "first_batch").distinct()
    sources = found
    if batch:
        # The rows that stay may be of earlier batches: their files are those that the locators name. A list of files, not of rows.
        old = held.where(F.col("first_batch") < batch)
        files = [r["locator"] for r in old.where("locator <> ''").select("locator").distinct().collect()]
        if files:
            sources = found.unionByName(texts(spark.read.parquet(*files), old.select(F.col("keep_id").alias("_id")).distinct()))
    keepers = (
        sources.join(held, sources["_id"].eqNullSafe(held["keep_id"]) & (sources["digest"] == held["_digest"]), "left_semi")
        .groupBy("digest")
        .agg(F.min("_text").alias("_kept"))
    )
    return salted_join(found, keepers, ["digest"], seed="_id").where(F.col("_text") != F.col("_kept")).select("digest", "_id", "_text")


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", digest: Callable[[Column], Column] = sha256, max_bytes: str | None = None, state: str | None = None) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256, locator of the row that stays.

    state: a folder for state that outlives the call; df is then the next batch, and sizes count rows of all batches.
    max_bytes: how much one micro-batch reads of the fingerprints.
    """
    spark = df.sparkSession
    path = own = scratch(spark, "fingerprints")
    batch = 0
    if state:
        path = f"{state.rstrip('/')}/fingerprints"
        batch = (spark.read.parquet(path).agg(F.max("batch")).first()[0] or 0) + 1 if exists(spark, path) else 1
    fingerprints(df, digest, text, key, batch).write.parquet(own)
    prints = spark.read.parquet(own)
    if state:
        prints.write.mode("append").parquet(path)
    held = keyed_state(spark, path, max_bytes=max_bytes, checkpoint=f"{state.rstrip('/')}/checkpoint" if state else None)
    members = stored(salted_join(prints.drop("locator", "batch"), held, ["digest"], seed="doc_id"), "dedup-members")
    odd = clashes(df, members, digest, text, key, batch).select("digest").distinct()
    if odd.isEmpty():
        return finished(members, batch)
    # Different texts of one digest: these few groups are formed anew by their texts, within this batch.
    rows = df.select(F.col(key).alias("doc_id"), normalised(text).alias("_text")).withColumn("digest", digest(F.col("_text")))
    rows = rows.join(odd, ["digest"], "left_semi").withColumn("text_sha256", sha256(F.col("_text")))
    groups = rows.groupBy("digest", "_text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    apart = salted_join(rows, groups, ["digest", "_text"], seed="doc_id").withColumn("locator", F.lit(None).cast("string")).withColumn("first_batch", F.lit(batch))
    plain = members.join(odd, ["digest"], "left_anti")
    return finished(plain.unionByName(apart.select(*plain.columns)), batch)


def finished(members: DataFrame, batch: int = 0) -> DataFrame:
    """kept: the row that carries its group's identifier, if the group began in this batch; of equal rows under that identifier, one."""
    names = ["doc_id", "keep_id", "group_size", "text_sha256", "locator"]
    keeper = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("first_batch") == batch)
    repeats = members.where(keeper).groupBy(*names).count().withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    out = members.where(~keeper).select(*names, F.lit(0).alias("_n")).unionByName(repeats.select(*names, "_n"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("_n") == 1).alias("kept"), "text_sha256", "locator")


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that stay, with df's columns. What goes is looked up, so texts needn't be shuffled to stay."""
    found = stored(exact_dedup(df, text, key).select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha2"), "kept"), "dedup-result")
    gone = found.where(~F.col("kept")).select("_keep", "_sha2").distinct()
    rows = df.withColumn("_sha", sha256(normalised(text)))
    same = rows[key].eqNullSafe(F.col("_keep")) & (F.col("_sha") == F.col("_sha2"))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_HITS else gone
    out = rows.join(side, same, "left_anti")
    repeated = gone.join(found.where("kept").select(F.col("_keep").alias("_k"), F.col("_sha2").alias("_s")), F.col("_keep").eqNullSafe(F.col("_k")) & (F.col("_sha2") == F.col("_s")), "left_semi")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates([key, "_sha"]))
    return out.drop("_sha")
