"""Packing documents into training sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most a sequence's size. The histogram of piece lengths, which has no more bins
than a sequence has tokens, is packed on the driver: lengths from long to short go to the pack that is shortest so
far, and counts of packing patterns are updated instead of packing one piece after another. The patterns are then
joined to the pieces by their rank among those of the same length, so that no piece ever passes through the driver.

Null and empty texts have the end token alone. Repeated rows are documents of their own. An empty table gives no
pieces. Only the columns asked for are read, so others of clashing names do no harm.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.bpe import KEPT, Bpe, load, slices, unload
from tokenloom.llm.common import give_back, stored, trimmed, with_field

#: Pieces of one length are ranked in buckets of about ROWS, of which there are MOST at most.
ROWS, MOST = 1000, 4096
#: Bytes of text that are worked on at once, and where memory matters more than time.
PART, LEAN = 2_000_000, 500_000


def cut(rows: pa.RecordBatch, bpe: Bpe, size: int, end_id: int, with_ids: bool, names: list[str]) -> pa.RecordBatch:
    """The pieces of the rows (key, text)."""
    every, ends = bpe.encode_column(rows.column(1))
    total = np.diff(ends) + 1
    stops = np.cumsum(total)
    flat = np.full(int(stops[-1]), end_id, "<u4")
    own = np.ones(len(flat), bool)
    own[stops - 1] = False
    flat[own] = every
    n = -(-total // size)
    owner = np.repeat(np.arange(rows.num_rows), n)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * size
    length = np.minimum(size, total[owner] - start)
    at = (stops - total)[owner] + start
    raw = memoryview(flat).cast("B")
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
    columns = [rows.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[owner]))]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, stops[-1]), pa.int32()), pa.array(flat.view("<i4"))))
    return pa.RecordBatch.from_arrays(columns, names=names)


def in_parts(batches: Iterator[pa.RecordBatch], bpe: Bpe, size: int, end_id: int, with_ids: bool, names: list[str], lean: bool = False) -> Iterator[pa.RecordBatch]:
    """The pieces of all batches, part by part. lean: smaller parts, and what each has freed is given back before the next."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))
        for part in slices(sizes, LEAN if lean else PART):
            yield cut(batch.slice(part.start, part.stop - part.start), bpe, size, end_id, with_ids, names)
            if lean:
                give_back()


def pieces(df: DataFrame, config: str, size: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """Each document's tokens and the end id, cut every `size` tokens: key, start, length, ids_crc32, doc_tokens and, if wanted, ids."""
    held = df.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_parts(batches, load(held.value, kept), size, end_id, with_ids, schema.names, kept < KEPT)
        if kept < KEPT:
            unload()

    source = df.select(key, df[text].alias("_text"))
    schema = T.StructType([source.schema[0]])
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = with_field(schema, name, T.LongType())
    if with_ids:
        schema = with_field(schema, "ids", T.ArrayType(T.IntegerType()))
    return source.mapInArrow(trimmed(run), schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns and how often each occurs; every length of the histogram lies in as many slots as it counts."""
    by_fill: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    fills: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pattern: tuple[int, ...], fill: int) -> None:
        if fill == size:
            done.append((count, pattern))
        else:
            if not by_fill[fill]:
                heapq.heappush(fills, fill)
            by_fill[fill].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= size:
                fill = fills[0]
                count, pattern = by_fill[fill].pop()
                if not by_fill[fill]:
                    heapq.heappop(fills)
                used = min(left, count)
                if count > used:
                    put(count - used, pattern, fill)
            else:
                fill, pattern, used = 0, (), -(-left // (size // length))
            put(used, (*pattern, length), fill + length)
            left -= used
    return done + [p for packs in by_fill.values() for p in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank behind the last, first sequence, offset in the sequence) of every slot of every pattern."""
    out, ranks, sequence = [], defaultdict(int), 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            out.append((length, ranks[length], ranks[length] + count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


def pack(df: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset. df is read twice: pass a stored table."""
    spark = df.sparkSession
    histogram = {r["length"]: r["count"] for r in df.groupBy("length").count().collect()}
    if histogram and max(histogram) > size:
        raise ValueError("a piece is longer than a sequence")
    buckets = max(1, min(MOST, sum(histogram.values()) // ROWS))
    where = [F.col("length"), F.col("_bucket")]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("length", "_bucket")
        .count()
        .select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    )
    ranked = (
        dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*where).orderBy(key, "start", "ids_crc32", "doc_tokens")))
        .join(before, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_at") - 1)
    )
    # As many rows as the patterns have slots: a few for each of `size` lengths, whatever the number of documents.
    # As an Arrow table: a list of rows would go through Python workers of another kind, which stay beside those of the kernels.
    places = np.array(slots(shortest_pack_first(histogram, size)), np.int64).reshape(-1, 5)
    placed = spark.createDataFrame(pa.table([pa.array(c) for c in places.T], names=["_length", "_lo", "_hi", "_sequence", "offset"]))
    found = ranked.join(F.broadcast(placed), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return found.select(*df.columns, (F.col("_sequence") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def pack_documents(df: DataFrame, config: str, size: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = False, kept: int = KEPT) -> DataFrame:
    """Documents tokenized, cut and packed; the pieces are written once to the shared folder and read from there."""
    return pack(stored(pieces(df, config, size, end_id, text, key, with_ids, kept), "pieces"), size, key)
