"""Tokenization over DataFrames: the kernels of a tokenizer.json in Arrow batches, and plans without them where built-ins do."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import columns
from tokenloom.functions.batches import ByteSpans, part_at, PieceBatches
from tokenloom.functions.text import Text, normalizer, piece_strings
from tokenloom.functions.tokenizer import Spec, Tokenizer, compiled, parts_of
from tokenloom.session import ship

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
PARTS = {
    "ids": T.ArrayType(T.IntegerType()), "type_ids": T.ArrayType(T.IntegerType()), "tokens": T.ArrayType(T.StringType()),
    "words": T.ArrayType(T.IntegerType()), "offsets": T.ArrayType(SPAN), "special": T.ArrayType(T.IntegerType()), "attention": T.ArrayType(T.IntegerType()),
}
ARROW = {
    "ids": pa.list_(pa.int32()), "type_ids": pa.list_(pa.int32()), "tokens": pa.list_(pa.string()), "words": pa.list_(pa.int32()),
    "offsets": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), "special": pa.list_(pa.int32()), "attention": pa.list_(pa.int32()),
}


#: Bytes of text that are worked on at once where Python objects stand for its words or tokens, and of words alone.
PART, ROWS = 500_000, 50_000


def text_parts(column: pa.Array, most: int = 2_000_000) -> list[tuple[int, int]]:
    return parts_of(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def in_parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about PART bytes of the texts in column n (and n + 1, where there are pairs), so that memory doesn't grow with how full a batch is."""
    for batch in batches:
        sizes = np.zeros(len(batch), np.int64)
        for column in batch.columns[n:]:
            if pa.types.is_list(column.type):
                words = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column.flatten()), 0)).astype(np.int64) + 1)])
                counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                sizes += np.diff(words[np.concatenate([[0], np.cumsum(counts)])])
            else:
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
        for a, b in parts_of((sizes + PART // ROWS).tolist(), PART):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def is_text(column: pa.Array) -> bool:
    return pa.types.is_string(column.type) or pa.types.is_large_string(column.type)


def encode(df: DataFrame, config: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pair: str | None = None, add_special: bool = True, unit: str = "byte", want: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """keep, part_no and the wanted lists. Part 0 is the encoding, the next ones what overflowed it. Null counts as empty.

    text may be a string or an array of words. unit: of offsets, byte, char, utf16 or none. Padding to the longest of a
    batch is done by `pad_batches`, for a batch is a key of the data here and not how rows happen to lie together.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(config)
    n = len(keep)
    names = [*keep, "part_no", *want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(held.value)
        fast = tokenizer.words() if not pair and want == ("ids",) and (not add_special or tokenizer.post.added(False) == 0) else None
        chunks = tokenizer.chunks(unit, want) if not pair and not fast else None
        for batch in in_parts(batches, n):
            if fast and pa.types.is_string(batch.column(n).type):
                ids, counts = fast.encode(batch.column(n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.zeros(len(batch), np.int32)), lists], names=names)
                continue
            if chunks and is_text(batch.column(n)):
                ends, flat = chunks.encode(texts_of(batch.column(n)), want)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.zeros(len(batch), np.int32)), *(pa.ListArray.from_arrays(ends, flat[w]) for w in want)], names=names)
                continue
            first = batch.column(n).to_pylist()
            second = batch.column(n + 1).to_pylist() if pair else [None] * len(first)
            owner, part_no, lists = [], [], {w: [] for w in want}
            for k, (a, b) in enumerate(zip(first, second)):
                e = tokenizer.encode(a if a is not None else "", b if b is not None else "" if pair else None, add_special, unit)
                for part, x in enumerate([e, *e.overflow]):
                    owner.append(k)
                    part_no.append(part)
                    for w in want:
                        v = getattr(x, w)
                        lists[w].append([{"start": s, "end": t} for s, t in v] if w == "offsets" else v)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:n]), pa.array(part_no, pa.int32()), *(pa.array(lists[w], ARROW[w]) for w in want)], names=names)

    source = df.select(*keep, df[text].alias("_text"), *([df[pair].alias("_pair")] if pair else []))
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField("part_no", T.IntegerType()), *(T.StructField(w, PARTS[w]) for w in want)])
    return source.mapInArrow(run, schema)


def normalized(df: DataFrame, config: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "normalized") -> DataFrame:
    """keep and the text as a normalizer leaves it; config: that of the normalizer alone. Null counts as empty."""
    ship(df.sparkSession)
    n, names = len(keep), [*keep, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = normalizer(config)
        for batch in in_parts(batches, n):
            texts = [change(Text(t or "", None)).chars for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=names)

    source = df.select(*keep, df[text].alias("_text"))
    return source.mapInArrow(run, T.StructType([*source.select(*keep).schema.fields, T.StructField(out, T.StringType())]))


def words_of(df: DataFrame, config: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "words") -> DataFrame:
    """keep and the pieces that a pre-tokenizer makes of the text, empty ones left out; config: that of the pre-tokenizer alone."""
    ship(df.sparkSession)
    n, names = len(keep), [*keep, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = piece_strings(config)
        known = PieceBatches(config) if part_at(config) else None
        for batch in in_parts(batches, n):
            texts = texts_of(batch.column(n))
            parts = known.pieces(texts) if known else pa.array(list(map(cut, texts)), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], parts], names=names)

    source = df.select(*keep, df[text].alias("_text"))
    return source.mapInArrow(run, T.StructType([*source.select(*keep).schema.fields, T.StructField(out, T.ArrayType(T.StringType()))]))


def count_tokens(df: DataFrame, config: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), add_special: bool = False, out: str = "n_tokens") -> DataFrame:
    """keep and the length of each encoding. Pipelines in which every word is one token are counted by an expression."""
    t = F.coalesce(df[text], F.lit(""))
    if (pieces := native_words(config, add_special)) is not None:
        return df.select(*keep, F.size(pieces(t)).cast("int").alias(out))
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(config)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(held.value)
        fast, more = tokenizer.words(), tokenizer.post.added(False) if add_special else 0
        chunks = None if fast else tokenizer.chunks("none")
        for batch in batches:
            found = []
            for a, b in text_parts(batch.column(n), 2_000_000 if fast else PART):
                column = batch.column(n).slice(a, b - a)
                if fast:
                    found.append(fast.count(column) + more)
                elif chunks:
                    found.append(chunks.count(column.to_pylist()) + more)
                else:
                    found.append(np.array([tokenizer.count(x, add_special) for x in column.to_pylist()], np.int64))
            found = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, pa.int32())], names=[*keep, out])

    source = df.select(*keep, t.alias("_text"))
    return source.mapInArrow(run, T.StructType([*source.select(*keep).schema.fields, T.StructField(out, T.IntegerType())]))


def native_words(config: str, add_special: bool):
    """The expression that splits a text into the words of this pipeline, if every word is one token; else None."""
    spec = Spec.parse(config)
    plain = not (spec.normalizer or spec.added_tokens or spec.truncation or spec.padding or add_special and spec.post_processor)
    if not plain or spec.model.get("type") != "WordLevel" or spec.model.get("unk_token", "<unk>") not in spec.model["vocab"]:
        return None
    kinds = {"Whitespace": columns.whitespace, "WhitespaceSplit": columns.whitespace_split, "BertPreTokenizer": columns.bert_words}
    return kinds.get((spec.pre_tokenizer or {}).get("type"))


def word_level_ids(df: DataFrame, pieces, vocab: DataFrame, unk_id: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep, word_no, word, id) by a join of the words with a vocabulary table (word, id); small ones are broadcast by Spark."""
    rows = df.select(*keep, F.posexplode(pieces(F.coalesce(df[text], F.lit("")))).alias("word_no", "word"))
    return rows.join(vocab, "word", "left").select(*keep, "word_no", "word", F.coalesce("id", F.lit(unk_id)).alias("id"))


def decode(df: DataFrame, config: str, ids: str = "ids", out: str = "decoded", skip_special: bool = True) -> DataFrame:
    """df with the text of its ids; null ids give an empty text."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(config)
    kept = [c for c in df.columns if c != out]
    at = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(held.value)
        table = tokenizer.id_bytes(skip_special)
        for batch in batches:
            for a, b in parts_of((np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0)) + PART // ROWS).tolist(), PART if table else PART // 4):
                part = batch.slice(a, b - a)
                lists = part.column(at)
                texts = table.texts(lists) if table else pa.array([tokenizer.decode(x or [], skip_special) for x in lists.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*kept, out])

    source = df.select(*kept)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(out, T.StringType())]))


def spans(df: DataFrame, config: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each token without specials: keep, token_no, id, start and end in UTF-16 units, odd (for alternating colours)."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(config)
    n, names = len(keep), [*keep, "token_no", "id", "start", "end", "odd"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(held.value)
        cover = ByteSpans(tokenizer, "utf16") if ByteSpans.serves(tokenizer) else None
        chunks = None if cover else tokenizer.chunks("utf16", ("ids", "offsets"))
        for batch in in_parts(batches, n):
            if cover and pa.types.is_string(batch.column(n).type):
                column = pc.fill_null(batch.column(n), "")
                ids, counts = tokenizer.words().encode(column)
                ends = np.concatenate([[0], np.cumsum(counts)])
                start, end = (pa.array(x.astype(np.int32)) for x in cover.offsets(column, ids, counts))
                ids = pa.array(ids)
            elif chunks and is_text(batch.column(n)):
                ends, flat = chunks.encode(texts_of(batch.column(n)), ("ids", "offsets"))
                ids, (start, end) = flat["ids"], flat["offsets"].flatten()
            else:
                found = [tokenizer.encode("" if x is None else x, None, False, "utf16") for x in batch.column(n).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.array([i for e in found for i in e.ids], pa.int32())
                start, end = (pa.array([s[k] for e in found for s in e.offsets], pa.int32()) for k in (0, 1))
            counts = np.diff(ends)
            number = (np.arange(int(ends[-1])) - np.repeat(ends[:-1], counts)).astype(np.int32)
            owner = pa.array(np.repeat(np.arange(len(batch)), counts))
            yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in batch.columns[:n]), pa.array(number), ids, start, end, pa.array(number % 2 == 1)], names=names)

    source = df.select(*keep, df[text].alias("_text"))
    fields = [*(T.StructField(c, T.IntegerType()) for c in names[n:-1]), T.StructField("odd", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([*source.select(*keep).schema.fields, *fields]))


def pad_batches(encoded: DataFrame, batch: str, pad_id: int = 0, pad_token: str = "[PAD]", multiple: int = 1, left: bool = False) -> DataFrame:
    """Encodings padded to the longest of their batch, rounded up to a multiple. batch: a column; its groups may be large."""
    longest = encoded.groupBy(batch).agg(F.max(F.size("ids")).alias("_n"))
    to = (F.ceil(F.col("_n") / multiple) * multiple).cast("int")
    joined = encoded.join(longest, batch)
    fill = {"ids": F.lit(pad_id), "type_ids": F.lit(0), "tokens": F.lit(pad_token), "words": F.lit(None).cast("int"), "special": F.lit(1), "attention": F.lit(0)}
    fill["offsets"] = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    return joined.select(*[columns.padded(F.col(c), to, fill[c], left).alias(c) if c in fill else F.col(c) for c in encoded.columns])


def vocabulary(spark: SparkSession, config: str) -> DataFrame:
    """token, id, added, special."""
    t = Tokenizer(config)
    rows = [(w, i, w in t.added.by_content, w in t.added.special) for w, i in t.vocab().items()]
    return spark.createDataFrame(rows, "token string, id int, added boolean, special boolean")


#: Line breaks.
BREAK = re.compile("\r\n|\n|\r")


def lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """line_no, line, start and end in characters; a trailing line break is followed by an empty line. No shuffle: rows are independent."""
    ship(df.sparkSession)
    n, names = len(keep), [*keep, "line_no", "line", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, n):
            owner, number, line, start, end = [], [], [], [], []
            for k, t in enumerate(batch.column(n).to_pylist()):
                t = t or ""
                at = 0
                ends = [(m.start(), m.end()) for m in BREAK.finditer(t)] + [(len(t), len(t))]
                for i, (stop, after) in enumerate(ends):
                    owner.append(k)
                    number.append(i)
                    line.append(t[at:stop])
                    start.append(at)
                    end.append(stop)
                    at = after
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:n]), pa.array(number, pa.int32()), pa.array(line, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=names)

    source = df.select(*keep, df[text].alias("_text"))
    fields = [T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    return source.mapInArrow(run, T.StructType([*source.select(*keep).schema.fields, *fields]))


def line_tokens(df: DataFrame, config: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each line with the first and the last token that lie in it, wholly or in part (null: none), found in one walk over both."""
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(config)
    n, names = len(keep), [*keep, "line_no", "start", "end", "first_token", "last_token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(held.value)
        for batch in in_parts(batches, n):
            rows = []
            for k, t in enumerate(batch.column(n).to_pylist()):
                t = t or ""
                places = tokenizer.encode(t, add_special=False, unit="char").offsets
                begin, low = 0, 0
                for i, m in enumerate([*BREAK.finditer(t), None]):
                    stop, after = (m.start(), m.end()) if m else (len(t), len(t))
                    while low < len(places) and places[low][1] <= begin:
                        low += 1
                    high = low
                    while high < len(places) and places[high][0] < stop:
                        high += 1
                    rows.append((k, i, begin, stop, low if high > low else None, high - 1 if high > low else None))
                    begin, low = after, max(low, high - 1)
            owner, *rest = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner, pa.int64())) for c in batch.columns[:n]), *(pa.array(c, pa.int32()) for c in rest)], names=names)

    source = df.select(*keep, df[text].alias("_text"))
    return source.mapInArrow(run, T.StructType([*source.select(*keep).schema.fields, *(T.StructField(c, T.IntegerType()) for c in names[n:])]))
