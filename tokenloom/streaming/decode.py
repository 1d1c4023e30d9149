"""Incremental decoding of streams of token ids, with the decoder's state per stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenloom.functions.tokenizer import StreamDecoder, compiled
from tokenloom.session import ship

OUT = "stream_id long, seq long, text string"
STATE = "context array<int>, pending array<int>"


def decode_stream(tokens: DataFrame, config: str, skip_special: bool = True) -> DataFrame:
    """A stream of (stream_id, seq, id): the text that each id completes; ids that complete none give no row.

    Rows of a stream are taken in order of seq within each batch; across batches they must arrive in order.
    """
    ship(tokens.sparkSession)
    held = tokens.sparkSession.sparkContext.broadcast(config)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        context, pending = state.get if state.exists else ([], [])
        decoder = StreamDecoder(compiled(held.value), skip_special, list(context), list(pending))
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], s, t) for s, i in zip(rows["seq"], rows["id"]) if (t := decoder.step(int(i))) is not None]
        state.update((decoder.context, decoder.pending))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return tokens.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def decode_steps(tokens: DataFrame, config: str, skip_special: bool = True) -> DataFrame:
    """The same over a table: all rows of a stream are in it. A stream passes through its task in order and is never held whole."""
    ship(tokens.sparkSession)
    held = tokens.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, decoder = None, None
        for batch in batches:
            out = []
            for stream, seq, i in zip(*(c.to_pylist() for c in batch.columns)):
                if decoder is None or stream != now:
                    now, decoder = stream, StreamDecoder(compiled(held.value), skip_special)
                if (text := decoder.step(i)) is not None:
                    out.append((stream, seq, text))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else ((), (), ()), kinds)], names=["stream_id", "seq", "text"])

    rows = tokens.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("id").cast("int").alias("id"))
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, OUT)
