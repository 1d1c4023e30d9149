"""A quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Texts are read as words: runs of letters and digits, and runs of marks, each in its own case. Every word has a sparse
random index vector that its hash determines. A word's context vector is the sum of the index vectors of its neighbours
over all texts, labelled or not; words that make up at least a COMMON-th of all words of the corpus have one, so the
table has COMMON rows at most, and what rarer words say is in their index vectors. A document is the mean of its words'
context vectors, of their index vectors, and of the products of adjacent words' index vectors, and the number pooled. A two-layer network on these is trained in
numpy, and a temperature fitted on rows apart from the training ones turns its outputs into probabilities.

The network and its temperature are fitted on a bounded sample of labelled rows: the `sample` rows with the smallest hashes of their
identifiers, of those that may be learned from. Every row is scored on its whole text. Null and empty texts get the
score of a document without words. Repeated rows are scored alike; where an identifier has several labels, each pair
counts as a row. Without any labelled row, or with labels of one kind only, scores are that kind's share (0.5 without
any). Identifiers, languages, sources and labels are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.bpe import slices
from tokenloom.llm.common import bucket_of, stored, trimmed, with_field
from tokenloom.llm.shingles import IS_SPACE, bytes_of, mix, randoms, spans

#: A word with at least this share of all words has a context vector; there are COMMON such words at most.
COMMON = 1 << 17
DIMS, REACH, ENTRIES = 32, 2, 4
SAMPLE = 12_000
_U = np.uint64
#: Kinds of bytes: white space, letters and digits (and all beyond ASCII), marks.
KIND = np.ones(256, np.uint8)
KIND[[b for b in range(128) if not chr(b).isalnum()]] = 2
KIND[IS_SPACE] = 0
BYTE, PLACE = randoms(256, 31), randoms(64, 37) | _U(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and how many lie before each offset."""
    hashes, begins = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    for at, end in spans(data):
        part = data[at:end]
        kind = KIND[part]
        starts = np.flatnonzero(border[at:end] | np.concatenate([[True], kind[1:] != kind[:-1]]))
        inner = np.arange(len(part)) - np.repeat(starts, np.diff(np.append(starts, len(part))))
        sums = np.add.reduceat(BYTE[part] * PLACE[inner & 63] + (inner >> 6).astype(_U), starts)
        on = kind[starts] != 0
        hashes.append(mix(sums[on]))
        begins.append(starts[on] + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offsets)


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the entries of each word's index vector, and their signs."""
    bits = hashes[:, None] >> (_U(8) * np.arange(ENTRIES, dtype=_U) + _U(16))
    return (bits & _U(DIMS - 1)).astype(np.int64), np.where(bits & _U(DIMS), 1, -1).astype(np.int32)


def pooled(table: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the table's rows over each document's words, in pieces of bounded size; no row: -1."""
    out = np.zeros((len(bounds) - 1, table.shape[1]), np.float32)
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for at in range(a, b, 1 << 14):
            some = rows[at : min(b, at + (1 << 14))]
            out[k] += table[some[some >= 0]].sum(axis=0)
    return out


def index_pools(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of each document's words, and of the products of those of adjacent words."""
    places, signs = index_entries(hashes)
    vectors, every = np.zeros((len(hashes), DIMS), np.int8), np.arange(len(hashes))
    for k in range(ENTRIES):
        vectors[every, places[:, k]] += signs[:, k].astype(np.int8)
    products = vectors.copy()
    products[:-1] *= vectors[1:]
    products[bounds[1:][np.diff(bounds) > 0] - 1] = 0  # a document's last word has no successor
    out, some = np.zeros((len(bounds) - 1, 2 * DIMS), np.float32), np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some, :DIMS] = np.add.reduceat(vectors, bounds[some], axis=0, dtype=np.int32)
        out[some, DIMS:] = np.add.reduceat(products, bounds[some], axis=0, dtype=np.int32)
    return out


def rows_of(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes among the sorted keys; -1 where a key is missing."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def context_sums(hashes: np.ndarray, bounds: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds to each row of out the index vectors of its word's neighbours, each place turned its own way."""
    places, signs = index_entries(hashes)
    owner, flat = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), out.reshape(-1)
    for step in range(1, REACH + 1):
        together = np.flatnonzero(owner[step:] == owner[:-step])
        for one, other, turn in ((together, together + step, step), (together + step, together, -step)):
            on = rows[one] >= 0
            one, other = one[on], other[on]
            np.add.at(flat, (rows[one][:, None] * DIMS + ((places[other] + turn) & (DIMS - 1))).ravel(), signs[other].ravel())


@dataclass
class Model:
    """Everything that scoring needs: the common words with their vectors, the network and its temperature."""

    keys: np.ndarray
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(forward(self.layers, x)[0] / self.temperature, -40, 40)))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden @ w2 + b2[0], hidden


def train(x: np.ndarray, y: np.ndarray, width: int = 24, rounds: int = 60, batch: int = 64, seed: int = 7) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss, both kinds weighted alike."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], width)), np.zeros(width), rng.normal(0, 1 / np.sqrt(width), width), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    step = 0
    for _ in range(max(rounds, min(600, 60_000 // max(len(x), 1)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            z, hidden = forward(layers, x[rows])
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * weight[rows] / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            grads = [x[rows].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                layers[k] = layers[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if step > 6000:
            break
    return layers


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.1), np.log(16), 80))
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(features: np.ndarray, labels: np.ndarray, order: np.ndarray, keys: np.ndarray, table: np.ndarray) -> Model:
    """order: numbers that deal the rows out; every sixth is kept for the temperature."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(keys, table, np.zeros(1), np.ones(1), [], 1.0, float(labels.mean()) if len(labels) else 0.5)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-3
    x, y = (features - mean) / scale, labels.astype(np.float64)
    apart = order % 6 == 0
    if len(np.unique(y[~apart])) < 2:
        apart[:] = False
    layers = train(x[~apart], y[~apart])
    held = apart if apart.any() else ~apart
    return Model(keys, table, mean, scale, layers, calibrated(forward(layers, x[held])[0], y[held]))


def text_parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), 500_000):
        rows = batch.slice(part.start, part.stop - part.start)
        yield rows, *tokens(*bytes_of(rows.column(column)))


def featured(batch: pa.RecordBatch, column: int, keys: np.ndarray, table: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rows, hashes, bounds in text_parts(batch, column):
        n = np.diff(bounds)
        sums = np.concatenate([pooled(table, rows_of(keys, hashes), bounds), index_pools(hashes, bounds)], axis=1)
        yield rows, np.concatenate([sums / np.maximum(n, 1)[:, None], np.log1p(n)[:, None]], axis=1).astype(np.float32)


def common_words(texts: DataFrame, common: int = COMMON) -> np.ndarray:
    """Hashes of the words with at least a `common`-th of all words of the texts (the only column), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        for batch in batches:
            for _, hashes, _ in text_parts(batch, 0):
                words, back = np.unique(np.concatenate([words, hashes]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, np.ones(len(hashes))]), len(words)).astype(np.int64)
                if len(words) > 1 << 18:
                    yield emitted(words, counts)
                    words, counts = words[:0], counts[:0]
        yield emitted(words, counts)

    def emitted(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    counts = stored(texts.mapInArrow(trimmed(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * common >= total).select("word").toArrow()
    return np.sort(np.asarray(found["word"].combine_chunks()).view(_U))


def context_table(texts: DataFrame, keys: np.ndarray) -> np.ndarray:
    """The context vector, at unit length, of each word of keys over all texts (the only column)."""
    held, names = texts.sparkSession.sparkContext.broadcast(keys), [f"d{k}" for k in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(held.value), DIMS), np.int32)
        for batch in batches:
            for _, hashes, bounds in text_parts(batch, 0):
                context_sums(hashes, bounds, rows_of(held.value, hashes), total)
        some = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(some), 20_000):
            rows = some[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(total[rows, k]) for k in range(DIMS))], names=["row", *names])

    summed = texts.mapInArrow(trimmed(run), "row int, " + ", ".join(f"{c} int" for c in names)).groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    table = np.zeros((len(keys), DIMS), np.float64)
    # Sums of whole numbers: the same in any order.
    table[np.asarray(summed["row"].combine_chunks())] = np.stack([np.asarray(summed[c].combine_chunks()).astype(np.float64) for c in names], axis=1)
    return (table / (np.linalg.norm(table, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


def learn(df: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the texts of df, and at most `sample` of its labelled rows. labels: only those that may be learned from."""
    usable = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).where("_key is not null and _y is not null")
    chosen = usable.orderBy(F.xxhash64("_key"), "_key", "_y").limit(sample)
    rows = stored(df.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_key")).select("_key", "_y", F.col(text).alias("_text")), "quality-sample")

    texts = df.select(F.col(text).alias("_text"))
    keys = common_words(texts)
    table = context_table(texts, keys)
    held = df.sparkSession.sparkContext.broadcast((keys, table))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in featured(batch, 2, *held.value):
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["k", "y", "x"])

    found = rows.select(F.xxhash64("_key").alias("k"), F.col("_y").alias("y"), "_text").mapInArrow(trimmed(vectors), "k long, y int, x binary").collect()
    found.sort(key=lambda r: (r["k"], r["y"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]) if found else np.zeros((0, 1), np.float32)
    y, order = np.array([r["y"] for r in found]), np.array([r["k"] for r in found], np.int64)
    return fit(x, y, order, keys, table)


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of keep, and score: the probability that the label is 1."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in featured(batch, len(keep), held.value.keys, held.value.table):
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(held.value.scores(x), pa.float64())], names=names)

    names = [*keep, "score"]
    source = df.select(*keep, df[text].alias("_text"))
    return source.mapInArrow(trimmed(run), with_field(source.select(*keep).schema, "score", T.DoubleType()))


def accepted(df: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of df whose score reaches `least`, with df's columns."""
    held, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in featured(batch, at, held.value.keys, held.value.table):
                yield some.filter(pa.array(held.value.scores(x) >= least))

    return df.mapInArrow(trimmed(run), df.schema)


def may_learn(key: str = "doc_id", modulus: int = 5):
    """Rows that are not held out."""
    return bucket_of(key, modulus) != 0
