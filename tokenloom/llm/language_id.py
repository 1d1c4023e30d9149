"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product (binding) of its letters' vectors, the
first turned twice and the second once; a document is the sum (bundle) of its trigrams, a language's prototype the sum
of its documents' bundles at unit length. A document is given the language whose prototype has the largest cosine with
it. Letters outside the table share CLASSES classes by a hash of their code point.

Prototypes are fitted on a bounded sample, the `sample` distinct texts with the smallest hashes among those that may be
learned from, each once for each language that it is said to have; every row is predicted on its whole text. Texts that are null or without letters are `und` with
score 0. Ties go to the language that sorts first. Without any row to learn from, all rows are `und`. Repeated rows
are predicted alike. Identifiers, languages and sources are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.bpe import slices
from tokenloom.llm.common import bucket_of, trimmed, with_field
from tokenloom.llm.shingles import mix

DIMS = 512
CLASSES = 1024
SAMPLE = 8_000
#: Scores are a softmax of cosines at this sharpness.
SHARPNESS = 25.0
UNKNOWN = "und"
_U = np.uint64


def letter_vectors() -> np.ndarray:
    """+1 and -1 for each letter class, class 0 being the border of words."""
    x = mix(np.arange(CLASSES * DIMS, dtype=_U) + _U(0xA5A5))
    return np.where(x & _U(1), 1, -1).astype(np.float32).reshape(CLASSES, DIMS)


def letter_classes() -> np.ndarray:
    """The class of every code point: of letters a number above 0."""
    out = np.zeros(0x110000, np.int16)
    points = np.arange(0x110000, dtype=np.uint32)
    text = points.copy()
    text[0xD800:0xE000] = 32
    letters = np.fromiter(map(str.isalpha, text.tobytes().decode("utf-32-le")), bool, 0x110000)
    hashed = 27 + (mix(points.astype(_U)) % _U(CLASSES - 27)).astype(np.int16)
    out[letters] = hashed[letters]
    out[97:123] = np.arange(1, 27)
    return out


_TABLES: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend([letter_classes(), letter_vectors()])
    return _TABLES


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, trigram codes and counts of all distinct trigrams of each, and each document's letters."""
    classes, _ = tables()
    parts = []
    letters = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        code = classes[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        letters[k] = np.count_nonzero(code)
        if not letters[k]:
            continue
        code = np.concatenate([[0], code, [0]]).astype(np.int64)
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]  # one border between words
        grams = (code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:]
        grams = grams[code[1:-1] != 0]
        kinds, counts = np.unique(grams, return_counts=True)
        parts.append((np.full(len(kinds), k), kinds, counts))
    if not parts:
        return (*(np.zeros(0, np.int64) for _ in range(3)), letters)
    return (*(np.concatenate(p) for p in zip(*parts)), letters)


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's bundle at unit length, and its number of letters."""
    _, vectors = tables()
    owner, grams, counts, letters = trigram_counts(texts)
    kinds, back = np.unique(grams, return_inverse=True)
    out = np.zeros((len(texts), DIMS), np.float32)
    turned = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors
    order = np.argsort(back, kind="stable")
    for at in range(0, len(kinds), 4096):
        part = kinds[at : at + 4096]
        bound = turned[0][part // CLASSES // CLASSES] * turned[1][part // CLASSES % CLASSES] * turned[2][part % CLASSES]
        rows = order[np.searchsorted(back[order], at) : np.searchsorted(back[order], at + len(part))]
        weights = np.zeros((len(texts), len(part)), np.float32)
        weights[owner[rows], back[rows] - at] = counts[rows]
        out += weights @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9), letters


def bundled(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), 1_000_000):
        rows = batch.slice(part.start, part.stop - part.start)
        yield rows, *bundles([t or "" for t in rows.column(column).to_pylist()])


def learn(df: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A prototype at unit length for each language, from at most `sample` rows. df: only rows that may be learned from."""
    usable = df.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).where("_lang is not null and _text is not null")
    # The sample is chosen by distinct hashes alone: no text is sorted, and copies take no one's place.
    usable = usable.withColumn("_h", F.xxhash64("_text"))
    last = usable.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if last is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, found, letters in bundled(batch, 1):
                names = rows.column(0).to_pylist()
                for k in np.flatnonzero(letters).tolist():
                    sums[names[k]] = sums.get(names[k], 0) + np.rint(found[k] * 65536).astype(np.int64)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["lang", "total"])

    rows = usable.where(F.col("_h") <= last).dropDuplicates(["_lang", "_h"])
    parts = rows.select("_lang", "_text").mapInArrow(trimmed(run), "lang string, total array<bigint>")
    summed = parts.select("lang", F.posexplode("total")).groupBy("lang", "pos").agg(F.sum("col").alias("n")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("v"))
    found = {r["lang"]: np.array([x["n"] for x in r["v"]], np.float64) for r in summed.collect()}
    return {k: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for k, v in sorted(found.items())}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of keep, lang_pred and score."""
    names, held = list(prototypes), df.sparkSession.sparkContext.broadcast(np.array(list(prototypes.values()), np.float32).reshape(-1, DIMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found, letters in bundled(batch, len(keep)):
                if names:
                    cosine = found @ held.value.T
                    best = cosine.argmax(axis=1)
                    share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                    score = 1 / share.sum(axis=1)
                known = (letters > 0) & bool(names)
                lang = [names[best[k]] if known[k] else UNKNOWN for k in range(len(letters))]
                scores = [min(1.0, float(score[k])) if known[k] else 0.0 for k in range(len(letters))]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(scores, pa.float64())], names=out)

    out = [*keep, "lang_pred", "score"]
    source = df.select(*keep, df[text].alias("_text"))
    schema = with_field(with_field(source.select(*keep).schema, "lang_pred", T.StringType()), "score", T.DoubleType())
    return source.mapInArrow(trimmed(run), schema)


def may_learn(key: str = "doc_id", modulus: int = 4, held: int = 2):
    """Rows that are not held out."""
    return bucket_of(key, modulus) != held
