"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Texts become sets of hashed five-word shingles. Equal sets are one class, named by its smallest identifier. Classes
that share a band of their MinHash signatures are candidates; the number of rows in a band is the largest at which a
pair at the threshold is missed with at most the chosen probability. Signatures of candidates are compared in batches
of hashes, and a pair goes as soon as the posterior probability that it reaches the threshold (Beta prior, uniform)
falls below the chosen one. What survives is verified exactly on the full shingle sets; these hold 64-bit hashes of
the shingles, and texts themselves are never compared.

No group is ever expanded into all its pairs. First every class is compared with one representative of each of its
buckets. What that has linked is one component; then only pairs of different components of a bucket are left, and they
are compared in blocks of bounded size, so that no link is lost.

Null and empty texts have no shingles and are linked with nothing. Rows that share an identifier are one document with
several texts. Rows without identifier stand for themselves, as members with a null identifier. Repeated rows fall in
one class. An empty table gives no rows. Texts are read whole, other columns not at all.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.bpe import slices
from tokenloom.llm.common import components, salted_join, stored, trimmed
from tokenloom.llm.shingles import bytes_of, randoms, shingle_sets

HASHES, STEP = 130, 13
#: Identifiers are below this; classes without any are named above it.
NAMELESS = 1 << 62
BLOCK = 64
#: Identifiers of documents to be read again are broadcast up to this number; beyond it a shuffle joins them.
BROADCAST_IDS = 200_000


def banding(percent: int, miss: float) -> tuple[int, int]:
    """Bands, and rows in each: the most selective that miss a pair at the threshold at most so often."""
    t = percent / 100
    for rows in range(HASHES, 0, -1):
        bands = HASHES // rows
        if (1 - t**rows) ** bands <= miss:
            return bands, rows
    return HASHES, 1


def least_matches(percent: int, miss: float, hashes: int) -> np.ndarray:
    """By number of compared hashes: with fewer matches, P(similarity >= threshold) is below miss.

    Under a uniform prior that is P(Binomial(k + 1, threshold) <= matches).
    """
    t, out = percent / 100, np.zeros(hashes + 1, np.int64)
    for k in range(hashes + 1):
        total, m = 0.0, -1
        while total < miss and m <= k:
            m += 1
            total += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out[k] = m
    return out


def name_of(key: Column, digest: Column) -> Column:
    return F.coalesce(key, F.shiftrightunsigned(F.xxhash64(digest), 3) + F.lit(NAMELESS))


def sets_of(df: DataFrame, key: str, text: str, hashes: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and its signature of so many hashes, or with none the set itself."""
    turns, steps = randoms(hashes, 5) | np.uint64(1), randoms(hashes, 6)

    def signature(found: np.ndarray) -> np.ndarray:
        least, part = np.full(hashes, np.iinfo(np.uint64).max), np.empty((128, hashes), np.uint64)
        for at in range(0, len(found), 128):
            some = found[at : at + 128]
            out = part[: len(some)]
            np.multiply(some[:, None], turns, out=out)
            out += steps
            np.minimum(least, out.min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), 1_000_000):
                rows = batch.slice(part.start, part.stop - part.start)
                sets = shingle_sets(*bytes_of(rows.column(1)))
                sizes = np.array([len(s) for s in sets], np.int64)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                if hashes:
                    made = [signature(s) if len(s) else None for s in sets]
                    last = pa.array(made, pa.list_(pa.int32()))
                else:
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes), pa.array(digests, pa.binary()), last], names=names)

    names = ["doc_id", "n_shingles", "digest", "signature" if hashes else "shingles"]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.ArrayType(T.IntegerType() if hashes else T.LongType())]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    return df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(trimmed(run), schema)


def unlikely(matches: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of the pairs (rows of left and right signatures) that stay; batch by batch of hashes, the others go."""
    live = np.arange(len(left))
    got = np.zeros(len(left), np.int64)
    for at in range(0, left.shape[1], STEP):
        end = min(at + STEP, left.shape[1])
        got += (left[live, at:end] == right[live, at:end]).sum(axis=1)
        stay = got >= matches[end]
        live, got = live[stay], got[stay]
    return live


def flat_signatures(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def likely_pairs(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float, hashes: int) -> DataFrame:
    """The pairs (a, b) that Bayesian pruning of their signatures leaves."""
    matches = least_matches(percent, miss, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = pa.array(unlikely(matches, flat_signatures(batch.column(2)), flat_signatures(batch.column(3))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(live), batch.column(1).take(live)], names=["a", "b"])

    first = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    second = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    both = salted_join(pairs.join(first, "a"), second, ["b"], seed="a", counts=pairs.groupBy("b").count())
    sized = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a long, b long")


def sets_by_node(df: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """node and shingles of the documents with these identifiers (column _id), and of all without any; stored."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = df.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    wanted = rows.join(side, F.col("_key") == F.col("_id"), "left_semi").unionByName(rows.where(F.col("_key").isNull()))
    sets = sets_of(wanted, "_key", "_text", 0).where("n_shingles > 0")
    return stored(sets.select(name_of(F.col("doc_id"), F.col("digest")).alias("node"), "shingles"), "shingle-sets")


def exact_links(df: DataFrame, pairs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold. pairs: a stored table."""
    ids = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    sets = sets_by_node(df, ids, key, text)
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = salted_join(pairs.join(first, "a"), second, ["b"], seed="a", counts=pairs.groupBy("b").count())
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("_n", common).where(100 * F.col("_n") >= percent * (F.size("sa") + F.size("sb") - F.col("_n"))).select("a", "b").distinct()


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered x with those numbered y, pair by pair."""
    if len(x) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist())], np.int64)
    # Many pairs of few sets: the product of their incidence matrices, some shingles at a time.
    used = np.unique(np.concatenate([x, y]))
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used.tolist()])
    kinds, which = np.unique(np.concatenate([sets[k] for k in used.tolist()]), return_inverse=True)
    order = np.argsort(which, kind="stable")
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, len(kinds), 8192):
        rows = order[np.searchsorted(which[order], at) : np.searchsorted(which[order], at + 8192)]
        part = np.zeros((len(used), min(8192, len(kinds) - at)), np.float32)
        part[owner[rows], which[rows] - at] = 1
        total += part @ part.T
    return np.rint(total[np.searchsorted(used, x), np.searchsorted(used, y)]).astype(np.int64)


def cross_links(df: DataFrame, members: DataFrame, nodes: DataFrame, labels: DataFrame, key: str, text: str, percent: int, miss: float, bands: int) -> DataFrame:
    """Links between different components within the buckets, found in blocks of about BLOCK rows a side.

    Of each bucket, rows outside its largest component are compared with all its rows: first the signatures, then the
    full sets. A pair that shares several bands is compared in the first of them only. Pairs never become rows unless
    they are links.
    """
    rows = members.where("node <> rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = rows.groupBy("band", "label").count()
    active = groups.groupBy("band").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("count", "label")).alias("major"), F.max("count").alias("most"))
    active = active.where("labels > 1").select("band", "major", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("ni"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"))
    counts = groups.groupBy("band").agg(F.sum("count").alias("count"))
    rows = stored(salted_join(rows.select("band", "k", "node", "label"), active, ["band"], seed="node", counts=counts), "active-members")
    sets = sets_by_node(df, rows.select(F.col("node").alias("_id")).distinct(), key, text)
    full = nodes.select("node", "n_shingles", "signature").join(sets, "node").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("shingles").alias("shingles"))
    rows = rows.join(full, "node")
    stray = rows.where(F.col("label") != F.col("major")).select("*", F.lit(True).alias("stray"), F.pmod(F.xxhash64("node"), F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"))
    every = rows.select("*", F.lit(False).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("nj")).cast("int").alias("j"))
    blocks = stray.unionByName(every).groupBy("band", "i", "j").agg(F.collect_list(F.struct("stray", "k", "node", "label", "n_shingles", "signature", "shingles")).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = None
        for batch in batches:
            column = batch.column(0)
            values, ends = column.flatten(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column)))])
            if not len(values):
                continue
            is_stray, band, node, label, size = (np.asarray(values.field(k).to_numpy(zero_copy_only=False)) for k in range(5))
            signature = flat_signatures(values.field(5))
            if needed is None:
                needed = least_matches(percent, miss, signature.shape[1])
            lists = values.field(6)
            flat, at = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
            found = [np.zeros((2, 0), np.int64)]
            for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
                some = np.arange(start, stop)
                x, y = some[is_stray[start:stop]], some[~is_stray[start:stop]]
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
                on = (label[x] != label[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
                x, y = x[on], y[on]
                live = unlikely(needed, signature[x], signature[y])
                x, y = x[live], y[live]
                if len(x):
                    shared = (signature[x] == signature[y]).reshape(len(x), bands, -1).all(axis=2).argmax(axis=1)
                    x, y = x[shared == band[x]], y[shared == band[x]]
                if len(x):
                    sets = [flat[at[k] : at[k + 1]] for k in range(start, stop)]
                    n = common_counts(sets, x - start, y - start)
                    on = 100 * n >= percent * (size[x] + size[y] - n)
                    a, b = node[x[on]], node[y[on]]
                    found.append(np.stack([np.maximum(a, b), np.minimum(a, b)]))
            a, b = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return blocks.mapInArrow(trimmed(run), "a long, b long").distinct()


def near_duplicates(df: DataFrame, percent: int = 80, miss: float = 1e-6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles, component_id, kept."""
    bands, width = banding(percent, miss)
    hashes = bands * width
    found = stored(sets_of(df, key, text, hashes), "signatures")
    full = found.where("n_shingles > 0").withColumn("node", name_of(F.col("doc_id"), F.col("digest")))
    nodes = stored(full.groupBy("digest").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    banded = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * width + 1, F.lit(width))))).alias("k", "band"))
    buckets = stored(banded.groupBy("band").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("count")).where("count > 1"), "buckets")
    members = stored(salted_join(banded, buckets.drop("count"), ["band"], seed="node", counts=buckets.select("band", "count"), total=nodes.count() * bands), "bucket-members")
    star = stored(members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    likely = stored(likely_pairs(star, nodes, percent, miss, hashes), "likely-pairs")
    links = stored(exact_links(df, likely, key, text, percent), "links")
    links = links.unionByName(stored(cross_links(df, members, nodes, components(links), key, text, percent, miss, bands), "cross-links"))
    labels = nodes.select("digest", "node").join(components(links), "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    out = salted_join(found.select("doc_id", "n_shingles", "digest"), labels, ["digest"], "left", seed="doc_id")
    component = F.when(F.col("label") < NAMELESS, F.col("label")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(component, F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(df: DataFrame, percent: int = 80, miss: float = 1e-6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df of which one stays for each component, with df's columns."""
    gone = stored(near_duplicates(df, percent, miss, text, key).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(side, df[key] == F.col("_gone"), "left_anti")
