"""Language-model scores by online logistic mixing of context bit predictors.

Text is read as lower-cased (A-Z) UTF-8 bytes with an end symbol. Each bit of a byte is predicted in contexts of the
last 1 to 5 bytes, and of those of the last 5 that belong to its word; each context has exact counts of zeros and ones
of its own, from all training rows. Weights, chosen by bit place and by how many contexts are well known (the gate),
combine the predictors' log odds. They are learned online: each task passes once over its windows, in an order that their
hashes deal, and steps after every few; the means of the weights on the way, over all tasks, start the next pass. A window
is predicted from the counts without itself, and counts as often as it occurs. An adaptive map from predicted to observed
odds, one for each node of the byte tree, refines the mix. The product over all bits is the probability of the text.

Beside it stands the plain unigram score with add-one smoothing over words.

All training rows are counted in Spark, and the counts stay there: windows with the same last two bytes of context meet
in one task, which counts their longer contexts exactly. What one window is worth depends on its six bytes only, so each
chunk of rows asks for its distinct windows and words once, and the answers meet the chunk's texts. Questions stream past
the counts, so a task's memory holds the counts of its contexts and one chunk's answers, whatever the number of chunks.

Null texts count as empty; an empty text has the end alone. Without training rows all counts are zero and every bit has
odds of one. Repeated rows are scored each on its own. Only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.bpe import slices
from tokenloom.llm.common import bucket_of, stored, trimmed
from tokenloom.llm.shingles import LOWER, bytes_of, mix, words

_U = np.uint64
ORDERS = 6
#: By order: the bytes of a window that its context and the current byte take.
MASKS = np.array([(1 << (8 * (k + 1))) - 1 for k in range(ORDERS)], _U)
SHORT = 1 << 16
#: Windows in a task, in the mean.
TASK_WINDOWS = 150_000
#: Rows that share their answers, as a power of two: as many as leave each core some chunks, but CHUNK_BITS at most.
CHUNK_BITS = 13
LEVELS = 6
BINS = 33
MEMORY_BITS = 21
#: Sums of tasks that are added up in one step.
FAN = 32
#: Windows between two steps of the weights, and the size of steps.
STEP_WINDOWS, RATE = 128, 0.05
END_BYTE = 0xFF
END_WORD = np.int64(0x5EED0E4D)
PRIOR = 0.4
LOWER_BYTE = LOWER.astype(np.uint8)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte windows that end at each byte of each text and at its end symbol, and where each text's windows end."""
    n_docs = len(offsets) - 1
    sizes = np.diff(offsets)
    # Each text is laid out behind five zero bytes and before its end symbol.
    starts = np.concatenate([[0], np.cumsum(sizes + ORDERS)])
    flat = np.zeros(int(starts[-1]), np.uint8)
    keep = np.ones(len(flat), bool)
    lead = (starts[:-1, None] + np.arange(ORDERS - 1)).ravel()
    keep[lead] = False
    flat[starts[1:] - 1] = END_BYTE
    body = keep.copy()
    body[starts[1:] - 1] = False
    flat[body] = LOWER_BYTE[data]
    keys = flat.astype(_U)
    for k in range(1, ORDERS):
        keys[k:] |= flat[:-k].astype(_U) << _U(8 * k)
    return keys[keep], np.cumsum(sizes + 1) if n_docs else np.zeros(0, np.int64)


def word_bytes(keys: np.ndarray) -> np.ndarray:
    """How many of the five bytes before the current one belong to its word."""
    count, inside = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for k in range(1, ORDERS):
        byte = (keys >> _U(8 * k)) & _U(0xFF)
        inside &= (byte != 32) & ((byte < 9) | (byte > 13)) & (byte != 0)
        count += inside
    return count


def path_counts(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values: sorted and distinct, a context and a byte each. How often the context occurs, with each number of the byte's bits."""
    sums, out = np.concatenate([[0], np.cumsum(n)]), np.zeros((9, len(values)), np.int64)
    for place in range(9 if len(values) else 0):
        part = values >> _U(8 - place)
        firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(firsts[1:], len(values))
        out[place] = np.repeat(sums[ends] - sums[firsts], ends - firsts)
    return out


def odds_of(paths: np.ndarray, without: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value and bit place: log odds of the byte's own bit, and whether its context was seen at least twice."""
    own, other = paths[1:] - without, paths[:-1] - paths[1:]
    return np.log((own + PRIOR) / (other + PRIOR)).astype(np.float32).T.copy(), (paths[:-1] - without >= 2).astype(np.int8).T.copy()


class Contexts:
    """The odds of all contexts among windows (keys and n) whose contexts end in the same two bytes; short: counts of the shorter ones.

    without: occurrences of a window itself to leave out.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, short: np.ndarray, without: int):
        inside, every = word_bytes(keys), np.arange(SHORT).astype(_U)
        # Values that don't occur can't be asked for without themselves.
        self.small = [odds_of(np.maximum(path_counts(every, short[k]), [[without]]), without) for k in range(2)]
        self.tables = []
        for order in range(ORDERS):
            if order == 1:
                self.tables.append(None)
                continue
            long = inside >= 2 if order == 0 else slice(None)
            masked = keys[long] & MASKS[inside[long] if order == 0 else order]
            # Words of different lengths may end in the same bytes: the length tells their contexts apart.
            if order == 0:
                masked = masked | (inside[long].astype(_U) << _U(8 * ORDERS))
            values, back = np.unique(masked, return_inverse=True)
            counts = path_counts(values, np.bincount(back, n[long], len(values)).astype(np.int64))
            odds, known = odds_of(np.maximum(counts, without), without)
            small = counts.astype(np.int32) if not counts.size or counts.max() < 1 << 31 else counts
            self.tables.append((values, small, odds, known))

    def inputs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window: the inputs by bit place and order, and the gate by bit place."""
        inside, low = word_bytes(keys), (keys & _U(SHORT - 1)).astype(np.int64)
        out, level = np.zeros((len(keys), 8, ORDERS), np.float32), np.zeros((len(keys), 8), np.int8)
        for order in range(ORDERS):
            if order == 1:
                odds, known = self.small[1]
                out[:, :, 1], level = odds[low], level + known[low]
                continue
            rows = np.arange(len(keys))
            if order == 0:
                odds, known = self.small[0]
                some = np.flatnonzero(inside < 2)
                at = np.where(inside[some] == 1, low[some], low[some] & 0xFF)
                out[some, :, 0], level[some] = odds[at], level[some] + known[at]
                rows = np.flatnonzero(inside >= 2)
            values, counts, odds, known = self.tables[order]
            if not len(values) or not len(rows):
                continue
            masked = keys[rows] & MASKS[inside[rows] if order == 0 else order]
            if order == 0:
                masked = masked | (inside[rows].astype(_U) << _U(8 * ORDERS))
            at = np.searchsorted(values, masked)
            place = np.minimum(at, len(values) - 1)
            hit = values[place] == masked
            out[rows[hit], :, order], level[rows[hit]] = odds[place[hit]], level[rows[hit]] + known[place[hit]]
            lost = np.flatnonzero(~hit)
            if len(lost):  # a byte that its context never had: the path leaves the known ones somewhere
                paths = absent_counts(values, counts, masked[lost], at[lost])
                odds, known = odds_of(paths, 0)
                out[rows[lost], :, order], level[rows[lost]] = odds, level[rows[lost]] + known
        return out, np.maximum(level.astype(np.int64) - 1, 0)


def absent_counts(values: np.ndarray, counts: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """path_counts for values that aren't among the sorted ones; at: where they would stand.

    Values with the same first bits lie side by side, so a path is known from the neighbour that shares the most of it.
    """
    out = np.zeros((9, len(asked)), np.int64)
    for neighbour in (np.maximum(at - 1, 0), np.minimum(at, len(values) - 1)):
        for place in range(9):
            shared = values[neighbour] >> _U(8 - place) == asked >> _U(8 - place)
            out[place, shared] = counts[place, neighbour[shared]]
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Mixer:
    """What scoring needs: the table of window counts, which stays in Spark, and tables of bounded size."""

    grams: DataFrame | None  # key and n of all windows
    tasks: int
    short: np.ndarray  # counts of contexts of less than two bytes: of the word so far, and of order 1
    weights: np.ndarray  # by bit place and gate: a weight for each order
    refine: np.ndarray  # by node and bin of the mix: the observed probability

    def log10_of(self, contexts: Contexts, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte in the context of the others."""
        out, byte = np.zeros(len(keys)), (keys & _U(0xFF)).astype(np.int64)
        inputs, level = contexts.inputs(keys)
        for place in range(8):
            bit = (byte >> (7 - place)) & 1
            s = (inputs[:, place] * self.weights[place, level[:, place]]).sum(axis=1) * (2 * bit - 1)
            p = 0.5 * (squash(s) + self.refine[(byte >> (8 - place)) | (1 << place), bins(s)])
            out += np.log10(np.where(bit == 1, p, 1 - p))
        return out

    def answers(self, counts: DataFrame, asked: DataFrame) -> DataFrame:
        """chunk, kind, key and value of what is asked for (chunk, kind, key): of windows what they are worth, of words their counts."""
        said = Mixer(None, self.tasks, self.short, self.weights, self.refine)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            met: list[tuple[np.ndarray, ...]] = []
            known = None

            def answered() -> Iterator[pa.RecordBatch]:
                chunk, kind, key = (np.concatenate(x) for x in zip(*met))
                met.clear()
                for of in (0, 1):
                    rows = np.flatnonzero(kind == of)
                    kinds, back = np.unique(key[rows], return_inverse=True)
                    if of == 0:
                        at = np.minimum(np.searchsorted(known[0], kinds), max(len(known[0]) - 1, 0))
                        value = np.where(known[0][at] == kinds, known[1][at], 0).astype(float) if len(known[0]) else np.zeros(len(kinds))
                    else:
                        value = np.concatenate([said.log10_of(known[2], kinds[a : a + 50_000]) for a in range(0, len(kinds), 50_000)] or [np.zeros(0)])
                    for a in range(0, len(rows), 100_000):
                        some = rows[a : a + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(chunk[some]), pa.array(kind[some]), pa.array(key[some].view(np.int64)), pa.array(value[back[a : a + 100_000]])], names=["chunk", "kind", "key", "value"])

            for batch in batches:
                chunk, kind, key, n = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(_U), np.asarray(batch.column(3))
                facts = np.count_nonzero(n)  # they come first
                if facts:
                    held.append((kind[:facts], key[:facts], n[:facts]))
                if facts < len(n):
                    if known is None:
                        of, keys, times = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int8), np.zeros(0, _U), np.zeros(0, np.int64))
                        order = np.argsort(keys[of == 0])
                        known = keys[of == 0][order], times[of == 0][order], Contexts(keys[of == 1], times[of == 1], said.short, 0)
                        held.clear()
                    met.append((chunk[facts:], kind[facts:], key[facts:]))
                    if sum(len(m[0]) for m in met) >= 400_000:
                        yield from answered()
            if met:
                yield from answered()

        # Counts are one at least: a row with none is a question. Questions stand behind the counts.
        rows = counts.select(F.lit(0).cast("long").alias("chunk"), "kind", "key", "n").unionByName(asked.select("chunk", "kind", "key", F.lit(0).cast("long").alias("n")))
        return dealt(rows, self.tasks).sortWithinPartitions(F.when(F.col("n") == 0, 1).otherwise(0)).mapInArrow(trimmed(run), "chunk long, kind byte, key long, value double")

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of a few windows' last byte in the context of the others."""
        if not len(keys):
            return np.zeros(0)
        kinds, place = np.unique(keys, return_inverse=True)
        asked = self.grams.sparkSession.createDataFrame([(0, 1, int(k)) for k in kinds.view(np.int64)], "chunk long, kind byte, key long")
        found = self.answers(self.grams.select(F.lit(1).cast("byte").alias("kind"), "key", "n"), asked).toArrow()
        got, worth = np.asarray(found["key"].combine_chunks()).view(_U), np.asarray(found["value"].combine_chunks())
        return worth[np.argsort(got)][place]


def dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt out so that windows with the same last two bytes of context meet, and so do equal words."""
    return rows.repartition(tasks, F.when(F.col("kind") == 1, F.col("key").bitwiseAND(F.lit(0xFFFF00).cast("long"))).otherwise(F.col("key")))


def by_context(rows: DataFrame, tasks: int) -> DataFrame:
    """Windows dealt out so that those with the same last two bytes of context meet."""
    return rows.select("key", "n").repartition(tasks, F.col("key").bitwiseAND(F.lit(0xFFFF00).cast("long")))


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.asarray(b.column(0)).view(_U), np.asarray(b.column(1))) for b in batches]
    return (np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])) if parts else (np.zeros(0, _U), np.zeros(0, np.int64))


def bins(s: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(s, -8, 8) + 8) * ((BINS - 1) / 16)).astype(np.int64)


def text_parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), most):
        rows = batch.slice(part.start, part.stop - part.start)
        yield rows, *bytes_of(rows.column(column))


class Tally:
    """How often each key was met."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, _U), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        kinds, n = np.unique(keys, return_counts=True)
        place = np.minimum(np.searchsorted(self.keys, kinds), max(len(self.keys) - 1, 0))
        old = self.keys[place] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
        self.n[place[old]] += n[old]
        if not old.all():
            keys = np.concatenate([self.keys, kinds[~old]])
            order = np.argsort(keys, kind="stable")  # two sorted runs
            self.keys, self.n = keys[order], np.concatenate([self.n, n[~old]])[order]


def corpus_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """kind ('word' or 'window'), key and n: how often each word (by its hash) and six-byte window occurs in df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Tally(), Tally()]
        for batch in batches:
            for rows, data, offsets in text_parts(batch, 0, 2_000_000):
                held[0].add(np.append(words(data, offsets)[0], np.full(rows.num_rows, END_WORD).view(_U)))
                held[1].add(windows(data, offsets)[0])
                for kind in (0, 1):
                    if len(held[kind].keys) > 1 << 20:
                        yield from emitted(kind, held[kind])
                        held[kind] = Tally()
        for kind in (0, 1):
            yield from emitted(kind, held[kind])

    def emitted(kind: int, tally: Tally) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(tally.keys), 200_000):
            keys, n = tally.keys[at : at + 200_000], tally.n[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

    counts = df.select(F.col(text).alias("_text")).mapInArrow(trimmed(run), "kind byte, key long, n long")
    return counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def short_counts(grams: DataFrame) -> np.ndarray:
    """Counts by context and byte, of the word so far where it has less than two bytes, and of the last byte."""
    byte = [F.shiftright("key", 8 * k).bitwiseAND(F.lit(0xFF).cast("long")) for k in range(3)]
    out = np.zeros((2, SHORT), np.int64)
    apart = (byte[2] == 32) | byte[2].between(9, 13) | (byte[2] == 0)
    for r in grams.groupBy(F.col("key").bitwiseAND(F.lit(SHORT - 1).cast("long")).alias("key"), apart.alias("apart")).agg(F.sum("n").alias("n")).toLocalIterator():
        out[1, r["key"]] += r["n"]
        before = r["key"] >> 8
        if before in (0, 32) or 9 <= before <= 13:
            out[0, r["key"] & 0xFF] += r["n"]
        elif r["apart"]:
            out[0, r["key"]] += r["n"]
    return out


def summed(rows: DataFrame, tasks: int, size: int, measure) -> np.ndarray:
    """The sum over all tasks of the `size` numbers that measure(keys, n) gives for a task's windows: a row for each task, FAN of them added at a time."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = gathered(batches)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array([measure(keys, n).tobytes()], pa.binary())], names=["v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    found, parts = by_context(rows, tasks).mapInArrow(trimmed(measured), "v binary"), tasks
    while parts > FAN:
        parts = -(-parts // FAN)
        found = found.repartition(parts).mapInArrow(trimmed(added), "v binary")
    return sum((np.frombuffer(r["v"]) for r in found.toLocalIterator()), np.zeros(size))


def learn(counts: DataFrame, passes: int = 2) -> Mixer:
    """The mixer from stored corpus counts: so many online passes for the weights, and one for the refinement."""
    grams = counts.where("kind = 1").select("key", "n")
    total = grams.count()
    tasks, short = max(8, -(-total // TASK_WINDOWS)), short_counts(grams)
    cells = 8 * LEVELS

    def walked(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By bit place and gate: the mass met, and the sum over the way of mass times weights."""
        contexts, local, power = Contexts(keys, n, short, 1), weights.reshape(cells, ORDERS).copy(), np.zeros((cells, ORDERS))
        out, unit = np.zeros((cells, 1 + ORDERS)), n.mean()
        order = np.argsort(mix(keys + _U(seed)), kind="stable")
        for start in range(0, len(order), 50_000):
            rows = order[start : start + 50_000]
            inputs, level = contexts.inputs(keys[rows])
            level += np.arange(8) * LEVELS
            weight = n[rows] / unit
            for at in range(0, len(rows), STEP_WINDOWS):
                x, cell, mass = inputs[at : at + STEP_WINDOWS], level[at : at + STEP_WINDOWS], weight[at : at + STEP_WINDOWS, None]
                error = (1 - squash((x * local[cell]).sum(axis=2))) * mass
                where = cell.ravel()
                slope = np.stack([np.bincount(where, (error * x[:, :, k]).ravel(), cells) for k in range(ORDERS)], axis=1)
                power += slope**2
                local += RATE * slope / (np.sqrt(power) + 1e-6)
                met = np.bincount(where, np.repeat(mass[:, 0], 8), cells) * unit
                out[:, 0] += met
                out[:, 1:] += met[:, None] * local
        return out.ravel()

    def refined(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By node and bin: the windows, and those with a one."""
        contexts, out = Contexts(keys, n, short, 1), np.zeros((2, 256 * BINS))
        for start in range(0, len(keys), 50_000):
            rows = slice(start, start + 50_000)
            inputs, level = contexts.inputs(keys[rows])
            byte, weight = (keys[rows] & _U(0xFF)).astype(np.int64), n[rows].astype(float)
            for place in range(8):
                bit = (byte >> (7 - place)) & 1
                s = (inputs[:, place] * weights[place, level[:, place]]).sum(axis=1) * (2 * bit - 1)
                cell = ((byte >> (8 - place)) | (1 << place)) * BINS + bins(s)
                out[0] += np.bincount(cell, weight, 256 * BINS)
                out[1] += np.bincount(cell, weight * bit, 256 * BINS)
        return out.ravel()

    weights = np.full((8, LEVELS, ORDERS), 0.3)
    for seed in range(passes if total else 0):
        found = summed(grams, tasks, cells * (1 + ORDERS), walked).reshape(8, LEVELS, 1 + ORDERS)
        met = found[:, :, :1] > 0
        weights = np.where(met, found[:, :, 1:] / np.where(met, found[:, :, :1], 1), weights)
    seen, ones = summed(grams, tasks, 2 * 256 * BINS, refined).reshape(2, 256, BINS) if total else np.zeros((2, 256, BINS))
    start = np.tile(squash(np.linspace(-8, 8, BINS)), (256, 1))
    return Mixer(grams, tasks, short, weights, np.clip((ones + 4 * start) / (seen + 4), 1e-5, 1 - 1e-5))


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys) >> _U(64 - bits)).astype(np.int64)


class Met:
    """Distinct keys of a chunk: most that were met before are known from a table of one key a slot and are not sorted again."""

    def __init__(self, bits: int):
        self.bits, self.tags, self.parts = bits, np.full(1 << bits, ~_U(0)), []

    def add(self, keys: np.ndarray) -> None:
        for at in range(0, len(keys), 1 << 17):
            some = keys[at : at + (1 << 17)]
            slot = slots(some, self.bits)
            fresh = self.tags[slot] != some
            self.tags[slot] = some
            self.parts.append(np.unique(some[fresh]))
        if len(self.parts) > 1 and sum(map(len, self.parts[1:])) > max(500_000, len(self.parts[0])):
            self.parts = [np.unique(np.concatenate(self.parts))]

    def taken(self) -> np.ndarray:
        out = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, _U)
        self.parts = []
        self.tags.fill(~_U(0))
        return out


class Worths:
    """The values of the keys that a chunk asked for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = min(MEMORY_BITS, max(10, (2 * len(keys)).bit_length()))
        self.tags, self.near = np.full(1 << self.bits, ~_U(0)), np.zeros(1 << self.bits)
        slot = slots(self.keys, self.bits)
        self.tags[slot], self.near[slot] = self.keys, self.values

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = slots(keys, self.bits)
        out, lost = self.near[slot], np.flatnonzero(self.tags[slot] != keys)
        if len(lost):
            at = np.minimum(np.searchsorted(self.keys, keys[lost]), max(len(self.keys) - 1, 0))
            if not len(self.keys) or not np.array_equal(self.keys[at], keys[lost]):
                raise ValueError("a key of a text isn't among those that its chunk asked for")
            out[lost] = self.values[at]
        return out


def runs_of(values: np.ndarray) -> list[slice]:
    """Stretches of equal values."""
    ends = [*(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else []
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def in_chunks(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """_chunk, _key and _text, and about how many chunks there are: rows numbered by where their file holds them, or once stored, so that each reading gives the same chunks."""
    total = df.count()
    bits = min(CHUNK_BITS, max(6, (total // (3 * df.sparkSession.sparkContext.defaultParallelism)).bit_length()))

    def numbered(rows: DataFrame) -> DataFrame:
        # The file's name spreads the chunks of different files; two that share a number are one chunk.
        chunk = F.xxhash64("_metadata.file_path", F.shiftright("_metadata.row_index", bits))
        return rows.select(chunk.alias("_chunk"), F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))

    try:
        rows = numbered(df)
        return rows, (total >> bits) + 1
    except AnalysisException:  # not the rows of a Parquet table
        return numbered(stored(df.select(key, text), "scored-rows")), (total >> bits) + 1


def score(df: DataFrame, counts: DataFrame, mixer: Mixer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    known = counts.where("kind = 0")
    row = known.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("key") == int(END_WORD), F.col("n"))).alias("e")).first()
    n_all, distinct, n_end = row["n"] or 0, row["v"] or 0, row["e"] or 0
    scale, end = float(np.log10(n_all + distinct + 1)), float(np.log10(n_end + 1))

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words and windows of each chunk."""
        now, met = None, (Met(MEMORY_BITS - 3), Met(MEMORY_BITS))

        def emitted() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                keys = met[kind].taken()
                for at in range(0, len(keys), 200_000):
                    some = keys[at : at + 200_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now)), pa.array(np.full(len(some), kind, np.int8)), pa.array(some)], names=["chunk", "kind", "key"])

        for batch in batches:
            for run in runs_of(np.asarray(batch.column(0))):
                chunk = batch.column(0)[run.start].as_py()
                if chunk != now:
                    yield from emitted()
                    now = chunk
                for _, data, offsets in text_parts(batch.slice(run.start, run.stop - run.start), 1, 2_000_000):
                    met[0].add(words(data, offsets)[0])
                    met[1].add(windows(data, offsets)[0])
        yield from emitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, tables = None, ([], []), None
        for batch in batches:
            place = np.asarray(batch.column(0))
            for some in runs_of(place):
                part, kind = batch.slice(some.start, some.stop - some.start), int(place[some.start] & 3)
                if place[some.start] >> 2 != now:
                    now, parts, tables = place[some.start] >> 2, ([], []), None
                if kind < 2:
                    parts[kind].append((np.asarray(part.column(1)).view(_U), np.asarray(part.column(2))))
                    continue
                if tables is None:
                    tables = [Worths(*map(np.concatenate, zip(*p))) if p else Worths(np.zeros(0, _U), np.zeros(0)) for p in parts]
                    parts = ([], [])
                for rows, data, offsets in text_parts(part, 4, 1_500_000):
                    yield scored(rows, data, offsets, *tables)

    def scored(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, seen: Worths, worth: Worths) -> pa.RecordBatch:
        found, bounds = words(data, offsets)
        owner, n_docs = np.repeat(np.arange(rows.num_rows), np.diff(bounds)), rows.num_rows
        times = seen.of(found) if len(found) else np.zeros(0)
        base = np.bincount(owner, np.log10(times + 1) - scale, n_docs) + end - scale
        n_known = np.bincount(owner, times > 0, n_docs).astype(np.int64) + (n_end > 0)
        keys, ends = windows(data, offsets)
        total = np.add.reduceat(worth.of(keys), np.concatenate([[0], ends[:-1]]))
        columns = [rows.column(3), np.diff(bounds) + 1, n_known, base, total, -total / np.log10(2) / (np.diff(offsets) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names)

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
    rows, chunks = in_chunks(df, key, text)
    answers = mixer.answers(counts, rows.select("_chunk", "_text").mapInArrow(trimmed(questions), "chunk long, kind byte, key long"))
    none = F.lit(None)
    # Sorted by one number: a chunk's answers come before its texts.
    place = F.shiftleft("chunk", 2)
    both = answers.select(place.bitwiseOR(F.col("kind").cast("long")).alias("place"), "key", "value", none.cast("long").alias("_key"), none.cast("string").alias("_text")).unionByName(
        rows.select(F.shiftleft("_chunk", 2).bitwiseOR(F.lit(2).cast("long")).alias("place"), none.cast("long").alias("key"), none.cast("double").alias("value"), "_key", "_text")
    )
    # Few chunks get a partition each, for they are large; many spread evenly in any case.
    met = both.repartition(max(min(4 * chunks, 2000), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.shiftright("place", 2)).sortWithinPartitions("place")
    said = met.mapInArrow(trimmed(run), "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return said.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def may_learn(key: str = "doc_id", modulus: int = 7, held: int = 2):
    """Rows that are not held out."""
    return bucket_of(key, modulus) != held
