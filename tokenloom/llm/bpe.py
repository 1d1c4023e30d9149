"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every distinct word. A sequence of tokens is what the merges make of the
word exactly if each token is what the merges make of its own symbols, and no merge would have crossed the border of
any adjacent pair. The second condition is tested for all pairs at once on numpy arrays; words that fail a test, and
only they, are merged exactly.

Null texts count as empty and give no ids. Rows are independent: repeated rows give repeated results, other columns
than those asked for are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tokenloom.functions.batches import IdBytes
from tokenloom.functions.unicode import BYTE_OF, GLYPHS, GPT2, WS
from tokenloom.llm.common import trimmed, with_field

NEVER = np.int64(1 << 40)
SHIFT, NO_MERGE = 24, 1 << 62
WHOLE = (1 << SHIFT) - 1
KEPT, KEPT_CHARS = 500_000, 48


TO_GLYPH = dict(enumerate(GLYPHS))


class Merges:
    """The merge table of one vocabulary, with the arrays that the pair test needs."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(self.vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.coded: dict[tuple[int, int], int] = {}  # rank and id of what a pair becomes
        made: dict[int, int] = {}
        for n, (a, b) in enumerate(pairs):
            if a in self.vocab and b in self.vocab and a + b in self.vocab:
                l, r, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
                self.coded[l, r] = (n << SHIFT) | whole
                if whole not in made:
                    self.rank[whole], self.left[whole], self.right[whole] = n, l, r
                made[whole] = made.get(whole, 0) + 1
        keys = np.fromiter(((l << 32) | r for l, r in self.coded), np.int64, len(self.coded))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ranks = np.fromiter((c >> SHIFT for c in self.coded.values()), np.int64, len(keys))[order]
        symbols = {*GLYPHS, *(g + self.suffix for g in GLYPHS)}
        self.proposable = {t: i for t, i in self.vocab.items() if i in made or t in symbols}
        self.doubtful = {i for i, n in made.items() if n > 1}
        self.within: np.ndarray | None = None

    def rank_of(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(l), NEVER)
        want = (l << 32) | r
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_ranks[at], NEVER)

    def compatible(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether no merge crosses the border between them.

        Undoing merges latest first yields the symbols that stood at the border at each time: a merge across it
        would have won if it comes before the next merge on either side. Of equal ranks the leftmost is done first.
        """
        l, r = l.astype(np.int64), r.astype(np.int64)
        good = np.ones(len(l), bool)
        live = np.arange(len(l))
        until = np.full(len(l), NEVER)  # a merge across of a smaller doubled rank would have won
        while len(live):
            across = self.rank_of(l, r)
            lost = (across < NEVER) & (2 * across < until)
            good[live[lost]] = False
            a, b = self.rank[l], self.rank[r]
            on = ~lost & ((a >= 0) | (b >= 0))
            live, l, r, a, b = live[on], l[on], r[on], a[on], b[on]
            first = a > b
            until = np.where(first, 2 * a, 2 * b + 1)
            l, r = np.where(first, self.right[l], l), np.where(first, r, self.left[r])
        return good

    def symbols(self, word: str, last: bool = True) -> list[int]:
        """Ids of the single symbols; those that the vocabulary lacks are dropped."""
        names = [*word[:-1], word[-1] + self.suffix] if last and word else list(word)
        return [self.vocab[s] for s in names if s in self.vocab]

    def merge(self, word: str, last: bool = True) -> list[int]:
        """The merges in order of rank, leftmost first. last: the word ends here."""
        ids = self.symbols(word, last)
        if len(ids) > 64:
            return self.merge_long(ids)
        get = self.coded.get
        codes = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while codes and (best := min(codes)) != NO_MERGE:
            k = codes.index(best)
            ids[k : k + 2] = (best & WHOLE,)
            del codes[k]
            if k:
                codes[k - 1] = get((ids[k - 1], ids[k]), NO_MERGE)
            if k < len(codes):
                codes[k] = get((ids[k], ids[k + 1]), NO_MERGE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, k, ids[k], ids[k + 1]) for k in range(n - 1) if (c := self.coded.get((ids[k], ids[k + 1])))  is not None]
        heap = [((c >> SHIFT), k, c & WHOLE, l, r) for c, k, l, r in heap]
        heapq.heapify(heap)
        while heap:
            _, k, whole, l, r = heapq.heappop(heap)
            if ids[k] != l or (j := after[k]) >= n or ids[j] != r:
                continue
            ids[k], ids[j] = whole, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and (y := after[x]) < n and (c := self.coded.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (c >> SHIFT, x, c & WHOLE, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def build_trie(self) -> None:
        """Transitions as a sorted array of (node, byte), and for each node its token within and at the end of a word."""
        edges: dict[int, int] = {}
        within, at_end = [-1], [-1]
        for t, i in self.proposable.items():
            last = bool(self.suffix) and t.endswith(self.suffix)
            node = 0
            for c in t[: -len(self.suffix)] if last else t:
                key = (node << 8) | BYTE_OF[c]
                if (child := edges.get(key)) is None:
                    child = edges[key] = len(within)
                    within.append(-1)
                    at_end.append(-1)
                node = child
            if last or not self.suffix:
                at_end[node] = i
            if not last:
                within[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edges, self.children = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.within, self.at_end = np.array(within), np.array(at_end)
        self.own = np.full(len(self.rank), -1, np.int8)
        names = {i: t for t, i in self.proposable.items()}
        self.name_of = names
        self.single = np.array([self.vocab.get(g, -1) for g in GLYPHS]), np.array([self.vocab.get(g + self.suffix, -1) for g in GLYPHS])
        self.made_by_rank = np.zeros(max((c >> SHIFT for c in self.coded.values()), default=0) + 1, np.int64)
        for c in self.coded.values():
            self.made_by_rank[c >> SHIFT] = c & WHOLE

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once, a byte of each at a time: words, tokens, and which words failed."""
        failed = np.zeros(len(starts), bool)
        words, places, tokens = [], [], []
        live = np.flatnonzero(ends > starts)
        first, at = starts[live].copy(), starts[live].copy()
        node, token, stop = (np.zeros(len(live), np.int64), np.full(len(live), -1), first.copy())
        end = ends[live]
        while len(live):
            key = (node << 8) | data[np.minimum(at, end - 1)]
            k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = (at < end) & (self.edges[k] == key)
            node = np.where(on, self.children[k], 0)
            at = at + on
            found = np.where(on, np.where(at == end, self.at_end[node], self.within[node]), -1)
            token, stop = np.where(found >= 0, found, token), np.where(found >= 0, at, stop)
            off = ~on
            if off.any():
                words.append(live[off])
                places.append(first[off])
                tokens.append(token[off])
                failed[live[off & (token < 0)]] = True
                keep = on | ((token >= 0) & (stop < end))
                at, first, token = np.where(off, stop, at), np.where(off, stop, first), np.where(off, -1, token)
                live, first, at, node, token, stop, end = (x[keep] for x in (live, first, at, node, token, stop, end))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), failed
        order = np.argsort(np.concatenate(places), kind="stable")
        return np.concatenate(words)[order], np.concatenate(tokens)[order], failed

    def owned(self, tokens: np.ndarray) -> np.ndarray:
        """Whether the merges make each token of its own symbols, through the split that the arrays record."""
        for i in np.unique(tokens[self.own[tokens] < 0]).tolist():
            text = self.name_of[i]
            last = bool(self.suffix) and text.endswith(self.suffix)
            self.own[i] = i not in self.doubtful and self.merge(text.removesuffix(self.suffix) if last else text, last) == [i]
        return self.own[tokens] > 0

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of many words at once, each making one merge at a time; all symbols must be known. Ids, and how many each has."""
        sizes = ends - starts
        place = np.arange(int(sizes.max()))
        ids = self.single[0][data[np.minimum(starts[:, None] + place, len(data) - 1)]]
        ids[place >= sizes[:, None]] = -1
        ids[np.arange(len(sizes)), sizes - 1] = self.single[1 if self.suffix else 0][data[ends - 1]]
        out, counts = np.empty(ids.shape, np.int32), np.empty(len(sizes), np.int64)
        rows = np.arange(len(sizes))
        ranks = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(sizes), -1) if ids.shape[1] > 1 else np.full((len(sizes), 1), NEVER)
        ranks[:, : ids.shape[1] - 1][ids[:, 1:] < 0] = NEVER
        while len(rows):
            k = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, k]
            done = best >= NEVER
            out[rows[done], : ids.shape[1]], counts[rows[done]] = ids[done], sizes[done]
            if done.all():
                break
            on = ~done
            rows, sizes, k, best, ids, ranks = rows[on], sizes[on] - 1, k[on], best[on], ids[on], ranks[on]
            each, width = each[: len(rows)], ids.shape[1]
            moved = np.minimum(place[:width] + (place[:width] > k[:, None]), width - 1)
            ids = np.take_along_axis(ids, moved, axis=1)
            ids[each, k] = self.made_by_rank[best]
            ids[place[:width] >= sizes[:, None]] = -1
            ranks = np.take_along_axis(ranks, np.minimum(moved[:, : width - 1], width - 2), axis=1)
            ranks[:, -1] = np.where(k < width - 2, NEVER, ranks[:, -1])
            for x in (k - 1, k):
                ok = (x >= 0) & (x + 1 < sizes)
                new = np.full(len(rows), NEVER)
                new[ok] = self.rank_of(ids[each[ok], x[ok]], ids[each[ok], x[ok] + 1])
                ranks[each[x >= 0], np.minimum(x, width - 2)[x >= 0]] = new[x >= 0]
            # Fewer columns once the words are short.
            if width > 2 and (short := max(2, int(sizes.max()))) < width:
                ids, ranks = ids[:, :short], ranks[:, : short - 1]
        return out[place < counts[:, None]], counts

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words in turn, how many each has, and how many words failed the test and were merged exactly."""
        if self.within is None:
            self.build_trie()
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate([[0], ends[:-1]]) if len(words) else ends
        owner, tokens, failed = self.propose(data, starts, ends)
        known = np.flatnonzero(tokens >= 0)
        failed[owner[known[~self.owned(tokens[known])]]] = True
        if len(tokens) > 1:
            inside = np.flatnonzero((owner[1:] == owner[:-1]) & ~failed[owner[1:]])
            pairs, back = np.unique((tokens[inside] << 32) | tokens[inside + 1], return_inverse=True)
            good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            failed[owner[inside[~good[back]]]] = True
        left = np.flatnonzero(failed)
        if not len(left):
            return tokens.astype(np.int32), np.bincount(owner, minlength=len(words)), 0
        # By length, so that words merged together are alike; long words and unknown symbols go one by one.
        unknown = (self.single[0][data] < 0) | (self.single[1][data] < 0)
        odd = np.concatenate([[0], np.cumsum(unknown)])
        plain = (odd[ends[left]] == odd[starts[left]]) & (ends[left] - starts[left] <= 64)
        passed = ~failed[owner]
        owners, parts = [owner[passed]], [tokens[passed].astype(np.int32)]
        for k in left[~plain].tolist():
            parts.append(np.array(self.merge(words[k].decode("latin-1").translate(TO_GLYPH)), np.int32))
            owners.append(np.full(len(parts[-1]), k))
        some = left[plain]
        some = some[np.argsort(ends[some] - starts[some], kind="stable")]
        for at in range(0, len(some), 2048):
            part = some[at : at + 2048]
            found, counts = self.merge_many(data, starts[part], ends[part])
            owners.append(np.repeat(part, counts))
            parts.append(found)
        owner = np.concatenate(owners)
        return np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words)), len(left)

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words failed the test and were merged exactly."""
        ids, counts, failed = self.encode_flat(words)
        flat, ends = ids.tolist(), np.cumsum(counts).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)], failed


class Bpe:
    """A tokenizer.json of the byte-level BPE kind: added tokens, normalizer, pre-tokenizer and merges."""

    def __init__(self, config: str, kept: int = KEPT):
        spec = json.loads(config)
        self.kept = kept
        self.merges = Merges(spec["model"])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pre = spec["pre_tokenizer"]
        self.words_only = pre["type"] == "Sequence"
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"] if self.words_only else GPT2
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WS}").replace(r"(?!\S)", f"(?![^{WS}])").replace(r"\s+", f"[{WS}]+"))
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.nfc, self.lower = any(s["type"] == "NFC" for s in steps), any(s["type"] == "Lowercase" for s in steps)
        self.spaces = regex.compile(f"[{WS}]+")
        self.controls = re.compile(r"[\x1c-\x1f]")
        self.odd = re.compile(r"\s | \s")
        # In texts that hold none of these, single spaces or plain white space part the words.
        space = f"[{WS}\x1c-\x1f]"
        doubtful = ["[\x1c-\x1f]"] if self.words_only else ["^ ", " $", f"{space} ", f" {space}"]
        if not self.words_only and (self.nfc or self.lower):
            doubtful = [""]
        self.unusual = "|".join([*map(re.escape, self.added), *doubtful])
        self.forget()

    def forget(self) -> None:
        """What is remembered: the numbers of pieces, of words at a text's start and of words behind a space, and the ids by number."""
        self.pieces: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")

    def normalized(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        return text

    def remember(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Keeps ids of so many sizes in turn; their numbers."""
        first = len(self.starts)
        self.starts.frombytes((np.cumsum(sizes) - sizes + len(self.flat)).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        return range(first, len(self.starts))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids behind the numbers in turn, and how many each has."""
        sizes, starts = np.frombuffer(self.sizes, np.int64)[numbers], np.frombuffer(self.starts, np.int64)[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return np.frombuffer(self.flat, np.int32)[np.repeat(starts - ends + sizes, sizes) + np.arange(total)], sizes

    def learn(self, words: list[str], cache: dict[str, int], lead: str) -> None:
        """Encodes words that the cache lacks: each distinct piece of them once. Of a word that is one piece the number is the piece's."""
        shaped = words
        if self.words_only and (self.nfc or self.lower):
            shaped = [w.lower() if self.lower and w.isascii() else self.normalized(w) for w in words]
        split, pieces = self.pattern.findall, self.pieces
        # A word of letters alone is one piece in either pattern.
        whole = [w.isalpha() for w in shaped]
        plain = [lead + w for w, one in zip(shaped, whole) if one]
        parts = [split(lead + w) for w, one in zip(shaped, whole) if not one]
        new = list(set(chain(plain, chain.from_iterable(parts))).difference(pieces))
        ids, sizes, _ = self.merges.encode_flat([p.encode("utf-8") for p in new])
        pieces.update(zip(new, self.remember(ids, sizes)))
        cache.update(zip((w for w, one in zip(words, whole) if one), map(pieces.__getitem__, plain)))
        if parts:
            ids, sizes = self.ids_of(np.fromiter(map(pieces.__getitem__, chain.from_iterable(parts)), np.int64))
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, parts)])]
            cache.update(zip((w for w, one in zip(words, whole) if not one), self.remember(ids, np.diff(ends))))

    def spare(self) -> None:
        """Bounds what is remembered. The words met first tend to be the common ones; they stay."""
        if len(self.flat) > 8 * self.kept:
            self.forget()
        elif len(self.starts) > self.kept:
            n = self.kept * 3 // 4
            self.pieces, self.first, self.later = ({w: k for w, k in d.items() if k < n and len(w) <= KEPT_CHARS} for d in (self.pieces, self.first, self.later))
            del self.flat[self.starts[n] :], self.starts[n:], self.sizes[n:]

    def numbered(self, words: list[str], head: bool, lead: str) -> np.ndarray:
        """The numbers of distinct words; those not met before are learned."""
        cache = self.first if head else self.later
        numbers = np.fromiter(map(cache.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(numbers < 0)
        if len(lost):
            missing = [words[k] for k in lost.tolist()]
            self.learn(missing, cache, lead)
            numbers[lost] = np.fromiter(map(cache.__getitem__, missing), np.int64, len(missing))
        return numbers

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array, and where each text's end; null counts as empty.

        Where only white space parts the words and none of it is a token, Arrow splits the texts and numbers their
        distinct words, so that each is looked up once. Other texts take the way of encode_batch.
        """
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        column = pc.fill_null(column, "")
        odd = np.asarray(pc.match_substring_regex(column, self.unusual))
        counts, numbers = np.zeros(len(column), np.int64), []
        lead = "" if self.words_only else " "
        rows = np.flatnonzero(~odd)
        if len(rows):
            some = column if len(rows) == len(column) else column.take(pa.array(rows))
            lists = pc.utf8_split_whitespace(some) if self.words_only else pc.split_pattern(some, " ")
            sizes, coded = np.asarray(pc.list_value_length(lists)).astype(np.int64), lists.flatten().dictionary_encode()
            codes, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
            if self.words_only:
                found = self.numbered(words, False, lead)[codes]
            else:
                head = np.zeros(len(codes), bool)
                head[np.cumsum(sizes) - sizes] = True
                found = np.empty(len(codes), np.int64)
                for place in (True, False):
                    used = np.unique(codes[head == place])
                    known = np.full(len(words), -1, np.int64)
                    known[used] = self.numbered([words[k] for k in used.tolist()], place, "" if place else lead)
                    found[head == place] = known[codes[head == place]]
            counts[rows] = sizes
            numbers.append(found)
        if len(rows) < len(column):
            found, counts[odd] = self.numbers_of(column.filter(pa.array(odd)).to_pylist())
            numbers.append(found)
        every = np.concatenate(numbers)
        if len(numbers) > 1:
            every = every[np.argsort(np.concatenate([np.repeat(rows, counts[rows]), np.repeat(np.flatnonzero(odd), counts[odd])]), kind="stable")]
        return self.coded(every, counts)

    def numbers_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts in turn, and how many each text has."""
        runs: list[tuple[list[str], bool | None]] = []  # words, and whether they start a text
        numbers, counts = [], []
        lead = "" if self.words_only else " "
        for text in texts:
            before = len(runs)
            for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
                if k % 2:
                    runs.append(([part], None))
                    continue
                if not self.words_only and (self.nfc or self.lower):
                    part = self.normalized(part)
                if not part:
                    continue
                if self.words_only:
                    # White space is dropped; str.split() takes four control characters for it too.
                    runs.append(([w for w in self.spaces.split(part) if w] if self.controls.search(part) else part.split(), False))
                elif part[0] == " " or part[-1] == " " or self.odd.search(part):
                    runs.append(([part], True))
                else:
                    words = part.split(" ")
                    runs += [(words[:1], True), (words[1:], False)]
            counts.append(sum(len(w) for w, _ in runs[before:]))
        for head in (True, False):
            words = list(dict.fromkeys(chain.from_iterable(w for w, h in runs if h is head)))
            self.numbered(words, head, "" if head else lead)
        for words, head in runs:
            if head is None:
                special = (words[0],)
                if special not in self.first:
                    self.first[special] = self.remember(np.array([self.added[words[0]]]), np.ones(1, np.int64))[0]
                numbers.append(self.first[special])
            else:
                numbers.extend(map((self.first if head else self.later).__getitem__, words))
        return np.array(numbers, np.int64), np.array(counts, np.int64)

    def coded(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.ids_of(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        self.spare()
        return ids, ends

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's end."""
        return self.coded(*self.numbers_of(texts))


def bytes_of_ids(config: str) -> IdBytes:
    """The bytes of all ids, laid out for whole batches; nothing else of the tokenizer is kept, for encoders live in other workers."""
    key = hash(config)
    if key not in _LAID_OUT:
        spec = json.loads(config)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        parts = [b""] * (max([*names, *(t["id"] for t in spec.get("added_tokens") or [])]) + 2)
        for i, t in names.items():
            parts[i] = bytes(map(BYTE_OF.__getitem__, t)) if all(c in BYTE_OF for c in t) else t.encode()
        for t in spec.get("added_tokens") or []:
            parts[t["id"]] = t["content"].encode()
        _LAID_OUT.clear()
        _LAID_OUT[key] = IdBytes(parts)
    return _LAID_OUT[key]


_LAID_OUT: dict[int, IdBytes] = {}
_LOADED: dict[int, Bpe] = {}


def load(config: str, kept: int = KEPT) -> Bpe:
    """One tokenizer for each configuration in a Python worker. kept: words that it remembers at most."""
    key = hash(config)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(config, kept)
    _LOADED[key].kept = kept
    return _LOADED[key]


def unload() -> None:
    """Forgets the loaded tokenizer, where memory matters more than loading it again."""
    _LOADED.clear()


def slices(sizes: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Runs of rows of about `most` in size together, one row at least."""
    start, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def encode(df: DataFrame, config: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns of keep, and the ids of the text's tokens, no special ones added. config: the text of a tokenizer.json."""
    held = df.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(held.value)
        for batch in batches:
            column = batch.column(len(keep))
            for part in slices(np.asarray(pc.fill_null(pc.binary_length(column), 0))):
                rows = batch.slice(part.start, part.stop - part.start)
                found, ends = bpe.encode_column(rows.column(len(keep)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], lists], names=[*keep, ids])

    source = df.select(*keep, df[text].alias("_text"))
    return source.mapInArrow(trimmed(run), with_field(source.select(*keep).schema, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, config: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for, special tokens kept; a column named like `out` is replaced. A null list gives an empty text."""
    held = df.sparkSession.sparkContext.broadcast(config)
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_of_ids(held.value)
        for batch in batches:
            column = batch.column(kept.index(ids))
            for part in slices(np.asarray(pc.fill_null(pc.list_value_length(column), 0)), 500_000):
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, table.texts(rows.column(kept.index(ids)))], names=[*kept, out])

    source = df.select(*kept)
    return source.mapInArrow(trimmed(run), with_field(source.schema, out, T.StringType()))
