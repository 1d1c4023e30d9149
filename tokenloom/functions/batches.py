"""Whole Arrow columns through a tokenizer: distinct words are looked up once, only new ones go through the kernels.

`WordBatches` serves tokenizers whose pre-tokenizer is the byte-level pattern and whose model is BPE, without normalizer,
truncation or padding. Single spaces part most texts; the pattern then parts each word together with its space in the
same way as the whole text, so ids and counts of a word hold wherever it stands. Other texts go through the kernels whole.
`ChunkBatches` does the same for more tokenizers and for all lists of an encoding, `PieceBatches` for pre-tokenizers alone.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenloom.functions.decoders import BYTE
from tokenloom.functions.encoding import trim
from tokenloom.functions.models import MODELS
from tokenloom.functions.text import Text, piece_strings
from tokenloom.functions.tokenizer import place, Tokenizer
from tokenloom.functions.unicode import BYTE_OF, GLYPHS, GPT2, SPACES, WS, pattern

#: Words remembered in a Python worker (memory grows to what they take); symbols up to which a word is merged over a list; the bits of an id beside a rank.
KEPT, SHORT, MADE = 200_000, 64, (1 << 24) - 1


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordBatches:
    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.prefix = (tokenizer.spec.pre_tokenizer or {}).get("add_prefix_space", True)
        space = f"[{WS}\x1c-\x1f]"
        words = [re.escape(t) for t in tokenizer.added.by_content]
        # In texts that hold none of these, single spaces part the words.
        self.unusual = "|".join([*words, "^ ", " $", f"{space} ", f" {space}", "^$"])
        self.model, self.pattern, self.glyphs = tokenizer.model, pattern(GPT2), dict(enumerate(GLYPHS))
        self.rules = {pair: (rank << 24) | made for pair, (rank, made) in tokenizer.model.rules.items()}
        self.forget()

    @staticmethod
    def serves(tokenizer: Tokenizer) -> bool:
        s = tokenizer.spec
        level = s.pre_tokenizer or {}
        plain = not (s.normalizer or s.truncation or s.padding) and level.get("type") == "ByteLevel" and level.get("use_regex", True)
        return bool(plain and s.model.get("type", "BPE") == "BPE" and not s.model.get("dropout"))

    def forget(self) -> None:
        self.pieces: dict[str, array] = {}
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.flat, self.starts, self.sizes = array("i"), array("q"), array("q")
        self.chars = 0

    def learn(self, words: list[str]) -> range:
        """Keeps the ids of words with their spaces; their numbers."""
        first, find, known = len(self.starts), self.pattern.findall, self.pieces
        for word in words:
            # A word of ASCII letters is one piece and its glyphs are known.
            pieces = (word,) if word.isalpha() or word[:1] == " " and word[1:].isalpha() else find(word)
            self.starts.append(len(self.flat))
            for p in pieces:
                if (ids := known.get(p)) is None:
                    ids = known[p] = self.merged(p)
                self.flat.extend(ids)
            self.sizes.append(len(self.flat) - self.starts[-1])
            self.chars += len(word)
        return range(first, len(self.starts))

    def merged(self, piece: str) -> array:
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.glyphs)
        ids = None if self.model.whole and word in self.model.vocab else list(map(self.model.vocab.get, word))
        if ids is None or None in ids or len(ids) > SHORT or self.model.prefix or self.model.suffix:
            return array("i", [t[0] for t in self.model.tokens(word)])
        get, none = self.rules.get, 1 << 62
        codes = [get(pair, none) for pair in zip(ids, ids[1:])]
        while codes and (best := min(codes)) != none:
            k = codes.index(best)
            ids[k : k + 2] = (best & MADE,)
            del codes[k]
            if k:
                codes[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(codes):
                codes[k] = get((ids[k], ids[k + 1]), none)
        return array("i", ids)

    def numbered(self, words: list[str], known: dict[str, int], lead: str) -> np.ndarray:
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(found < 0)
        if len(lost):
            fresh = [words[k] for k in lost.tolist()]
            numbers = self.learn([lead + w for w in fresh])
            known.update(zip(fresh, numbers))
            found[lost] = numbers
        return found

    def coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all words of the usual texts in turn, how many each text has, and the rows of the other texts."""
        if len(self.starts) > KEPT or self.chars > ENTRIES:
            self.forget()
        column = pc.fill_null(column, "")
        odd = np.asarray(pc.match_substring_regex(column, self.unusual))
        lists = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        sizes, coded = np.asarray(pc.list_value_length(lists)).astype(np.int64), lists.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
        head = np.zeros(len(codes), bool)
        head[np.cumsum(sizes) - sizes] = True
        numbers = np.empty(len(codes), np.int64)
        for place, known, lead in ((True, self.first, " " if self.prefix else ""), (False, self.later, " ")):
            used = np.unique(codes[head == place])
            of = np.empty(len(words), np.int64)
            # A text that begins with another white space than a space gets its prefix too.
            of[used] = self.numbered([words[k] for k in used.tolist()], known, lead)
            numbers[head == place] = of[codes[head == place]]
        counts = np.zeros(len(column), np.int64)
        counts[~odd] = sizes
        return numbers, counts, np.flatnonzero(odd)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, without special ones, and how many each has."""
        numbers, words, odd = self.coded(column)
        sizes, starts = np.frombuffer(self.sizes, np.int64)[numbers], np.frombuffer(self.starts, np.int64)[numbers]
        ids = gathered(np.frombuffer(self.flat, np.int32), starts, sizes)
        totals = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words)])]
        counts = np.diff(totals)
        if len(odd):
            own = [self.tokenizer.sequence(t or "", 0, "none").ids for t in column.take(pa.array(odd)).to_pylist()]
            parts = np.split(ids, totals[odd])
            ids = np.concatenate([x for p, o in zip(parts, [*own, []]) for x in (p, np.array(o, np.int32))])
            counts[odd] = list(map(len, own))
        return ids, counts

    def count(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has; no id is laid out."""
        numbers, words, odd = self.coded(column)
        sizes = np.concatenate([[0], np.cumsum(np.frombuffer(self.sizes, np.int64)[numbers])])
        counts = np.diff(sizes[np.concatenate([[0], np.cumsum(words)])])
        if len(odd):
            counts[odd] = [self.tokenizer.count(t or "") for t in column.take(pa.array(odd)).to_pylist()]
        return counts


#: Pre-tokenizers that part words at white space whatever stands around it, those that may follow them, for they see
#: nothing but the word, and normalizers that change each character by itself and leave spaces where they are.
AT_SPACES = frozenset(("Whitespace", "WhitespaceSplit", "BertPreTokenizer"))
IN_WORDS = AT_SPACES | {"Digits", "Punctuation", "CharDelimiterSplit", "Delimiter", "FixedLength", "Split"}
BY_CHARACTER = frozenset(("BertNormalizer", "Bert", "Lowercase", "StripAccents"))
#: Spaces at which the byte-level pattern parts any text.
LONE = re.compile(r"(?<=\S) (?=\S)")
#: Chunks, and entries of their lists, remembered in a Python worker; as many characters, for texts without spaces are one chunk.
CHUNKS, ENTRIES = 200_000, 4_000_000


def part_at(pre: dict | None) -> str | None:
    """Where texts can be parted before this pre-tokenizer: at every space (space; mark: which stays with what follows), at lone ones (level), or None."""
    kind = (pre or {}).get("type")
    if kind == "Sequence":
        kinds = [x.get("type") for x in pre["pretokenizers"]]
        return "space" if kinds and kinds[0] in AT_SPACES and IN_WORDS.issuperset(kinds) else None
    if kind in AT_SPACES:
        return "space"
    if kind == "Metaspace" and pre.get("split", True):
        return "mark"
    return "level" if kind == "ByteLevel" and pre.get("use_regex", True) else None


class Chunks:
    """Texts cut into chunks that can be worked on one by one; each distinct chunk gets a number and its entries are kept flat."""

    def __init__(self, where: str):
        self.where, self.lead, self.gap = where, "" if where in ("space", "chars") else " ", int(where == "space")
        self.cut = {"chars": list, "level": LONE.split}.get(where, lambda t: t.split(" "))
        self.forget()

    def forget(self) -> None:
        # Number 0 is nothing; it stands in for what begins a text while the others are looked up.
        self.first: dict[str, int] = {}
        self.later: dict[str | None, int] = {None: 0}
        self.starts, self.sizes = array("q", [0]), array("q", [0])
        self.entries, self.chars = 1, 0
        self.values: dict[str, int] = {}
        self.value = array("i", [0])

    def learn(self, chunk: str, first: bool) -> int:
        """Keeps the entries of a chunk; how many they are."""
        raise NotImplementedError

    def valued(self, values: list[str]) -> None:
        self.value.extend([self.values.setdefault(v, len(self.values)) for v in values])

    def numbered(self, chunks: list, known: dict, lead: str, first: bool) -> np.ndarray:
        found = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        lost = np.flatnonzero(found < 0).tolist()
        for chunk in dict.fromkeys([chunks[k] for k in lost]):
            size = self.learn(lead + chunk, first)
            known[chunk] = len(self.starts)
            self.starts.append(self.entries)
            self.sizes.append(size)
            self.entries += size
            self.chars += len(chunk)
        found[lost] = [known[chunks[k]] for k in lost]
        return found

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all chunks in turn, and how many each text has."""
        if len(self.starts) > CHUNKS or max(self.entries, self.chars) > ENTRIES:
            self.forget()
        chunks, counts = [], []
        for t in texts:
            parts = self.cut(t)
            chunks += parts
            counts.append(len(parts))
        counts = np.array(counts, np.int64)
        if not self.lead:
            return self.numbered(chunks, self.later, "", False), counts
        heads = (np.cumsum(counts) - counts)[counts > 0].tolist()
        begun = [chunks[k] for k in heads]
        for k in heads:
            chunks[k] = None
        numbers = self.numbered(chunks, self.later, self.lead, False)
        numbers[heads] = self.numbered(begun, self.first, "", True)
        return numbers, counts

    def laid(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all entries in turn, how many each chunk has, and where each text's begin, with the end of all."""
        sizes, starts = np.frombuffer(self.sizes, np.int64)[numbers], np.frombuffer(self.starts, np.int64)[numbers]
        ends = np.cumsum(sizes)
        places = np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return places, sizes, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def strings(self, places: np.ndarray) -> pa.Array:
        return pa.array(list(self.values), pa.string()).take(pa.array(np.frombuffer(self.value, np.int32)[places]))


class PieceBatches(Chunks):
    """The pieces that a pre-tokenizer makes of texts, for those that `part_at` knows."""

    def __init__(self, config: dict):
        self.pre = piece_strings(config)
        # These leave a word of ASCII letters and digits as it is.
        self.plain = config["type"] in AT_SPACES
        super().__init__(part_at(config))

    def learn(self, chunk: str, first: bool) -> int:
        pieces = [chunk] if self.plain and chunk.isascii() and chunk.isalnum() else self.pre(chunk)
        self.valued(pieces)
        return len(pieces)

    def pieces(self, texts: list[str]) -> pa.Array:
        places, _, ends = self.laid(*self.coded(texts))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.strings(places))


class ChunkBatches(Chunks):
    """The encodings of texts, without special tokens."""

    def __init__(self, tokenizer: Tokenizer, unit: str, want: tuple[str, ...]):
        """want: the lists that may be asked for; none if tokens are only counted."""
        self.tokenizer, self.unit, self.want = tokenizer, unit, frozenset(want) - ({"words", "offsets", "tokens"} if unit == "none" else set())
        self.tracked = "offsets" in self.want
        post = tokenizer.spec.post_processor or {}
        self.trims, self.prefix = post.get("trim_offsets", True) and post.get("type") == "ByteLevel" and self.tracked, post.get("add_prefix_space", True)
        # ASCII letters and digits without an added token are one piece for these, and each of them is one character of it.
        pre, normal = tokenizer.spec.pre_tokenizer or {}, tokenizer.spec.normalizer
        self.mark = pre.get("replacement", "▁") if pre.get("type") == "Metaspace" else ""
        self.plain = not self.trims and (pre.get("type") in AT_SPACES or len(self.mark) == 1 and not self.mark.isalnum())
        self.lowers = bool(normal) and (normal["type"] == "Lowercase" or normal["type"] in ("BertNormalizer", "Bert") and normal.get("lowercase", True))
        super().__init__(self.parts_at(tokenizer))

    @staticmethod
    def parts_at(tokenizer: Tokenizer) -> str | None:
        """Where texts can be parted before this tokenizer; chars: anywhere. None: its texts must stay whole."""
        s, m = tokenizer.spec, tokenizer.model
        if s.truncation or s.padding or type(m) not in MODELS.values() or s.model.get("dropout"):
            return None
        if s.pre_tokenizer is None:
            free = type(m) is MODELS["BPE"] and not (m.rules or m.prefix or m.suffix or m.whole or m.unk is not None and m.fuse)
            return "chars" if free and not s.normalizer and not s.added_tokens else None
        where = part_at(s.pre_tokenizer)
        kind = (s.normalizer or {}).get("type", "Lowercase")
        names = [*tokenizer.added.by_content, *tokenizer.added.names.values()]
        if kind not in BY_CHARACTER or where != "space" and kind != "Lowercase" or any(t.lstrip or t.rstrip for t in s.added_tokens) or any(c.isspace() or c in SPACES for t in names for c in t):
            return None
        return where

    @staticmethod
    def serves(tokenizer: Tokenizer, counting: bool = False) -> bool:
        """counting: only how many ids there are, before post-processing."""
        where, post = ChunkBatches.parts_at(tokenizer), tokenizer.spec.post_processor
        if where is None or counting or post is None:
            return where is not None
        # What begins a text may be trimmed in another way; only where "level" parts it, that is in the first chunk.
        return post.get("type") == "ByteLevel" and (where == "level" or not post.get("trim_offsets", True) or not post.get("add_prefix_space", True))

    def forget(self) -> None:
        super().forget()
        self.ids, self.words, self.begins, self.ends = (array("i", [0]) for _ in range(4))
        # By chunk: its length in the unit, and its words.
        self.lengths, self.counts = array("q", [0]), array("q", [0])

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = super().coded(texts)
        if hasattr(self.tokenizer.model, "forget"):  # its words would stand beside the chunks that they are in
            self.tokenizer.model.forget()
        return out

    def pieces(self, chunk: str, first: bool) -> list[Text]:
        word = chunk[len(self.lead) :]
        if self.plain and word.isascii() and word.isalnum() and not (first and self.lead):
            made, added = word.lower() if self.lowers else word, self.tokenizer.added
            if not (added.raw and added.raw[0].search(word) or added.normal and added.normal[0].search(made)):
                return [Text(self.mark + made, [(k, k + 1) for k in range(len(chunk))] if self.tracked else None)]
        return self.tokenizer.pieces(chunk, self.tracked)

    def learn(self, chunk: str, first: bool) -> int:
        pieces = self.pieces(chunk, first)
        found = [[(p.fixed, p.chars, 0, len(p.chars))] if p.fixed is not None else self.tokenizer.model.tokens(p.chars) for p in pieces]
        if self.trims:
            e = self.tokenizer.sequence(chunk, 0, self.unit)
            trim(e, self.prefix and first)
            self.begins.extend([a for a, _ in e.offsets])
            self.ends.extend([b for _, b in e.offsets])
        elif self.tracked:
            at = place(chunk, self.unit)
            self.begins.extend([at(p.spans[t[2]][0]) if t[3] > t[2] else 0 for p, f in zip(pieces, found) for t in f])
            self.ends.extend([at(p.spans[t[3] - 1][1]) if t[3] > t[2] else 0 for p, f in zip(pieces, found) for t in f])
        if self.tracked:
            wide = sum(c > "\uffff" for c in chunk) if self.unit == "utf16" and not chunk.isascii() else 0
            self.lengths.append(len(chunk.encode("utf-8", "surrogatepass")) if self.unit == "byte" else len(chunk) + wide)
        if "ids" in self.want:
            self.ids.extend([t[0] for f in found for t in f])
        if "tokens" in self.want:
            self.valued([t[1] for f in found for t in f])
        if "words" in self.want:
            self.words.extend([0 if self.where == "chars" else k for k, f in enumerate(found) for _ in f])
            self.counts.append(0 if self.where == "chars" else len(pieces))
        return sum(map(len, found))

    def before(self, of: array, gap: int, numbers: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each entry, what the chunks before its own in its text add up to."""
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(of, np.int64)[numbers] + gap)])
        return np.repeat(sums[:-1] - np.repeat(sums[np.cumsum(counts) - counts], counts), sizes)

    def count(self, texts: list[str]) -> np.ndarray:
        numbers, counts = self.coded(texts)
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(self.sizes, np.int64)[numbers])])
        return np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: list[str], want: tuple[str, ...]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Where each text's tokens begin, with the end of all, and the wanted lists laid out flat."""
        numbers, counts = self.coded(texts)
        places, sizes, ends = self.laid(numbers, counts)
        n, out = len(places), {}
        for w in want:
            if w == "ids":
                out[w] = pa.array(np.frombuffer(self.ids, np.int32)[places])
            elif w == "tokens":
                out[w] = self.strings(places) if w in self.want else pa.repeat("", n)
            elif w == "words":
                out[w] = pa.array((np.frombuffer(self.words, np.int32)[places] + self.before(self.counts, 0, numbers, counts, sizes)).astype(np.int32)) if w in self.want else pa.nulls(n, pa.int32())
            elif w == "offsets":
                shift = self.before(self.lengths, self.gap, numbers, counts, sizes) if self.tracked else 0
                both = [(np.frombuffer(x, np.int32)[places] + shift).astype(np.int32) if self.tracked else np.zeros(n, np.int32) for x in (self.begins, self.ends)]
                out[w] = pa.StructArray.from_arrays(list(map(pa.array, both)), ["start", "end"])
            else:
                out[w] = pa.array(np.full(n, int(w == "attention"), np.int32))
        return ends, out


class ByteSpans:
    """Offsets of byte-level tokens from their ids: the tokens cover the bytes of a text in turn."""

    def __init__(self, tokenizer: Tokenizer, unit: str):
        parts = [b""] * (max(tokenizer.model_names) + 1)
        for i, t in tokenizer.model_names.items():
            parts[i] = bytes(BYTE_OF.get(c, 0) for c in t)
        post = tokenizer.spec.post_processor
        trims = bool(post) and post.get("trim_offsets", True)
        self.unit = unit
        self.sizes, self.lead, self.tail = (np.array(x, np.int64) for x in ([len(p) for p in parts], [len(p) - len(p.lstrip(b" ")) if trims else 0 for p in parts], [len(p) - len(p.rstrip(b" ")) if trims else 0 for p in parts]))

    @staticmethod
    def serves(tokenizer: Tokenizer) -> bool:
        s, m = tokenizer.spec, tokenizer.model
        post = s.post_processor or {"type": "ByteLevel", "add_prefix_space": False}
        whole = WordBatches.serves(tokenizer) and type(m) is MODELS["BPE"] and not (s.added_tokens or m.prefix or m.suffix) and all(g in m.vocab for g in GLYPHS)
        return whole and not s.pre_tokenizer.get("add_prefix_space", True) and post.get("type") == "ByteLevel" and not (post.get("trim_offsets", True) and post.get("add_prefix_space", True))

    def offsets(self, column: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token begins and ends in its text, white space at its ends trimmed off where the post-processor does so."""
        data = np.frombuffer("".join(column.to_pylist()).encode("utf-8"), np.uint8)
        begins = (data & 0xC0) != 0x80
        # For each byte, the units before its character and those up to its end.
        if self.unit == "byte":
            at = np.flatnonzero(begins)
            of = np.cumsum(begins) - 1
            before, after = at[of], np.append(at[1:], len(data))[of]
        else:
            wide = begins.astype(np.int64) + (self.unit == "utf16") * (data >= 0xF0)
            after = np.cumsum(wide)
            before = after - wide[np.flatnonzero(begins)][np.cumsum(begins) - 1]
        stops = np.cumsum(self.sizes[ids])
        starts = stops - self.sizes[ids]
        heads = np.concatenate([[0], stops])[np.cumsum(counts) - counts]  # each text's first byte
        first = np.repeat(np.append(before, after[-1:])[heads], counts) if len(data) else np.zeros(0, np.int64)
        a, b = before[starts] - first, after[stops - 1] - first
        lead, tail = self.lead[ids], self.tail[ids]
        a = np.minimum(a + lead, b)
        return a, np.where((tail > 0) & (b >= tail), np.maximum(b - tail, a), b)


def utf8(data: np.ndarray, ends: np.ndarray) -> pa.Array | None:
    """The strings that bytes make up, cut at ends; None if one of them isn't UTF-8."""
    try:
        str(memoryview(data), "utf-8")
    except UnicodeDecodeError:
        return None
    begins = ends[:-1][ends[:-1] < len(data)]
    if (data[begins] & 0xC0 == 0x80).any() or len(data) >= 1 << 31:
        return None
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


class IdBytes:
    """The bytes that ids stand for, under a byte-level decoder, laid out for whole batches."""

    def __init__(self, parts: list[bytes]):
        """parts: by id; the last one stands for unknown ids."""
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def of(tokenizer: Tokenizer, skip_special: bool) -> IdBytes:
        names = tokenizer.model_names | tokenizer.added.names
        parts = [b""] * (max(names, default=-1) + 2)
        for i, t in names.items():
            if not (skip_special and t in tokenizer.added.special):
                parts[i] = bytes(map(BYTE_OF.__getitem__, t)) if all(c in BYTE_OF for c in t) else t.encode("utf-8", "replace")
        return IdBytes(parts)

    @staticmethod
    def serves(tokenizer: Tokenizer) -> bool:
        return (tokenizer.spec.decoder or {}).get("type") == "ByteLevel"

    def texts(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids; bytes that aren't UTF-8 become U+FFFD, null lists give an empty text."""
        ids = np.asarray(lists.flatten().fill_null(-1)).astype(np.int64)
        ids = np.where((ids >= 0) & (ids < len(self.sizes) - 1), ids, len(self.sizes) - 1)
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        sizes = self.sizes[ids]
        data = gathered(self.flat, self.starts[ids], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        if (found := utf8(data, ends)) is not None:
            return found
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


class IdTexts:
    """The texts of ids under decoders that write each token by itself; how may depend on its being the first or the last one."""

    KINDS = frozenset(("WordPiece", "Metaspace", "BPEDecoder", "Replace", "Strip"))

    def __init__(self, tokenizer: Tokenizer, skip_special: bool):
        self.tokenizer, self.skip = tokenizer, skip_special
        names = {i: t for i, t in (tokenizer.model_names | tokenizer.added.names).items() if not (skip_special and t in tokenizer.added.special)}
        chain = self.chain(tokenizer)
        self.n = max(names, default=-1) + 1
        self.known = np.zeros(self.n + 1, bool)
        self.known[list(names)] = True
        tokens = list(names.values())
        # For tokens within a text, at its beginning, at its end, and alone.
        forms = [chain(["", *tokens, ""])[1:-1], [chain([t, ""])[0] for t in tokens], [chain(["", t])[1] for t in tokens], [chain([t])[0] for t in tokens]]
        falls = "ByteFallback" in self.kinds(tokenizer)
        parts = [b""] * (4 * self.n)
        self.parted = falls and any(not t for form in forms for t in form)  # an empty token parts runs of bytes
        for k, form in enumerate(forms):
            for i, t in zip(names, form):
                m = BYTE.match(t) if falls else None
                parts[k * self.n + i] = bytes([int(m[1], 16)]) if m else t.encode("utf-8", "replace")
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def steps(tokenizer: Tokenizer) -> list[dict]:
        d = tokenizer.spec.decoder or {"type": "Sequence", "decoders": []}
        return d["decoders"] if d.get("type") == "Sequence" else [d]

    @staticmethod
    def kinds(tokenizer: Tokenizer) -> list:
        return [s.get("type") for s in IdTexts.steps(tokenizer)]

    @staticmethod
    def chain(tokenizer: Tokenizer):
        from tokenloom.functions.decoders import decoder

        if not tokenizer.spec.decoder:
            return lambda tokens: [t if not k else " " + t for k, t in enumerate(tokens)]
        return decoder({"type": "Sequence", "decoders": [s for s in IdTexts.steps(tokenizer) if s["type"] in IdTexts.KINDS]})

    @staticmethod
    def serves(tokenizer: Tokenizer) -> bool:
        kinds = IdTexts.kinds(tokenizer)
        while kinds[-1:] == ["Fuse"]:
            kinds.pop()
        if kinds[-1:] == ["ByteFallback"]:
            kinds.pop()
        return IdTexts.KINDS.issuperset(kinds) and max(tokenizer.model_names | tokenizer.added.names, default=0) < 1 << 22

    def texts(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids; null lists give an empty text."""
        ids = np.asarray(lists.flatten().fill_null(-1)).astype(np.int64)
        ids = np.where((ids >= 0) & (ids < self.n), ids, self.n)
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        known = self.known[ids]
        bounds = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(counts)])]
        ids, some = ids[known], np.diff(bounds) > 0
        ids[bounds[:-1][some]] += self.n
        ids[bounds[1:][some] - 1] += 2 * self.n
        sizes = self.sizes[ids]
        data, ends = gathered(self.flat, self.starts[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if self.parted:
            return pa.array([self.tokenizer.decode(x or [], self.skip) for x in lists.to_pylist()], pa.string())
        if (found := utf8(data, ends)) is not None:
            return found
        # Bytes that make up no character are told from others within their row alone.
        raw, out = data.tobytes(), []
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            try:
                out.append(raw[a:b].decode("utf-8"))
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(lists[k].as_py() or [], self.skip))
        return pa.array(out, pa.string())
