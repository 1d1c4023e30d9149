"""A whole pipeline compiled from a tokenizer.json document: text to encodings and ids to text."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

from tokenloom.functions.decoders import decoder
from tokenloom.functions.encoding import LISTS, Encoding, Processor, truncate_pair
from tokenloom.functions.extension import extension
from tokenloom.functions.models import Bpe, build_model, model_type
from tokenloom.functions.text import Text, normalizer, pre_tokenizer
from tokenloom.functions.unicode import SPACES, pattern


#: Kinds of untagged components, by the fields that they must have; the first that fits is taken.
LEGACY = {
    "normalizer": (("normalizers", "Sequence"), ("clean_text", "BertNormalizer"), ("strip_left", "Strip"), ("prepend", "Prepend"), ("pattern content", "Replace"), ("precompiled_charsmap", "Precompiled")),
    "pre_tokenizer": (("pretokenizers", "Sequence"), ("add_prefix_space trim_offsets", "ByteLevel"), ("delimiter", "CharDelimiterSplit"), ("replacement", "Metaspace"), ("pattern behavior", "Split"), ("behavior", "Punctuation"), ("individual_digits", "Digits"), ("length", "FixedLength")),
    "post_processor": (("processors", "Sequence"), ("sep cls trim_offsets", "RobertaProcessing"), ("sep cls", "BertProcessing"), ("single pair", "TemplateProcessing"), ("trim_offsets", "ByteLevel")),
    "decoder": (("decoders", "Sequence"), ("suffix", "BPEDecoder"), ("prefix cleanup", "WordPiece"), ("replacement", "Metaspace"), ("pad_token", "CTC"), ("pattern content", "Replace"), ("content start stop", "Strip"), ("trim_offsets", "ByteLevel")),
}


def tagged(config: dict | None, part: str) -> dict | None:
    """A component with its tag; children of sequences too."""
    if config is None:
        return None
    if "type" not in config:
        kind = next((k for fields, k in LEGACY[part] if all(f in config for f in fields.split())), None)
        if kind is None:
            raise ValueError(f"an untagged {part} of unknown kind")
        config = {"type": kind} | config
    for name in ("normalizers", "pretokenizers", "processors", "decoders"):
        if name in config:
            config = config | {name: [tagged(x, part) for x in config[name]]}
    return config


@dataclass(frozen=True)
class AddedToken:
    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True
    special: bool = False


@dataclass(frozen=True)
class Spec:
    """The parts of a tokenizer.json; unchangeable, with `with_` for another version."""

    model: dict
    normalizer: dict | None = None
    pre_tokenizer: dict | None = None
    post_processor: dict | None = None
    decoder: dict | None = None
    truncation: dict | None = None
    padding: dict | None = None
    added_tokens: tuple[AddedToken, ...] = ()
    encode_special_tokens: bool = False

    @staticmethod
    def parse(text: str) -> Spec:
        j = json.loads(text)
        if j.get("version") not in (None, "1.0"):
            raise ValueError(f"unknown version {j['version']!r}")
        if j.get("model") is None:
            raise ValueError("the configuration has no model")
        added = []
        for t in j.get("added_tokens") or []:
            flags = {k: bool(t[k]) for k in ("single_word", "lstrip", "rstrip", "special") if k in t}
            added.append(AddedToken(t["content"], normalized=bool(t.get("normalized", not flags.get("special", False))), **flags))
        parts = {k: tagged(j.get(k), k) for k in LEGACY} | {k: j.get(k) for k in ("truncation", "padding")}
        return Spec(model=j["model"], added_tokens=tuple(added), **parts)

    def json(self, pretty: bool = False) -> str:
        added = [{"id": i} | asdict(t) for t, i in sorted(Vocabulary(self, build_model(self.model).vocab).ids.items(), key=lambda x: x[1])]
        model = {"type": model_type(self.model)} | {k: v for k, v in self.model.items() if k != "type"}
        parts = {"version": "1.0", "truncation": self.truncation, "padding": self.padding, "added_tokens": added, "normalizer": self.normalizer}
        parts |= {"pre_tokenizer": self.pre_tokenizer, "post_processor": self.post_processor, "decoder": self.decoder, "model": model}
        return json.dumps(parts, ensure_ascii=False, indent=2 if pretty else None)

    def with_(self, **changes) -> Spec:
        return replace(self, **changes)

    def adding(self, *tokens: AddedToken | str, special: bool = False) -> Spec:
        """The same with more added tokens; those whose content is known already stay as they are."""
        known = {t.content for t in self.added_tokens}
        made = [t if isinstance(t, AddedToken) else AddedToken(t, special=special, normalized=not special) for t in tokens]
        fresh = {t.content: t for t in reversed(made) if t.content and t.content not in known}
        return self.with_(added_tokens=self.added_tokens + tuple(fresh[c] for c in dict.fromkeys(t.content for t in made) if c in fresh))

    def save(self, path: str, pretty: bool = True) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.json(pretty))

    @staticmethod
    def load(path: str) -> Spec:
        with open(path, encoding="utf-8") as f:
            return Spec.parse(f.read())


class Vocabulary:
    """Added tokens beside the model's: their ids, and where they stand in a text."""

    def __init__(self, spec: Spec, vocab: dict[str, int], normal=None):
        self.ids: dict[AddedToken, int] = {}
        self.by_content: dict[str, int] = {}
        top = max(vocab.values(), default=-1) + 1
        for t in spec.added_tokens:
            if not t.content or t.content in self.by_content:
                continue
            found = vocab.get(t.content)
            i = found if found is not None else max([top, *(x + 1 for x in self.by_content.values() if x >= top)])
            self.ids[t] = self.by_content[t.content] = i
        self.special = {t.content for t in self.ids if t.special}
        self.names = {i: t.content for t, i in self.ids.items()}
        forms = {t: normal(Text(t.content, None)).chars if normal and t.normalized else t.content for t in self.ids}
        self.names |= {i: forms[t] for t, i in self.ids.items()}
        skip = spec.encode_special_tokens
        self.raw = self.matcher([(t.content, t) for t in self.ids if not t.normalized and not (skip and t.special)])
        self.normal = self.matcher([(forms[t], t) for t in self.ids if t.normalized and not (skip and t.special)])
        self.word = pattern(r"\w")

    @staticmethod
    def matcher(tokens: list[tuple[str, AddedToken]]):
        if not tokens:
            return None
        table = {c: t for c, t in tokens if c}
        return re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))), table

    def split(self, t: Text, which) -> list[Text]:
        """The text parted at the added tokens that it holds; those pieces carry their id."""
        if which is None or not t.chars:
            return [t]
        found, table = which
        out, at, s = [], 0, t.chars
        for m in found.finditer(s):
            a, b = m.span()
            token = table[m[0]]
            if token.single_word and (a and self.word.match(s[a - 1]) or b < len(s) and self.word.match(s[b])):
                continue
            while token.lstrip and a > at and s[a - 1] in SPACES:
                a -= 1
            while token.rstrip and b < len(s) and s[b] in SPACES:
                b += 1
            if a > at:
                out.append(t.part(at, a))
            piece = t.part(max(a, at), b)
            piece.fixed = self.ids[token]
            out.append(piece)
            at = b
        if at < len(s):
            out.append(t.part(at, len(s)))
        return out


class Tokenizer:
    def __init__(self, spec: Spec | str):
        self.spec = spec = Spec.parse(spec) if isinstance(spec, str) else spec
        self.model = build_model(spec.model)
        self.normal, self.pre = normalizer(spec.normalizer), pre_tokenizer(spec.pre_tokenizer)
        factory = extension((spec.post_processor or {}).get("type"))
        self.post, self.decoded = factory(spec.post_processor) if factory else Processor(spec.post_processor), decoder(spec.decoder)
        self.added = Vocabulary(spec, self.model.vocab, self.normal)
        self.model_names = {i: t for t, i in self.model.vocab.items()}
        self._words, self._bytes, self._chunks = None, {}, {}

    def words(self):
        """What encodes whole columns by their distinct words, or None if this tokenizer isn't one for it."""
        from tokenloom.functions.batches import WordBatches

        if self._words is None and WordBatches.serves(self):
            self._words = WordBatches(self)
        return self._words

    def chunks(self, unit: str, want: tuple[str, ...] = ()):
        """What lays out whole columns of encodings by their distinct chunks (want: none to count), or None if this tokenizer isn't one for it."""
        from tokenloom.functions.batches import ChunkBatches

        if (unit, want) not in self._chunks:
            self.forget()
            self._chunks = {(unit, want): ChunkBatches(self, unit, want) if ChunkBatches.serves(self, not want) else None}
        return self._chunks[unit, want]

    def id_bytes(self, skip_special: bool):
        """What decodes whole columns of ids, or None if the decoder isn't one for it."""
        from tokenloom.functions.batches import IdBytes, IdTexts

        if skip_special not in self._bytes:
            self._bytes[skip_special] = IdBytes.of(self, skip_special) if IdBytes.serves(self) else IdTexts(self, skip_special) if IdTexts.serves(self) else None
        return self._bytes[skip_special]

    def forget(self) -> None:
        """Gives up the words and chunks that are remembered."""
        for held in (self._words, *self._chunks.values(), self.model):
            if hasattr(held, "forget"):
                held.forget()

    # -- vocabulary

    def vocab(self, with_added: bool = True) -> dict[str, int]:
        return self.model.vocab | (self.added.by_content if with_added else {})

    def token_to_id(self, token: str) -> int | None:
        return self.added.by_content.get(token, self.model.vocab.get(token))

    def id_to_token(self, i: int) -> str | None:
        return self.added.names.get(i, self.model_names.get(i))

    # -- pieces

    def pieces(self, text: str, track: bool = True) -> list[Text]:
        """Added tokens and words of a text, in order; empty words are left out."""
        out = []
        for raw in self.added.split(Text.of(text, track), self.added.raw):
            if raw.fixed is not None:
                out.append(raw)
                continue
            for part in self.added.split(self.normal(raw) if self.normal else raw, self.added.normal):
                if part.fixed is not None or self.pre is None:
                    out.append(part)
                else:
                    out += self.pre(part)
        return [p for p in out if p.chars]

    def limited(self, pieces: list[Text], type_id: int) -> list[tuple[int, Text, list]]:
        """(word number, piece, tokens); with truncation, pieces past the limit aren't tokenized at all."""
        t = self.spec.truncation
        limit = None
        if t and not (strategy_name(t) == "onlysecond" and type_id == 1):
            limit = t.get("max_length", 512)
        out, total = [], 0
        left = bool(t) and t.get("direction", "Right").lower() == "left"
        for k in range(len(pieces) - 1, -1, -1) if left else range(len(pieces)):
            if limit is not None and total >= limit:
                break
            p = pieces[k]
            found = [(p.fixed, p.chars, 0, len(p.chars))] if p.fixed is not None else self.model.tokens(p.chars)
            total += len(found)
            out.append((k, p, found))
        return out[::-1] if left else out

    def sequence(self, text: str | list[str], type_id: int = 0, unit: str = "byte") -> Encoding:
        out = Encoding()
        texts = [text] if isinstance(text, str) else text
        for n, one in enumerate(texts):
            at = place(one, unit)
            for k, piece, tokens in self.limited(self.pieces(one, unit != "none"), type_id):
                for i, value, a, b in tokens:
                    out.ids.append(i)
                    out.tokens.append(value if unit != "none" else "")
                    out.words.append(None if unit == "none" else k if isinstance(text, str) else n)
                    span = (piece.spans[a][0], piece.spans[b - 1][1]) if piece.spans and b > a else (0, 0)
                    out.offsets.append((at(span[0]), at(span[1])) if unit != "none" else (0, 0))
        n = len(out)
        out.type_ids, out.special, out.attention = [type_id] * n, [0] * n, [1] * n
        return out

    def finish(self, a: Encoding, b: Encoding | None, add: bool) -> Encoding:
        t = self.spec.truncation
        if t:
            budget = t.get("max_length", 512) - (self.post.added(b is not None) if add else 0)
            truncate_pair(a, b, max(0, budget), t.get("stride", 0), strategy_name(t), t.get("direction", "Right").lower())
        out = self.post.process(a, b, add)
        if self.spec.padding and isinstance(self.spec.padding.get("strategy"), dict):
            pad_to([out], self.spec.padding)
        return out

    # -- what callers use

    def encode(self, text: str | list[str], pair: str | list[str] | None = None, add_special: bool = True, unit: str = "byte") -> Encoding:
        """unit: of offsets, byte, char, utf16 or none."""
        b = None if pair is None else self.sequence(pair, 1, unit)
        return self.finish(self.sequence(text, 0, unit), b, add_special)

    def encode_batch(self, texts: list, add_special: bool = True, unit: str = "byte") -> list[Encoding]:
        out = [self.encode(*(t if isinstance(t, tuple) else (t,)), add_special=add_special, unit=unit) for t in texts]
        if self.spec.padding:
            pad_to(out, self.spec.padding)
        return out

    def count(self, text: str, add_special: bool = False) -> int:
        """The length of the encoding, without offsets."""
        if self.spec.truncation or self.spec.padding:
            return len(self.encode(text, add_special=add_special, unit="none"))
        n = sum(1 if p.fixed is not None else len(self.model.tokens(p.chars)) for p in self.pieces(text, False))
        return n + (self.post.added(False) if add_special else 0)

    def profile(self, text: str) -> dict[str, float]:
        """Seconds and bytes of each stage of counting a text: added tokens, normalizing, words, model."""
        out, clock = {"bytes": float(len(text.encode("utf-8", "surrogatepass")))}, time.perf_counter
        began = clock()
        raw = self.added.split(Text.of(text, False), self.added.raw)
        out["added"], began = clock() - began, clock()
        plain = [r if r.fixed is not None else self.normal(r) if self.normal else r for r in raw]
        out["normalize"], began = clock() - began, clock()
        parts = [p for r in plain for p in ([r] if r.fixed is not None else self.added.split(r, self.added.normal))]
        words = [w for p in parts for w in ([p] if p.fixed is not None or self.pre is None else self.pre(p)) if w.chars]
        out["words"], began = clock() - began, clock()
        out["tokens"] = float(sum(1 if w.fixed is not None else len(self.model.tokens(w.chars)) for w in words))
        out["model"] = clock() - began
        return out

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        tokens = [t for t in map(self.id_to_token, ids) if t is not None and not (skip_special and t in self.added.special)]
        return "".join(self.decoded(tokens)) if self.decoded else " ".join(tokens)

    def decode_chain(self, ids: list[int], skip_special: bool = True) -> list[str]:
        """The pieces that the decoder makes of the ids' tokens, before they are joined."""
        tokens = [t for t in map(self.id_to_token, ids) if t is not None and not (skip_special and t in self.added.special)]
        return self.decoded(tokens) if self.decoded else tokens

    def stream(self, skip_special: bool = True) -> StreamDecoder:
        return StreamDecoder(self, skip_special)


class StreamDecoder:
    """Text as its ids come in one by one; nothing while the end may still be an incomplete character.

    `pending` are the ids whose text has not been given out. Decoders may treat what begins a text in another way, so
    they are decoded behind `context`, the ids of the last text given out, and its part is taken off.
    """

    def __init__(self, tokenizer: Tokenizer, skip_special: bool = True, context: list[int] | None = None, pending: list[int] | None = None):
        self.tokenizer, self.skip, self.context, self.pending = tokenizer, skip_special, context or [], pending or []

    def step(self, i: int) -> str | None:
        self.pending.append(i)
        both = self.tokenizer.decode(self.context + self.pending, self.skip)
        if both.endswith("\ufffd"):
            return None
        seen = self.tokenizer.decode(self.context, self.skip) if self.context else ""
        fresh = both.removeprefix(seen)
        if seen and fresh == both:
            raise ValueError("the decoded text no longer begins with what was given out")
        if fresh:
            self.context, self.pending = self.pending, []
        return fresh or None


def place(text: str, unit: str):
    """From byte offsets to the wanted unit."""
    if unit in ("byte", "none") or unit == "char" and text.isascii():
        return lambda b: b
    table = {}
    at = units = 0
    for c in text:
        n = len(c.encode("utf-8", "surrogatepass"))
        for k in range(n):
            table[at + k] = units
        at += n
        units += 2 if unit == "utf16" and c > "￿" else 1
    table[at] = units
    return table.__getitem__


def strategy_name(t: dict) -> str:
    return t.get("strategy", "LongestFirst").replace("_", "").lower()


def pad_to(encodings: list[Encoding], p: dict) -> None:
    """Pads all to the fixed length, or to the longest of them."""
    strategy = p.get("strategy", "BatchLongest")
    n = strategy["Fixed"] if isinstance(strategy, dict) else max(map(len, encodings), default=0)
    if m := p.get("pad_to_multiple_of"):
        n = -(-n // m) * m
    for e in encodings:
        e.pad(n, p.get("pad_id", 0), p.get("pad_type_id", 0), p.get("pad_token", "[PAD]"), p.get("direction", "Right").lower())


def parts_of(sizes: list[int], most: int = 2_000_000) -> list[tuple[int, int]]:
    """Runs of rows of about `most` bytes together, one row at least."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            out.append((start, k))
            start, total = k, 0
        total += n
    return out + [(start, len(sizes))] if start < len(sizes) else out


_COMPILED: dict[int, Tokenizer] = {}


def compiled(config: str) -> Tokenizer:
    """One tokenizer for each configuration in a Python worker; a few are kept, the latest one, which comes last, with what it remembers."""
    key = hash(config)
    latest = next(reversed(_COMPILED), None)
    if latest != key and latest is not None:
        _COMPILED[latest].forget()
    if key not in _COMPILED and len(_COMPILED) > 8:
        _COMPILED.clear()
    _COMPILED[key] = _COMPILED.pop(key, None) or Tokenizer(config)
    return _COMPILED[key]
