"""Normalizers and pre-tokenizers over texts that know where their characters came from."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from tokenloom.functions.extension import extension
from tokenloom.functions.unicode import GLYPHS, GPT2, PUNCT, SPACES, WORD, WS, pattern, script

Span = tuple[int, int]


@dataclass
class Text:
    """Characters, and for each the range of original bytes that it stands for (None when offsets aren't wanted)."""

    chars: str
    spans: list[Span] | None
    first: bool = True  # begins at the start of the original text
    fixed: int | None = None  # id of an added token

    @staticmethod
    def of(text: str, track: bool = True) -> Text:
        if not track:
            return Text(text, None)
        spans, at = [], 0
        for c in text:
            n = 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
            spans.append((at, at + n))
            at += n
        return Text(text, spans)

    def part(self, a: int, b: int) -> Text:
        return Text(self.chars[a:b], self.spans[a:b] if self.spans is not None else None, self.first and a == 0)

    def rebuilt(self, pieces: list[tuple[str, int]]) -> Text:
        """New characters, each with the index of the old one whose range it takes."""
        chars = "".join(p for p, _ in pieces)
        spans = None if self.spans is None else [self.spans[k] if self.spans else (0, 0) for p, k in pieces for _ in p]
        return Text(chars, spans, self.first)

    def kept(self, keep: Callable[[str], bool]) -> Text:
        if all(map(keep, self.chars)):
            return self
        return self.rebuilt([(c, k) for k, c in enumerate(self.chars) if keep(c)])

    def mapped(self, change: Callable[[str], str]) -> Text:
        return self.rebuilt([(change(c), k) for k, c in enumerate(self.chars)])

    def range(self) -> Span:
        return (self.spans[0][0], self.spans[-1][1]) if self.spans else (0, 0)


# -- normalizers: config -> Text -> Text


def is_cjk(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0x20000 <= n <= 0x2A6DF or 0x2A700 <= n <= 0x2B73F or 0x2B740 <= n <= 0x2B81F or 0x2B920 <= n <= 0x2CEAF or 0xF900 <= n <= 0xFAFF or 0x2F800 <= n <= 0x2FA1F


def unicode_form(form: str) -> Callable[[Text], Text]:
    def run(t: Text) -> Text:
        if t.chars.isascii() or unicodedata.is_normalized(form, t.chars):
            return t
        if t.spans is None:
            return Text(unicodedata.normalize(form, t.chars), None, t.first)
        # A run begins where a character starts a new composition; within it, decomposed ones follow their own origin.
        out, k, n = [], 0, len(t.chars)
        while k < n:
            e = k + 1
            while e < n and (unicodedata.combining(t.chars[e]) or len(unicodedata.normalize(form, t.chars[k : e + 1])) < len(unicodedata.normalize(form, t.chars[k:e])) + len(unicodedata.normalize(form, t.chars[e]))):
                e += 1
            made = unicodedata.normalize(form, t.chars[k:e])
            parts = [x for x in range(k, e) for _ in unicodedata.normalize(form if form.endswith("D") else form.replace("C", "D"), t.chars[x])]
            for x, c in enumerate(made):
                out.append((c, parts[x] if form.endswith("D") and x < len(parts) else k if x == 0 else min(k + x, e - 1)))
            k = e
        return t.rebuilt(out)

    return run


def simple_lower(c: str) -> str:
    """One character for one: where lower case takes two (U+0130), the character stays."""
    low = c.lower()
    return low if len(low) == 1 else c


def bert(config: dict) -> Callable[[Text], Text]:
    lower = config.get("lowercase", True)
    strip = config.get("strip_accents")
    strip = lower if strip is None else strip

    def control(c: str) -> bool:
        return c not in "\t\n\r" and unicodedata.category(c) in ("Cc", "Cf", "Cn", "Co") and c < "\U00010000"

    def run(t: Text) -> Text:
        if config.get("clean_text", True):
            t = t.kept(lambda c: c not in "\0�" and not control(c)).mapped(lambda c: " " if c in SPACES else c)
        if config.get("handle_chinese_chars", True) and any(map(is_cjk, t.chars)):
            t = t.rebuilt([(f" {c} " if is_cjk(c) else c, k) for k, c in enumerate(t.chars)])
        if strip:
            t = unicode_form("NFD")(t).kept(lambda c: unicodedata.category(c) != "Mn" or c >= "\U00010000")
        return t.mapped(simple_lower) if lower else t

    return run


def replaced(find: str, literal: bool, content: str) -> Callable[[Text], Text]:
    import regex

    found = regex.compile(regex.escape(find)) if literal else pattern(find)

    def run(t: Text) -> Text:
        out, at = [], 0
        for m in found.finditer(t.chars):
            if m.end() == m.start():
                continue
            out += [(t.chars[k], k) for k in range(at, m.start())]
            if content:
                out.append((content, m.end() - 1))
            at = m.end()
        return t if not at else t.rebuilt(out + [(t.chars[k], k) for k in range(at, len(t.chars))])

    return run


def stripped(left: bool, right: bool) -> Callable[[Text], Text]:
    def run(t: Text) -> Text:
        a, b = 0, len(t.chars)
        while left and a < b and t.chars[a] in SPACES:
            a += 1
        while right and b > a and t.chars[b - 1] in SPACES:
            b -= 1
        return t.part(a, b)

    return run


NMT_GONE = frozenset(map(chr, [*range(1, 9), 0xB, *range(0xE, 0x20), 0x7F, 0x8F, 0x9F]))
NMT_SPACE = frozenset(map(chr, [9, 10, 12, 13, 0x1680, *range(0x200B, 0x2010), 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]))


TO_GLYPH = dict(enumerate(GLYPHS))


def byte_glyphs(t: Text) -> Text:
    if t.spans is None:
        return Text(t.chars.encode("utf-8", "replace").decode("latin-1").translate(TO_GLYPH), None, t.first)
    return t.rebuilt([("".join(GLYPHS[b] for b in c.encode("utf-8", "replace")), k) for k, c in enumerate(t.chars)])


def normalizer(config: dict | None) -> Callable[[Text], Text] | None:
    if config is None:
        return None
    kind = config["type"]
    if factory := extension(kind):
        return factory(config)
    if kind == "Sequence":
        steps = [normalizer(c) for c in config["normalizers"]]

        def run(t: Text) -> Text:
            for s in steps:
                t = s(t)
            return t

        return run
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return unicode_form(kind)
    if kind in ("BertNormalizer", "Bert"):
        return bert(config)
    if kind == "Lowercase":
        return lambda t: t.mapped(simple_lower)
    if kind == "Strip":
        return stripped(config.get("strip_left", False), config.get("strip_right", False))
    if kind == "StripAccents":
        return lambda t: t.kept(lambda c: not unicodedata.category(c).startswith("M") or c >= "\U00010000")
    if kind == "Nmt":
        return lambda t: t.kept(lambda c: c not in NMT_GONE).mapped(lambda c: " " if c in NMT_SPACE else c)
    if kind == "Precompiled":
        return lambda t: t
    if kind == "ByteLevel":
        return byte_glyphs
    if kind == "Prepend":
        return lambda t: t.rebuilt([(config["prepend"], 0), *((c, k) for k, c in enumerate(t.chars))]) if t.chars else t
    if kind == "Replace":
        find = config["pattern"]
        return replaced(find.get("String", find.get("Regex")), "String" in find, config["content"])
    raise ValueError(f"unknown normalizer {kind!r}")


# -- splitting


def cover(t: str, found, invert: bool = False) -> list[tuple[int, int, bool]]:
    """Ranges that cover the whole text, and whether each is a match."""
    out, at = [], 0
    for m in found.finditer(t):
        a, b = m.span()
        if a == b:
            continue
        if a > at:
            out.append((at, a, invert))
        out.append((a, b, not invert))
        at = b
    if at < len(t):
        out.append((at, len(t), invert))
    return out


def split_ranges(t: str, found, behavior: str, invert: bool = False) -> list[Span]:
    ranges = cover(t, found, invert)
    if behavior == "removed":
        return [(a, b) for a, b, m in ranges if not m]
    if behavior == "isolated":
        return [(a, b) for a, b, _ in ranges]
    out: list[Span] = []
    before = None
    if behavior == "contiguous":
        for a, b, m in ranges:
            if out and m == before:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            before = m
    elif behavior == "mergedwithprevious":
        for a, b, m in ranges:
            if m and out and not before:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            before = m
    elif behavior == "mergedwithnext":
        for a, b, m in reversed(ranges):
            if m and out and not before:
                out[-1] = (a, out[-1][1])
            else:
                out.append((a, b))
            before = m
        out.reverse()
    else:
        raise ValueError(f"unknown split behavior {behavior!r}")
    return out


def behavior_name(name: str) -> str:
    return name.replace("_", "").lower()


class Splitter:
    def __init__(self, found, behavior: str, invert: bool):
        self.found, self.behavior, self.invert = found, behavior, invert

    def __call__(self, t: Text) -> list[Text]:
        return [t.part(a, b) for a, b in split_ranges(t.chars, self.found, self.behavior, self.invert)]

    def strings(self, t: str) -> list[str]:
        """The characters of the pieces alone."""
        if self.behavior in ("removed", "isolated") and not self.found.groups:
            matches, gaps = self.found.findall(t), self.found.split(t)
            if len(gaps) == len(matches) + 1 and "" not in matches:  # empty matches part nothing
                if self.behavior == "removed":
                    return [p for p in (matches if self.invert else gaps) if p]
                out = [""] * (len(gaps) + len(matches))
                out[::2], out[1::2] = gaps, matches
                return [p for p in out if p]
        return [t[a:b] for a, b in split_ranges(t, self.found, self.behavior, self.invert)]


def splitter(found, behavior: str, invert: bool = False) -> Splitter:
    return Splitter(found, behavior, invert)


class Steps:
    """Pre-tokenizers one after another, each over the pieces of the one before."""

    def __init__(self, steps: list[Callable[[Text], list[Text]]]):
        self.steps = steps

    def __call__(self, t: Text) -> list[Text]:
        parts = [t]
        for s in self.steps:
            parts = [x for p in parts for x in s(p) if x.chars]
        return parts


def piece_strings(config: dict) -> Callable[[str], list[str]]:
    """What a pre-tokenizer makes of a text, as strings, empty ones left out; where it only splits, no `Text` is made for a piece."""
    cut = pre_tokenizer(config)
    steps = cut.steps if isinstance(cut, Steps) else [cut]
    if not all(isinstance(s, Splitter) for s in steps):
        return lambda t: [p.chars for p in cut(Text(t, None)) if p.chars]

    def run(t: str) -> list[str]:
        parts = [t]
        for s in steps:
            parts = [x for p in parts for x in s.strings(p)]
        return parts

    return run


def metaspace(config: dict) -> Callable[[Text], list[Text]]:
    mark, scheme, split = config.get("replacement", "▁"), config.get("prepend_scheme", "always"), config.get("split", True)
    if "add_prefix_space" in config and "prepend_scheme" not in config:
        scheme = "always" if config["add_prefix_space"] else "never"
    import regex

    found = regex.compile(regex.escape(mark))

    def run(t: Text) -> list[Text]:
        t = t.mapped(lambda c: mark if c == " " else c)
        if (scheme == "always" or scheme == "first" and t.first) and t.chars and not t.chars.startswith(mark):
            t = t.rebuilt([(mark, 0), *((c, k) for k, c in enumerate(t.chars))])
        return [t.part(a, b) for a, b in split_ranges(t.chars, found, "mergedwithnext")] if split else [t]

    return run


def by_script(t: Text) -> list[Text]:
    cuts, last, begun = [], None, None
    for k, c in enumerate(t.chars):
        s = script(c)
        if s != "Any":
            if begun is None:
                begun = k
                cuts.append(k)
            elif s != last and last is not None:
                cuts.append(k)
            last = s
    if begun is None:
        return []
    cuts.append(len(t.chars))
    return [t.part(a, b) for a, b in zip(cuts, cuts[1:])]


def byte_level(config: dict) -> Callable[[Text], list[Text]]:
    prefix, use = config.get("add_prefix_space", True), config.get("use_regex", True)
    found = pattern(GPT2)

    def run(t: Text) -> list[Text]:
        if prefix and t.chars and t.chars[0] != " ":
            t = t.rebuilt([(" ", 0), *((c, k) for k, c in enumerate(t.chars))])
        if t.spans is None and use:  # the pattern covers every text
            return [byte_glyphs(Text(p, None)) for p in found.findall(t.chars)]
        parts = [t.part(a, b) for a, b in split_ranges(t.chars, found, "isolated")] if use else [t]
        return [byte_glyphs(p) for p in parts]

    return run


def pre_tokenizer(config: dict | None) -> Callable[[Text], list[Text]] | None:
    if config is None:
        return None
    kind = config["type"]
    if factory := extension(kind):
        return factory(config)
    if kind == "Sequence":
        return Steps([pre_tokenizer(c) for c in config["pretokenizers"]])
    if kind == "BertPreTokenizer":
        return Steps([splitter(pattern(f"[{WS}]"), "removed"), splitter(pattern(f"[{PUNCT}]"), "isolated")])
    if kind == "ByteLevel":
        return byte_level(config)
    if kind in ("CharDelimiterSplit", "Delimiter"):
        import regex

        return splitter(regex.compile(regex.escape(config["delimiter"])), "removed")
    if kind == "Digits":
        return splitter(pattern(r"\p{N}"), "isolated" if config.get("individual_digits") else "contiguous")
    if kind == "FixedLength":
        n = config.get("length", 5)
        return lambda t: [t.part(a, min(a + n, len(t.chars))) for a in range(0, len(t.chars), n)] if n > 0 else []
    if kind == "Metaspace":
        return metaspace(config)
    if kind == "Punctuation":
        return splitter(pattern(f"[{PUNCT}]"), behavior_name(config.get("behavior", "Isolated")))
    if kind == "Split":
        import regex

        find = config["pattern"]
        found = regex.compile(regex.escape(find["String"])) if "String" in find else pattern(find["Regex"])
        return splitter(found, behavior_name(config["behavior"]), config.get("invert", False))
    if kind == "UnicodeScripts":
        return by_script
    if kind == "Whitespace":
        return splitter(pattern(f"[{WORD}]+|[^{WORD}{WS}]+"), "removed", True)
    if kind == "WhitespaceSplit":
        return splitter(pattern(f"[{WS}]"), "removed")
    raise ValueError(f"unknown pre-tokenizer {kind!r}")
