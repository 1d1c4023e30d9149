"""Decoders: a list of token strings to a list of strings, joined by nothing at the end."""

from __future__ import annotations

import re
from collections.abc import Callable

from tokenloom.functions.extension import extension
from tokenloom.functions.unicode import BYTE_OF, pattern

Chain = Callable[[list[str]], list[str]]
#: Replacements that tidy the spaces before punctuation and contractions, in this order.
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))
BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>\Z")


def tidy(text: str) -> str:
    for a, b in CLEANUP:
        text = text.replace(a, b)
    return text


def bytes_fallback(tokens: list[str]) -> list[str]:
    out: list[str] = []
    run = bytearray()

    def flush() -> None:
        if run:
            try:
                out.append(run.decode("utf-8"))
            except UnicodeDecodeError:
                out.extend("�" for _ in run)
            run.clear()

    for t in tokens:
        if m := BYTE.match(t):
            run.append(int(m[1], 16))
        else:
            flush()
            out.append(t)
    flush()
    return out


def byte_level(tokens: list[str]) -> list[str]:
    data = bytearray()
    for t in tokens:
        data += bytes(map(BYTE_OF.__getitem__, t)) if all(c in BYTE_OF for c in t) else t.encode("utf-8", "replace")
    return [data.decode("utf-8", "replace")]


def decoder(config: dict | None) -> Chain | None:
    if config is None:
        return None
    kind = config["type"]
    if factory := extension(kind):
        return factory(config)
    if kind == "Sequence":
        steps = [decoder(c) for c in config["decoders"]]

        def run(tokens: list[str]) -> list[str]:
            for s in steps:
                tokens = s(tokens)
            return tokens

        return run
    if kind == "BPEDecoder":
        suffix = config.get("suffix", "</w>")
        return lambda tokens: [t.replace(suffix, "" if k == len(tokens) - 1 else " ") for k, t in enumerate(tokens)]
    if kind == "ByteFallback":
        return bytes_fallback
    if kind == "ByteLevel":
        return byte_level
    if kind == "CTC":
        pad, word, clean = config.get("pad_token", "<pad>"), config.get("word_delimiter_token", "|"), config.get("cleanup", True)

        def ctc(tokens: list[str]) -> list[str]:
            once = [t for k, t in enumerate(tokens) if not k or t != tokens[k - 1]]
            out = (t.replace(pad, "") for t in once)
            return [t for t in (tidy(t).replace(word, " ") if clean else t for t in out) if t]

        return ctc
    if kind == "Fuse":
        return lambda tokens: ["".join(tokens)]
    if kind == "Metaspace":
        mark, scheme = config.get("replacement", "▁"), config.get("prepend_scheme", "always")
        if "add_prefix_space" in config and "prepend_scheme" not in config:
            scheme = "always" if config["add_prefix_space"] else "never"
        return lambda tokens: [t.replace(mark, "" if k == 0 and scheme != "never" else " ") for k, t in enumerate(tokens)]
    if kind == "Replace":
        find, content = config["pattern"], config["content"]
        found = re.compile(re.escape(find["String"])) if "String" in find else pattern(find["Regex"])
        return lambda tokens: [found.sub(lambda m: content, t) for t in tokens]
    if kind == "Strip":
        c, start, stop = config.get("content", " "), config.get("start", 0), config.get("stop", 0)

        def strip(t: str) -> str:
            a = 0
            while a < min(start, len(t)) and t[a] == c:
                a += 1
            b = len(t)
            while len(t) - b < stop and b > a and t[b - 1] == c:
                b -= 1
            return t[a:b]

        return lambda tokens: [strip(t) for t in tokens]
    if kind == "WordPiece":
        prefix, clean = config.get("prefix", "##"), config.get("cleanup", True)

        def word_piece(tokens: list[str]) -> list[str]:
            out = [t if not k else t[len(prefix) :] if t.startswith(prefix) else " " + t for k, t in enumerate(tokens)]
            return [tidy(t) for t in out] if clean else out

        return word_piece
    raise ValueError(f"unknown decoder {kind!r}")
