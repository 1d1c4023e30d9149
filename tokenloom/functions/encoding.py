"""Encodings: parallel lists about the tokens of a text, and what is done to whole encodings."""

from __future__ import annotations

from dataclasses import dataclass, field

from tokenloom.functions.unicode import GLYPHS, SPACES

Span = tuple[int, int]
LISTS = ("ids", "type_ids", "tokens", "words", "offsets", "special", "attention")


@dataclass
class Encoding:
    ids: list[int] = field(default_factory=list)
    type_ids: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    words: list[int | None] = field(default_factory=list)
    offsets: list[Span] = field(default_factory=list)
    special: list[int] = field(default_factory=list)
    attention: list[int] = field(default_factory=list)
    overflow: list[Encoding] = field(default_factory=list)
    ranges: dict[int, Span] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, a: int, b: int) -> Encoding:
        return Encoding(*(getattr(self, n)[a:b] for n in LISTS))

    def alone(self) -> Encoding:
        out = self.cut(0, len(self))
        out.ranges = dict(self.ranges)
        return out

    # -- positions, tokens, words

    def range_of(self, sequence: int) -> Span:
        return self.ranges.get(sequence, (0, len(self)))

    def token_to_sequence(self, token: int) -> int | None:
        if token >= len(self):
            return None
        if not self.ranges:
            return 0
        return next((s for s, (a, b) in self.ranges.items() if a <= token < b), None)

    def word_to_tokens(self, word: int, sequence: int = 0) -> Span | None:
        a, b = self.range_of(sequence)
        at = [k for k in range(a, b) if self.words[k] == word]
        return (at[0], at[-1] + 1) if at else None

    def word_to_chars(self, word: int, sequence: int = 0) -> Span | None:
        at = self.word_to_tokens(word, sequence)
        return (self.offsets[at[0]][0], self.offsets[at[1] - 1][1]) if at else None

    def token_to_chars(self, token: int) -> tuple[int, Span] | None:
        s = self.token_to_sequence(token)
        return None if s is None else (s, self.offsets[token])

    def token_to_word(self, token: int) -> tuple[int, int] | None:
        s = self.token_to_sequence(token)
        return None if s is None or self.words[token] is None else (s, self.words[token])

    def char_to_token(self, at: int, sequence: int = 0) -> int | None:
        a, b = self.range_of(sequence)
        return next((k for k in range(a, b) if self.offsets[k][0] <= at < self.offsets[k][1]), None)

    def char_to_word(self, at: int, sequence: int = 0) -> int | None:
        k = self.char_to_token(at, sequence)
        return None if k is None else self.words[k]

    # -- whole encodings

    def merge(self, other: Encoding, growing: bool = False) -> Encoding:
        """This one, then the other; parts that overflowed are combined with each other and with both."""
        over = [x for o in self.overflow for x in (o.alone().merge(other.alone(), growing), *(o.alone().merge(p.alone(), growing) for p in other.overflow))]
        over += [self.alone().merge(p.alone(), growing) for p in other.overflow]
        shift = self.offsets[-1][1] if growing and self.offsets else 0
        n = len(self)
        for name in LISTS:
            theirs = getattr(other, name)
            getattr(self, name).extend([(a + shift, b + shift) for a, b in theirs] if name == "offsets" else theirs)
        self.ranges |= {s: (a + n, b + n) for s, (a, b) in other.ranges.items()}
        self.overflow = over
        return self

    def truncate(self, most: int, stride: int = 0, direction: str = "right") -> None:
        n = len(self)
        if most >= n:
            return
        if most == 0:
            whole = self.alone()
            for name in LISTS:
                getattr(self, name).clear()
            self.overflow, self.ranges = [whole], {}
            return
        if stride >= most:
            raise ValueError("stride must be less than the maximal length")
        parts = []
        if direction == "right":
            for a in range(0, n, most - stride):
                parts.append((a, min(a + most, n)))
                if a + most >= n:
                    break
        else:
            for b in range(n, 0, stride - most):
                parts.append((max(0, b - most), b))
                if b <= most:
                    break
        cut = [self.cut(a, b) for a, b in parts]
        for name in LISTS:
            setattr(self, name, getattr(cut[0], name))
        self.overflow, self.ranges = cut[1:], {}

    def pad(self, to: int, pad_id: int, pad_type: int, pad_token: str, direction: str) -> None:
        for o in self.overflow:
            o.pad(to, pad_id, pad_type, pad_token, direction)
        n = to - len(self)
        if n <= 0:
            return
        fill = {"ids": pad_id, "type_ids": pad_type, "tokens": pad_token, "words": None, "offsets": (0, 0), "special": 1, "attention": 0}
        for name, v in fill.items():
            mine = getattr(self, name)
            setattr(self, name, [v] * n + mine if direction == "left" else mine + [v] * n)
        if direction == "left":
            self.ranges = {s: (a + n, b + n) for s, (a, b) in self.ranges.items()}


def truncate_pair(a: Encoding, b: Encoding | None, most: int, stride: int, strategy: str, direction: str) -> None:
    if most == 0:
        a.truncate(0, stride, direction)
        if b is not None:
            b.truncate(0, stride, direction)
        return
    total = len(a) + (len(b) if b is not None else 0)
    if total <= most:
        return
    if strategy == "longestfirst":
        if b is None:
            a.truncate(most, stride, direction)
            return
        # The shorter one keeps its tokens as far as half of the room goes; the other has the rest.
        kept = min(len(a), len(b), most // 2)
        first = most - kept if len(a) > len(b) else kept
        a.truncate(first, stride, direction)
        b.truncate(most - first, stride, direction)
        return
    target = a if strategy == "onlyfirst" else b
    if target is None:
        raise ValueError("there is no second text to truncate")
    if len(target) <= total - most:
        raise ValueError("the text to truncate is too short")
    target.truncate(len(target) - (total - most), stride, direction)


def specials(tokens: list[tuple[str, int]], type_id: int) -> Encoding:
    n = len(tokens)
    return Encoding([i for _, i in tokens], [type_id] * n, [t for t, _ in tokens], [None] * n, [(0, 0)] * n, [1] * n, [1] * n)


def trim(e: Encoding, prefix: bool) -> None:
    """Offsets without the white space at a token's ends."""
    for o in e.overflow:
        trim(o, prefix)
    space = GLYPHS[32]
    for k, (t, (a, b)) in enumerate(zip(e.tokens, e.offsets)):
        lead = 0
        while lead < len(t) and (t[lead] == space or t[lead] in SPACES):
            lead += 1
        tail = 0
        while tail < len(t) and (t[-1 - tail] == space or t[-1 - tail] in SPACES):
            tail += 1
        if lead:
            if prefix and (k == 0 or a == 0):
                lead -= 1
            a = min(a + lead, b)
        if tail and b >= tail:
            b = max(b - tail, a)
        e.offsets[k] = (a, b)


def set_types(e: Encoding, type_id: int) -> None:
    for x in (e, *e.overflow):
        x.type_ids = [type_id] * len(x)


def set_sequence(e: Encoding, n: int) -> None:
    e.ranges = {n: (0, len(e))}


def wrap(e: Encoding, before: list[tuple[str, int]], after: list[tuple[str, int]], type_id: int, sequence: int) -> Encoding:
    """Specials around an encoding and around each part that overflowed."""
    def one(x: Encoding) -> Encoding:
        set_sequence(x, sequence)
        return specials(before, type_id).merge(x).merge(specials(after, type_id))

    over = [one(o) for o in e.overflow]
    out = one(e.alone())
    out.overflow = over
    return out


class Processor:
    """A post-processor from its configuration; none leaves encodings as they are."""

    def __init__(self, config: dict | None):
        self.config, self.kind = config, config["type"] if config else None
        self.children = [Processor(c) for c in config["processors"]] if self.kind == "Sequence" else []
        if self.kind == "TemplateProcessing":
            self.single, self.pair = ([piece(p) for p in config[k]] for k in ("single", "pair"))
            self.table = config.get("special_tokens", {})
            for k, i, _ in self.single + self.pair:
                if k == "special" and i not in self.table:
                    raise ValueError(f"the template names {i!r}, which has no ids")
            if self.pair and not {"A", "B"} <= {i for k, i, _ in self.pair if k == "sequence"}:
                raise ValueError("a template for pairs must use both texts")

    def added(self, pair: bool) -> int:
        if self.kind == "BertProcessing":
            return 3 if pair else 2
        if self.kind == "RobertaProcessing":
            return 4 if pair else 2
        if self.kind == "TemplateProcessing":
            return sum(len(self.table[i]["ids"]) for k, i, _ in (self.pair if pair else self.single) if k == "special")
        return sum(c.added(pair) for c in self.children)

    def run(self, encodings: list[Encoding], add: bool) -> list[Encoding]:
        c = self.config
        if self.kind == "Sequence":
            for child in self.children:
                encodings = child.run(encodings, add)
        elif self.kind == "ByteLevel":
            if c.get("trim_offsets", True):
                for e in encodings:
                    trim(e, c.get("add_prefix_space", True))
            for k, e in enumerate(encodings):
                set_sequence(e, k)
        elif self.kind == "BertProcessing" and add:
            cls, sep = tuple(c["cls"]), tuple(c["sep"])
            encodings = [wrap(e, [cls] if k == 0 else [], [sep], k, k) for k, e in enumerate(encodings)]
        elif self.kind == "RobertaProcessing":
            if c.get("trim_offsets", True):
                for e in encodings:
                    trim(e, c.get("add_prefix_space", True))
            for e in encodings:
                set_types(e, 0)
            if add:
                cls, sep = tuple(c["cls"]), tuple(c["sep"])
                encodings = [wrap(e, [cls] if k == 0 else [sep], [sep], 0, k) for k, e in enumerate(encodings)]
        elif self.kind == "TemplateProcessing":
            out = []
            for kind, i, type_id in self.pair if len(encodings) == 2 else self.single:
                if kind == "sequence":
                    n = 0 if i == "A" else 1
                    e = Encoding(*(list(getattr(encodings[n], x)) for x in LISTS), overflow=[o.alone() for o in encodings[n].overflow])
                    set_types(e, type_id)
                    set_sequence(e, n)
                    for o in e.overflow:
                        set_sequence(o, n)
                    out.append(e)
                elif add:
                    t = self.table[i]
                    out.append(specials(list(zip(t["tokens"], t["ids"])), type_id))
            encodings = out
        return encodings

    def process(self, a: Encoding, b: Encoding | None, add: bool) -> Encoding:
        encodings = [a] if b is None else [a, b]
        for k, e in enumerate(encodings):
            set_types(e, k)
            set_sequence(e, k)
            for o in e.overflow:
                set_sequence(o, k)
        out = Encoding()
        first = True
        for e in self.run(encodings, add):
            out = e if first else out.merge(e)
            first = False
        return out


def piece(config) -> tuple[str, str, int]:
    """A template's piece: ('sequence', 'A' or 'B', type) or ('special', name, type), from JSON or from its short form."""
    if isinstance(config, dict):
        if "Sequence" in config:
            return "sequence", config["Sequence"]["id"], config["Sequence"].get("type_id", 0)
        return "special", config["SpecialToken"]["id"], config["SpecialToken"].get("type_id", 0)
    name, _, kind = config.rpartition(":") if ":" in config and config.rpartition(":")[2].isdigit() else (config, "", "0")
    if name.startswith("$"):
        rest = name[1:].upper()
        if rest in ("", "A", "B"):
            return "sequence", rest or "A", int(kind)
        if rest.isdigit():
            return "sequence", "A", int(rest)
        raise ValueError(f"bad template piece {config!r}")
    return "special", name, int(kind)


def template_string(pieces: list[dict]) -> str:
    """The string form of a template's JSON: `$A`, `$B:1`, `[SEP]:1`; a type id of 0 is left out."""
    out = []
    for p in pieces:
        (kind, x), = p.items()
        name = f"${x['id']}" if kind == "Sequence" else x["id"]
        out.append(name if not x.get("type_id") else f"{name}:{x['type_id']}")
    return " ".join(out)


def template_pieces(template: str) -> list[dict]:
    """The JSON of a template given as a string such as `[CLS] $A [SEP]`."""
    out = []
    for word in template.split():
        kind, i, t = piece(word)
        out.append({"Sequence": {"id": i, "type_id": t}} if kind == "sequence" else {"SpecialToken": {"id": i, "type_id": t}})
    return out
