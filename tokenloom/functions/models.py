"""Models: a word to tokens. Each token is (id, value, first character, end character) within the word."""

from __future__ import annotations

import heapq
import math
import random
from heapq import nlargest

from tokenloom.functions.extension import extension

Token = tuple[int, str, int, int]
KEPT = 100_000


class WordLevel:
    def __init__(self, config: dict):
        self.vocab, self.unk = config["vocab"], config.get("unk_token", "<unk>")

    def tokens(self, word: str) -> list[Token]:
        found, value = self.vocab.get(word), word
        if found is None:
            found, value = self.vocab.get(self.unk), self.unk
        if found is None:
            raise ValueError(f"neither {word!r} nor the unknown token is in the vocabulary")
        return [(found, value, 0, len(word))]


class WordPiece:
    def __init__(self, config: dict):
        self.vocab, self.unk = config["vocab"], config.get("unk_token", "[UNK]")
        self.prefix, self.most = config.get("continuing_subword_prefix", "##"), config.get("max_input_chars_per_word", 100)
        self.longest = max(map(len, self.vocab), default=0)

    def tokens(self, word: str) -> list[Token]:
        out: list[Token] = []
        start, n = 0, len(word)
        while start < n <= self.most:
            for end in range(min(n, start + self.longest), start, -1):
                value = (self.prefix if start else "") + word[start:end]
                if (found := self.vocab.get(value)) is not None:
                    out.append((found, value, start, end))
                    start = end
                    break
            else:
                break
        if start < n:
            if self.unk not in self.vocab:
                raise ValueError("the unknown token is not in the vocabulary")
            return [(self.vocab[self.unk], self.unk, 0, n)]
        return out


class Bpe:
    def __init__(self, config: dict):
        self.vocab: dict[str, int] = config["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.prefix, self.suffix = config.get("continuing_subword_prefix") or "", config.get("end_of_word_suffix") or ""
        self.unk, self.fuse, self.fallback = config.get("unk_token"), config.get("fuse_unk") or False, config.get("byte_fallback") or False
        self.whole, self.dropout = config.get("ignore_merges") or False, config.get("dropout")
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(config.get("merges", [])):
            a, b = m.split(" ") if isinstance(m, str) else m
            made = a + (b[len(self.prefix) :] if self.prefix and b.startswith(self.prefix) else b)
            if a in self.vocab and b in self.vocab and made in self.vocab:
                self.rules[self.vocab[a], self.vocab[b]] = (rank, self.vocab[made])
        self.known: dict[str, list[Token]] = {}
        self.hits = self.misses = self.skips = self.evictions = 0
        self.random = random.Random(0)

    def symbols(self, word: str) -> list[list[int]]:
        """[id, first character, end character] of each symbol before any merge."""
        out: list[list[int]] = []
        last = len(word) - 1
        pending = None
        for k, c in enumerate(word):
            name = (self.prefix if k else "") + c + (self.suffix if k == last else "")
            found = self.vocab.get(name)
            if found is None and self.fallback:
                parts = [self.vocab.get(f"<0x{b:02X}>") for b in name.encode("utf-8")]
                if None not in parts:
                    if pending:
                        out.append(pending)
                        pending = None
                    out += [[p, k, k + 1] for p in parts]
                    continue
            if found is not None:
                if pending:
                    out.append(pending)
                    pending = None
                out.append([found, k, k + 1])
            elif self.unk is not None:
                if self.unk not in self.vocab:
                    raise ValueError("the unknown token is not in the vocabulary")
                if pending and self.fuse:
                    pending[2] = k + 1
                else:
                    if pending:
                        out.append(pending)
                    pending = [self.vocab[self.unk], k, k + 1]
        return out + [pending] if pending else out

    def merged(self, word: str) -> list[Token]:
        """The merges in order of rank, leftmost first; what may be merged next waits in a heap, so long words take no longer than their share."""
        s, dropout = self.symbols(word), self.dropout or 0.0
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        waiting: list[tuple[int, int, int, int, int]] = []  # rank, place, what it makes, and the ids it was found for

        def offer(k: int) -> None:
            if 0 <= k and after[k] < len(s) and (rule := self.rules.get((s[k][0], s[after[k]][0]))):
                heapq.heappush(waiting, (rule[0], k, rule[1], s[k][0], s[after[k]][0]))

        for k in range(len(s)):
            offer(k)
        while waiting:
            skipped = []
            while dropout and waiting and self.random.random() < dropout:
                skipped.append(heapq.heappop(waiting))
            if not waiting:
                break
            _, k, made, left, right = heapq.heappop(waiting)
            for x in skipped:
                heapq.heappush(waiting, x)
            j = after[k]
            if s[k] is None or s[k][0] != left or j >= len(s) or s[j][0] != right:
                continue  # one of the two has gone into another merge
            s[k] = [made, s[k][1], s[j][2]]
            s[j], after[k] = None, after[j]
            if after[k] < len(s):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [(x[0], self.names[x[0]], x[1], x[2]) for x in s if x is not None]

    def tokens(self, word: str) -> list[Token]:
        if self.whole and (found := self.vocab.get(word)) is not None:
            return [(found, word, 0, len(word))]
        if self.dropout:
            return self.merged(word)
        if (out := self.known.get(word)) is not None:
            self.hits += 1
            return out
        self.misses += 1
        out = self.merged(word)
        if len(word) >= 256:
            self.skips += 1
            return out
        if len(self.known) >= KEPT:
            self.evictions += len(self.known)
            self.known.clear()
        self.known[word] = out
        return out

    def forget(self) -> None:
        """Gives remembered words up, for callers that remember what they make of them."""
        self.evictions += len(self.known)
        self.known.clear()

    def cache_stats(self) -> dict[str, int]:
        """How often a word was known, new, or too long to be kept, and how many were given up."""
        return {"hits": self.hits, "misses": self.misses, "skips": self.skips, "evictions": self.evictions, "kept": len(self.known)}


class Unigram:
    """The most probable segmentation; unknown characters cost ten less than the rarest piece."""

    def __init__(self, config: dict):
        pieces = config["vocab"]
        self.names = [p for p, _ in pieces]
        self.scores = [float(s) for _, s in pieces]
        self.vocab = {p: i for i, p in enumerate(self.names)}
        self.unk, self.fallback, self.fuse = config.get("unk_id"), config.get("byte_fallback") or False, config.get("fuse_unk", True)
        self.least = min(self.scores, default=0.0) - 10.0
        self.longest = max(map(len, self.names), default=1)
        self.known: dict[str, list[Token]] = {}

    def edges(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each start: (end, id, score), the unknown character only where no piece is one character long."""
        out = []
        for a in range(len(word)):
            row, single = [], False
            for b in range(a + 1, min(len(word), a + self.longest) + 1):
                if (i := self.vocab.get(word[a:b])) is not None:
                    row.append((b, i, self.scores[i]))
                    single |= b == a + 1
            if not single and self.unk is not None:
                row.append((a + 1, self.unk, self.least))
            out.append(row)
        return out

    def best(self, word: str) -> list[tuple[int, int, int]]:
        n = len(word)
        score, back = [-math.inf] * (n + 1), [(0, 0)] * (n + 1)
        score[0] = 0.0
        for a, row in enumerate(self.edges(word)):
            if score[a] == -math.inf:
                continue
            for b, i, s in row:
                if score[a] + s > score[b]:
                    score[b], back[b] = score[a] + s, (a, i)
        if n and score[n] == -math.inf:
            raise ValueError("a text holds characters that the vocabulary lacks, and there is no unknown token")
        out, at = [], n
        while at:
            a, i = back[at]
            out.append((i, a, at))
            at = a
        return out[::-1]

    def n_best(self, word: str, n: int) -> list[list[tuple[int, int, int]]]:
        """The n most probable segmentations, best first."""
        paths: list[list[tuple[float, list]]] = [[] for _ in range(len(word) + 1)]
        paths[0] = [(0.0, [])]
        for a, row in enumerate(self.edges(word)):
            paths[a] = nlargest(n, paths[a], key=lambda p: p[0])
            for b, i, s in row:
                paths[b] += [(score + s, [*path, (i, a, b)]) for score, path in paths[a]]
        return [path for _, path in nlargest(n, paths[-1], key=lambda p: p[0])] if n > 0 else []

    def sample(self, word: str, alpha: float = 1.0, n: int = 64, seed: int = 0) -> list[tuple[int, int, int]]:
        """One of the n best, drawn by its probability to the power alpha."""
        paths = self.n_best(word, n)
        worth = [sum(self.scores[i] if i != self.unk else self.least for i, _, _ in p) * alpha for p in paths]
        top = max(worth, default=0.0)
        return random.Random(seed).choices(paths, [math.exp(w - top) for w in worth])[0] if paths else []

    def marginals(self, word: str, freq: float = 1.0) -> tuple[float, dict[int, float]]:
        """freq times the log of the total probability, and the expected count of each piece."""
        edges, n = self.edges(word), len(word)
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        for a in range(n):
            for b, _, s in edges[a]:
                alpha[b] = log_sum_exp(alpha[b], alpha[a] + s)
        for a in range(n - 1, -1, -1):
            for b, _, s in edges[a]:
                beta[a] = log_sum_exp(beta[a], beta[b] + s)
        out: dict[int, float] = {}
        for a in range(n):
            for b, i, s in edges[a]:
                out[i] = out.get(i, 0.0) + freq * math.exp(alpha[a] + s + beta[b] - alpha[n])
        return freq * alpha[n], out

    def tokens(self, word: str) -> list[Token]:
        if (out := self.known.get(word)) is not None:
            return out
        parts = self.best(word)
        if self.fuse:
            fused: list[tuple[int, int, int]] = []
            for p in parts:
                if fused and p[0] == self.unk == fused[-1][0]:
                    fused[-1] = (p[0], fused[-1][1], p[2])
                else:
                    fused.append(p)
            parts = fused
        out = []
        for i, a, b in parts:
            value = word[a:b]
            if i == self.unk and value != self.names[i]:
                found = [self.vocab.get(f"<0x{x:02X}>") for x in value.encode("utf-8")] if self.fallback else [None]
                if None not in found:
                    out += [(f, self.names[f], a, b) for f in found]
                    continue
            out.append((i, value, a, b))
        if len(word) < 256:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = out
        return out

    def forget(self) -> None:
        self.known.clear()


def log_sum_exp(x: float, y: float) -> float:
    if x == -math.inf:
        return y
    if y == -math.inf:
        return x
    low, high = min(x, y), max(x, y)
    return high if high > low + 50 else high + math.log1p(math.exp(low - high))


MODELS = {"WordLevel": WordLevel, "WordPiece": WordPiece, "BPE": Bpe, "Unigram": Unigram}


def model_type(config: dict) -> str:
    """The tag, or for untagged ones the kind that has these fields."""
    if "type" in config:
        return config["type"]
    if isinstance(config.get("vocab"), list):
        return "Unigram"
    if "merges" in config:
        return "BPE"
    return "WordPiece" if "continuing_subword_prefix" in config or "max_input_chars_per_word" in config else "WordLevel"


def build_model(config: dict | None):
    if config is None:
        raise ValueError("the configuration has no model")
    if factory := extension(config.get("type")):
        return factory(config)
    kind = model_type(config)
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}")
    if isinstance(config["vocab"], dict):
        config = config | {"vocab": {t: i for t, i in config["vocab"].items() if isinstance(i, int) and not isinstance(i, bool)}}
    return MODELS[kind](config)
