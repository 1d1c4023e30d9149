"""Normalizers, splits and decoders as Spark expressions, for the cases that built-in functions express exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.decoders import CLEANUP
from tokenloom.functions.unicode import GLYPHS, PUNCT, WORD, WS

GAP = r"(?:(?!{p})[\s\S])+"
#: Java regular expressions for the classes of the kernels; (?U) isn't used, for its \w differs.
JAVA_WS = f"[{WS}]"
JAVA_WORD = f"[{WORD}]"
GPT2_JAVA = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"


def quoted(literal: str) -> str:
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def find_all(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def split(text: Column, regex: str, behavior: str) -> Column:
    """The pieces of a text under a split behavior; regex matches the delimiters. Empty pieces are left out."""
    p = f"(?:{regex})"
    gap = GAP.format(p=p)
    whole = {
        "removed": gap,
        "isolated": f"{p}|{gap}",
        "contiguous": f"{p}+|{gap}",
        "mergedwithprevious": f"{gap}{p}?|{p}",
        "mergedwithnext": f"{p}?{gap}|{p}",
    }[behavior.replace("_", "").lower()]
    return find_all(text, whole)


def chained(pieces: Column, regex: str, behavior: str) -> Column:
    """A further split of every piece."""
    return F.flatten(F.transform(pieces, lambda x: split(x, regex, behavior)))


def whitespace(text: Column) -> Column:
    return find_all(text, rf"{JAVA_WORD}+|[^{WORD}{WS}]+")


def whitespace_split(text: Column) -> Column:
    return find_all(text, f"[^{WS}]+")


def punctuation(text: Column, behavior: str = "isolated") -> Column:
    return split(text, f"[{PUNCT}]", behavior)


def digits(text: Column, individual: bool = False) -> Column:
    return split(text, r"\p{N}", "isolated" if individual else "contiguous")


def bert_words(text: Column) -> Column:
    return chained(whitespace_split(text), f"[{PUNCT}]", "isolated")


def delimiter(text: Column, c: str) -> Column:
    return F.filter(F.split(text, quoted(c)), lambda x: x != "")


def fixed_length(text: Column, n: int = 5) -> Column:
    return find_all(text, f"(?s).{{1,{n}}}") if n > 0 else F.array().cast("array<string>")


def metaspace(text: Column, mark: str = "▁", prepend: bool = True) -> Column:
    t = F.replace(text, F.lit(" "), F.lit(mark))
    if prepend:
        t = F.when((F.length(t) > 0) & ~F.startswith(t, F.lit(mark)), F.concat(F.lit(mark), t)).otherwise(t)
    return split(t, quoted(mark), "mergedwithnext")


def gpt2_words(text: Column) -> Column:
    return find_all(text, GPT2_JAVA)


# -- bytes and glyphs

_ODD = [b for b in range(256) if GLYPHS[b] != chr(b)]


def to_glyphs(text: Column) -> Column:
    """Each UTF-8 byte as its glyph."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, _ODD)), "".join(GLYPHS[b] for b in _ODD))


def from_glyphs(glyphs: Column) -> Column:
    """The text of a run of glyphs; bytes that aren't UTF-8 become U+FFFD. NUL, which translate() would drop, is kept."""
    codes = {ord(GLYPHS[b]): b for b in range(256)}
    table = F.create_map(*[F.lit(x) for g, b in codes.items() if g >= 0x100 for x in (g, b)])
    points = F.transform(F.split(glyphs, ""), lambda c: F.ascii(c))
    hexes = F.transform(points, lambda p: F.lpad(F.hex(F.coalesce(table[p], p)), 2, "0"))
    return F.when(F.length(glyphs) > 0, F.make_valid_utf8(F.unhex(F.array_join(hexes, "")).cast("string"))).otherwise(F.lit(""))


#: Pieces whose offsets are summed up in one go; blocks of them are then moved to where they begin.
BLOCK = 64


def bound(x: Column, f) -> Column:
    """f of x, which is worked out once: an expression is copied to every place that uses it and worked out for each turn of a loop, a variable isn't."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(sizes: Column) -> Column:
    """Sums of a short array up to and with each entry."""
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))


def running_bytes(pieces: Column) -> Column:
    """(start, end) of each piece in bytes, of pieces that cover a text."""

    def moved(sums: Column) -> Column:
        last = F.transform(sums, lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))
        return F.flatten(F.zip_with(sums, bound(last, lambda t: F.zip_with(running(t), t, lambda end, n: end - n)), lambda s, begin: F.transform(s, lambda x: x + begin)))

    def placed(sizes: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sizes) / BLOCK).cast("int") - 1, F.lit(0)))
        sums = F.transform(firsts, lambda b: running(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
        return F.zip_with(bound(sums, moved), sizes, lambda end, n: F.struct((end - n).alias("start"), end.alias("end")))

    return bound(F.transform(pieces, F.octet_length), placed)


# -- normalizers


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    if left:
        text = F.regexp_replace(text, f"^{JAVA_WS}+", "")
    return F.regexp_replace(text, f"{JAVA_WS}+$", "") if right else text


def replace_all(text: Column, find: str, content: str, literal: bool = True) -> Column:
    return F.replace(text, F.lit(find), F.lit(content)) if literal else F.regexp_replace(text, find, content.replace("\\", "\\\\").replace("$", "\\$"))


def prepend(text: Column, what: str) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit(what), text)).otherwise(text)


def nmt(text: Column) -> Column:
    gone = F.regexp_replace(text, r"[\x01-\x08\x0B\x0E-\x1F\x7F\x8F\x9F]", "")
    return F.regexp_replace(gone, "[\\x09\\x0A\\x0C\\x0D\\x{1680}\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{2581}\\x{FEFF}\\x{FFFD}]", " ")


def bert_clean(text: Column) -> Column:
    gone = F.regexp_replace(text, "[\\x00\\x{FFFD}]|(?![\\t\\n\\r])[\\p{Cc}\\p{Cf}\\p{Cn}\\p{Co}&&[\\x{0}-\\x{FFFF}]]", "")
    return F.regexp_replace(gone, JAVA_WS, " ")


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{M}&&[\x{0}-\x{FFFF}]]", "")


# -- truncation, padding, decoders


def chunks(ids: Column, most: int, stride: int = 0) -> Column:
    """Parts of at most `most` items, each beginning stride items before the end of the one before it."""
    if stride >= most:
        raise ValueError("stride must be less than the maximal length")
    n = F.size(ids)
    last = F.greatest(n - stride - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(most - stride))
    return F.when(n > 0, F.transform(starts, lambda a: F.slice(ids, a + 1, F.lit(most)))).otherwise(F.array(ids))


def padded(ids: Column, to: Column, pad: Column, left: bool = False) -> Column:
    fill = F.array_repeat(pad, F.greatest(to - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def tidy(text: Column) -> Column:
    for a, b in CLEANUP:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def word_piece_decoded(tokens: Column, prefix: str = "##", clean: bool = True) -> Column:
    def one(t: Column, k: Column) -> Column:
        plain = F.when(k == 0, t).when(F.startswith(t, F.lit(prefix)), F.substring(t, len(prefix) + 1, 1 << 30)).otherwise(F.concat(F.lit(" "), t))
        return tidy(plain) if clean else plain

    return F.transform(tokens, one)


def bpe_decoded(tokens: Column, suffix: str = "</w>") -> Column:
    return F.transform(tokens, lambda t, k: F.replace(t, F.lit(suffix), F.when(k == F.size(tokens) - 1, "").otherwise(" ")))


def metaspace_decoded(tokens: Column, mark: str = "▁", never: bool = False) -> Column:
    return F.transform(tokens, lambda t, k: F.replace(t, F.lit(mark), F.when((k == 0) & F.lit(not never), "").otherwise(" ")))


def ctc_decoded(tokens: Column, pad: str = "<pad>", word: str = "|", clean: bool = True) -> Column:
    once = F.filter(tokens, lambda t, k: (k == 0) | (t != F.try_element_at(tokens, k)))
    out = F.transform(once, lambda t: F.replace(t, F.lit(pad), F.lit("")))
    if clean:
        out = F.transform(out, lambda t: F.replace(tidy(t), F.lit(word), F.lit(" ")))
    return F.filter(out, lambda t: t != "")


def strip_decoded(tokens: Column, c: str, start: int, stop: int) -> Column:
    q = quoted(c)
    return F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, f"^(?:{q}){{0,{start}}}", ""), f"(?:{q}){{0,{stop}}}$", ""))


# -- positions


def token_at(offsets: Column, position: Column) -> Column:
    """The place of the token that holds a position (null: none); offsets: an array of (start, end) in order."""
    inside = F.filter(F.sequence(F.lit(0), F.size(offsets) - 1), lambda k: (offsets[k]["start"] <= position) & (position < offsets[k]["end"]))
    return F.when(F.size(offsets) > 0, F.try_element_at(inside, F.lit(1)))


def tokens_of_word(words: Column, word: Column) -> Column:
    """(first, end) of the tokens of a word; null if it has none. words: each token's word."""
    first = F.array_position(words, word) - 1
    n = F.size(F.filter(words, lambda w: w == word))
    return F.when(n > 0, F.struct(first.cast("int").alias("first"), (first + n).cast("int").alias("end")))


def word_at(offsets: Column, words: Column, position: Column) -> Column:
    """The word of the token that holds a position."""
    return F.get(words, token_at(offsets, position))


def chars_of_word(offsets: Column, words: Column, word: Column) -> Column:
    """(start, end) from a word's first token to its last."""
    t = tokens_of_word(words, word)
    return F.when(t.isNotNull(), F.struct(offsets[t["first"]]["start"].alias("start"), offsets[t["end"] - 1]["end"].alias("end")))
