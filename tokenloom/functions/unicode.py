"""Character classes and the byte alphabet shared by kernels and column builders."""

from __future__ import annotations

import functools

import regex

#: White space as Unicode defines it; Python's own class has four control characters more.
WS = r"\t-\r \x85\xa0  -     　"
WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}‌‍"
PUNCT = r"!-/:-@\[-`{-~\p{P}"
SPACES = frozenset(chr(c) for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1))
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


GLYPHS = byte_alphabet()
BYTE_OF = {g: b for b, g in enumerate(GLYPHS)}


@functools.lru_cache(256)
def pattern(source: str) -> regex.Pattern:
    """A regular expression whose white-space and word classes are those of Unicode, spelled out."""
    out, inside, k = [], False, 0
    while k < len(source):
        c = source[k]
        if c == "\\" and k + 1 < len(source):
            n = source[k + 1]
            out.append({"s": WS if inside else f"[{WS}]", "S": source[k : k + 2] if inside else f"[^{WS}]", "w": WORD if inside else f"[{WORD}]", "W": source[k : k + 2] if inside else f"[^{WORD}]"}.get(n, source[k : k + 2]))
            k += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        k += 1
    return regex.compile("".join(out))


#: Scripts that text is split by; other characters count as common.
SCRIPTS = (
    "Adlam Ahom AnatolianHieroglyphs Arabic Armenian Avestan Balinese Bamum BassaVah Batak Bengali Bhaiksuki Bopomofo "
    "Brahmi Braille Buginese Buhid CanadianAboriginal Carian CaucasianAlbanian Chakma Cham Cherokee Coptic Cuneiform "
    "Cypriot Cyrillic Deseret Devanagari Duployan EgyptianHieroglyphs Elbasan Ethiopic Georgian Glagolitic Gothic Grantha "
    "Greek Gujarati Gurmukhi Han Hangul Hanunoo Hatran Hebrew Hiragana ImperialAramaic Inherited InscriptionalPahlavi "
    "InscriptionalParthian Javanese Kaithi Kannada Katakana KayahLi Kharoshthi Khmer Khojki Khudawadi Lao Latin Lepcha "
    "Limbu LinearA LinearB Lisu Lycian Lydian Mahajani Malayalam Mandaic Manichaean Marchen MeeteiMayek MendeKikakui "
    "MeroiticCursive MeroiticHieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean NewTaiLue Newa Nko Ogham OlChiki "
    "OldHungarian OldItalic OldNorthArabian OldPermic OldPersian OldSouthArabian OldTurkic Oriya Osage Osmanya PahawhHmong "
    "Palmyrene PauCinHau PhagsPa Phoenician PsalterPahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham "
    "SignWriting Sinhala SoraSompeng Sundanese SylotiNagri Syriac Tagalog Tagbanwa TaiLe TaiTham TaiViet Takri Tamil Tangut "
    "Telugu Thaana Thai Tibetan Tifinagh Tirhuta Ugaritic Vai WarangCiti Yi"
).split()
_SCRIPT = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]


@functools.lru_cache(65536)
def script(c: str) -> str:
    """Any for the space; Japanese syllabaries and the prolonged sound mark count as Han."""
    if c == " ":
        return "Any"
    if c == "ー":
        return "Han"
    found = next((s for s, p in _SCRIPT if p.match(c)), "Common")
    return "Han" if found in ("Hiragana", "Katakana") else found
