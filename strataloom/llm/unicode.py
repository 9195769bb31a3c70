"""Unicode as the tokenizers' library has it: classes of Unicode 16, lower case of 17, normalisation of 10.

Python's own tables are of another version, which differs from worker to worker. What follows states the differences for
Python's Unicode 15 to 17, so that results are the library's and the same on every worker.
"""

from __future__ import annotations

import re
import unicodedata

# Fixed values, in hexadecimal: what Unicode assigned after 15.0.
#: Letters and numbers that the library knows and an older Python doesn't.
LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0 2EBF0-2EE5D"
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Letters and numbers of later versions, which are neither to the library.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals whose lower case an older Python doesn't know: a range of capitals, and the first of their small letters.
CAPITALS = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"
#: Marks and parts of compositions of Unicode 11 and later: the library's normalisation neither moves nor composes them.
UNMOVED = (
    "7FD 897-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1AE0-1AEB 1DF6-1DFA A82C 10D24-10D27 10D69-10D6D 10EAB-10EAC 10EFA-10EFF 10F46-10F50 10F82-10F85 11070 1133B 11382-113CE 113CF-113D0 113E1-113E2 1145E 11839-1183A 11930 11935 11938 1193D-1193E 11943 "
    "119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 105D2 105DA 1611E-1612F 16D63-16D6A 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF 1E5EE-1E5EF 1E6E3 1E6E6 1E6EE-1E6EF 1E6F5"
)


def ranges(text: str) -> list[tuple[int, int]]:
    return [(int(x.split("-")[0], 16), int(x.split("-")[-1], 16)) for x in text.split()]


def _in_class(spans: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def char_class(kind: str) -> str:
    """What stands in a regular expression's brackets for the library's letters (L) or numbers (N)."""
    more = {c for a, b in ranges(LETTERS if kind == "L" else NUMBERS) for c in range(a, b + 1)}
    less = {c for a, b in ranges(LATER) for c in range(a, b + 1)}
    spans: list[list[int]] = []
    for c in range(0x110000):
        if (c in more or unicodedata.category(chr(c))[0] == kind) and c not in less:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return _in_class([tuple(x) for x in spans])


_UNMOVED = re.compile(f"([{_in_class(ranges(UNMOVED))}])")
_UNMOVED_CHARS = frozenset(chr(c) for a, b in ranges(UNMOVED) for c in range(a, b + 1))
_SMALL = {c: int(x.split(":")[1], 16) + c - a for x in CAPITALS.split() for a, b in ranges(x.split(":")[0]) for c in range(a, b + 1)} | {ord("\u03a3"): ord("\u03c3")}
_CAPITALS = frozenset(map(chr, _SMALL))


def nfc(text: str) -> str:
    """Normal form C, in which UNMOVED characters stand for themselves."""
    if _UNMOVED_CHARS.isdisjoint(set(text)):
        return unicodedata.normalize("NFC", text)
    return "".join([x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(_UNMOVED.split(text))])


def lower(text: str) -> str:
    """Lower case of each character by itself: a capital sigma has no form of its own at a word's end."""
    if not _CAPITALS.isdisjoint(set(text)):
        text = text.translate(_SMALL)
    return text.lower()
