"""Personal data in texts: fixed patterns, and spans added by a semi-Markov conditional random field.

The field scores whole segments: a segment's features look at its full string (does it fill a pattern, digits, length,
checksum), at its borders and at the words before it. An encoding of a region of the text is a sequence of segments, each
an entity of one type or a single outside atom; its score is the sum of the segments' scores, and the dynamic programme
over atom borders finds the best encoding with entities of at most MOST_ATOMS atoms, boundaries and types together.
Entities hold a digit or an @, so regions are the places where a wide pattern finds such text; elsewhere all is outside.
Weights are fitted by the gradient of the conditional log-likelihood (forward and backward sums over all segmentations)
on sentences that synthetic() makes by rule, since the tables have no marked spans.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_texts

#: Kinds in order: the first four have base patterns, the others come from the field alone.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
#: The field's entities are bounded: at most MOST_ATOMS runs of letters and digits or single marks, and, if white space parts them, MOST_CHARS characters. A single run may be of any length.
MOST_ATOMS, MOST_CHARS = 16, 120

# Patterns of the contract; (?<![0-9]) changes no match, since a run of digits that fails from its start fails from within.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MARKED = re.compile(rb"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @: a local part cannot hold one, so the leftmost match starts where its run of characters does."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def part_ok(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(part_ok, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


#: Where an entity may be: an address, a run of digit groups, a long token with a digit, an account number. All are maximal runs of any length.
WIDE = (
    r"(?<![^\s@])[^\s@]+(?:@[^\s@]+)+", r"[+(]?[0-9][0-9().\x20-]{4,}[0-9]", r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*[0-9])[A-Za-z0-9_/-]{16,}",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{4}){2,}(?:\x20?[A-Za-z0-9]{1,3})?",
)
REGION = re.compile("|".join(WIDE))
_WIDE = [re.compile(x) for x in WIDE]
ATOM = re.compile(r"[A-Za-z0-9]+|\S")
CUES = {
    "token": "secret", "secret": "secret", "key": "secret", "api": "secret", "apikey": "secret", "password": "secret", "passwd": "secret", "auth": "secret", "bearer": "secret", "credential": "secret",
    "ssn": "ssn", "social": "ssn", "security": "ssn", "iban": "iban", "account": "iban", "konto": "iban", "phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone",
    "mail": "email", "email": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "mastercard": "card",
}
SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), "card": re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -]?[0-9]{1,3})?"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}"), "hex": re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}"), "mixed": re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_/-]{20,}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
}
WORD = re.compile(r"[a-z]+")


def segment_features(segment: str, before: str, after: str, cues: set[str]) -> list[str]:
    """Names of the features of a whole span, its neighbours and the cue words before it; types are joined to them later."""
    digits = len(digits_of(segment))
    out = ["bias", f"digits{min(20, digits)}", f"length{min(8, len(segment) // 5)}", f"first{_class(segment[0])}", f"last{_class(segment[-1])}", f"before{_class(before)}", f"after{_class(after)}"]
    for name, shape in SHAPES.items():
        if shape.fullmatch(segment):
            out.append(f"is_{name}")
            if name == "card":
                out.append(f"luhn{luhn(digits_of(segment))}")
            elif name == "ip":
                out.append(f"parts{all(map(part_ok, segment.split('.')))}")
    return out + [f"cue_{c}" for c in cues] + ["cues" if cues else "no_cue"]


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+(@.\"'=:-_/" else "other"


def regions(text: str) -> list[tuple[int, int]]:
    """The places of the wide patterns' matches, those that overlap joined, so that none cuts what another holds."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for x in _WIDE for m in x.finditer(text)):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def segments_of(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int, int, list[str]]]]:
    """Of one region: the number of atoms, and (first atom, atom after the last, start, end, features) of each segment that may be an entity."""
    atoms = [m.span() for m in ATOM.finditer(text, start, end)]
    return len(atoms), list(_segments(text, start, atoms))


def _segments(text: str, start: int, atoms: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """A region's segments, one at a time. A single atom may be of any length, more atoms together of MOST_CHARS or, if they are one token, of any too."""
    cues = {CUES[w] for w in WORD.findall(text[max(0, start - 32) : start].lower()) if w in CUES}
    for i, (a, _) in enumerate(atoms):
        if text[a] not in "+(" and not text[a].isalnum():
            continue
        spaced = False
        for j in range(i, min(len(atoms), i + MOST_ATOMS)):
            b = atoms[j][1]
            spaced = spaced or j > i and atoms[j - 1][1] < atoms[j][0]
            if b - a > MOST_CHARS and spaced:
                break
            if b - a >= 7 and text[b - 1].isalnum() and MARKED.search((segment := text[a:b]).encode()):
                yield i, j + 1, a, b, segment_features(segment, text[a - 1 : a], text[b : b + 1], cues)


class SemiMarkovField:
    """Weights by (kind, feature); outside atoms score 0."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = dict(weights)

    def score(self, kind: str, features: list[str]) -> float:
        get = self.weights.get
        return sum([get((kind, f), 0.0) for f in features])

    def decode(self, n: int, segments: Iterable) -> list[tuple[str, int, int]]:
        """The entities of the best encoding: (kind, start, end)."""
        by_end = defaultdict(list)
        for s in segments:
            kind, score = max(((k, self.score(k, s[4])) for k in KINDS), key=lambda x: x[1])
            if score > 0:  # else outside atoms are better
                by_end[s[1]].append((s[:4], kind, score))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for s, kind, score in by_end[j]:
                if best[s[0]] + score > best[j]:
                    best[j], back[j] = best[s[0]] + score, (s, kind)
        out, j = [], n
        while j:
            if back[j]:
                s, kind = back[j]
                out.append((kind, s[2], s[3]))
                j = s[0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, n: int, segments: list, gold: set[tuple[str, int, int]]) -> tuple[dict, float]:
        """Of the log-likelihood of the gold entities, and the log-likelihood."""
        scored = [(s, [(k, self.score(k, s[4])) for k in KINDS]) for s in segments]
        begins, ends = defaultdict(list), defaultdict(list)
        for x in scored:
            begins[x[0][0]].append(x)
            ends[x[0][1]].append(x)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1], *(ahead[s[0]] + v for s, ks in ends[j] for _, v in ks)])
        for i in range(n - 1, -1, -1):
            behind[i] = _log_sum([behind[i + 1], *(behind[s[1]] + v for s, ks in begins[i] for _, v in ks)])
        out: dict = defaultdict(float)
        like = -ahead[n]
        for s, ks in scored:
            for k, v in ks:
                p = math.exp(ahead[s[0]] + v + behind[s[1]] - ahead[n])
                right = (k, s[2], s[3]) in gold
                like += v * right
                if abs(right - p) > 1e-6:
                    for f in s[4]:
                        out[k, f] += right - p
        return out, like


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def synthetic(n: int, seed: int = 0) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with entities of every kind and with look-alikes (years, sums, versions, dates, order numbers)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    mixed = lambda k, of: "".join(r.choice(of) for _ in range(k))
    digit = lambda k: mixed(k, "0123456789")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def card() -> str:
        d = r.choice("3456") + digit(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def bad_card() -> str:
        d = digit(15)
        return d + next(c for c in "0123456789" if not luhn(d + c))

    make = {
        "email": lambda: f"{word()}{r.choice(['.', '_', ''])}{r.choice([word(), digit(2)])}@{word()}{r.choice(['', digit(1)])}.{r.choice(['example.com', 'org', 'co.uk'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"+{r.randint(1, 99)} {digit(3)} {digit(4)} {digit(3)}", f"{digit(3)}-{digit(3)}-{digit(4)}"]),
        "secret": lambda: r.choice([mixed(r.choice([32, 40, 64]), "0123456789abcdef"), mixed(r.randint(24, 60), upper + upper.lower() + "0123456789") + "aA1", "".join(r.choice("ABCDEFGHJKLMNPQRSTabcdefghijkmnpqrst23456789_") for _ in range(r.randint(24, 44))) + "A1a"]),
        "ssn": lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", "iban": lambda: r.choice(["DE", "FR", "ES", "IT", "NL", "GB", "CH"]) + digit(2) + r.choice(["", " "]).join(["", r.choice([digit(4), mixed(4, upper)]), *(digit(4) for _ in range(r.randint(2, 4))), *([] if r.random() < 0.4 else [digit(r.randint(1, 3))])]),
    }
    cue = {"email": ["mail", "contact:"], "ip": ["host", "from ip"], "card": ["card", "visa"], "phone": ["call", "phone:", "tel"], "secret": ["token =", "api_key:", "password ="], "ssn": ["ssn", "social security"], "iban": ["iban", "account"]}
    other = [lambda: f"{r.randint(1900, 2030)} {r.randint(1, 28)}.{r.randint(1, 12)}", lambda: f"{digit(3)}.{digit(3)}.{digit(2)}", lambda: f"v{r.randint(0, 9)}.{digit(2)}.{digit(1)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
             lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: " ".join(digit(r.randint(2, 4)) for _ in range(r.randint(3, 8))), lambda: f"{digit(2)}.{digit(6)} {digit(2)}.{digit(6)}",
             bad_card, lambda: digit(r.randint(7, 14)), lambda: f"{digit(4)}-{digit(4)}", lambda: f"{digit(5)} {digit(5)}", lambda: f"{r.randint(256, 999)}.{digit(3)}.{digit(3)}.{digit(3)}", lambda: f"{word()}-{word()}-{word()}-{digit(4)}", lambda: f"{word()}/{word()}/{word()}{digit(2)}"]
    out = []
    for k in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(0, 6))), []
        if text:
            text += " "
        if k % 2:
            kind = KINDS[k // 2 % len(KINDS)]
            if r.random() < 0.6 or kind in ("secret", "ssn") and r.random() < 0.9:
                text += r.choice(cue[kind]) + " "
            quote = r.choice(["", "", '"', "("]) if kind in ("secret", "email") else ""
            text += quote
            value = make[kind]()
            gold.append((kind, len(text), len(text) + len(value)))
            text += value + {"(": ")"}.get(quote, quote)
        else:
            text += r.choice(other)()
        out.append((text + r.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(0, 4))), gold))
    return out


def fit(n: int = 1200, epochs: int = 4, seed: int = 0) -> SemiMarkovField:
    """A field fitted to synthetic(n) by Adagrad, with a small pull of the weights to zero."""
    field, squares = SemiMarkovField({}), defaultdict(lambda: 1e-3)
    cases = []
    for text, gold in synthetic(n, seed):
        for m in REGION.finditer(text):
            size, segments = segments_of(text, *m.span())
            if segments:
                cases.append((size, segments, set(gold)))
    r = random.Random(seed)
    for _ in range(epochs):
        r.shuffle(cases)
        for size, segments, gold in cases:
            step, _ = field.gradient(size, segments, gold)
            for key, g in step.items():
                w = field.weights.get(key, 0.0)
                g -= 1e-4 * w
                squares[key] += g * g
                field.weights[key] = w + 0.3 * g / math.sqrt(squares[key])
    return field


def all_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans: the base ones and those of the field that overlap none of them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = list(accumulate([b for _, b in taken], max))  # how far the spans up to each reach
    added = []
    for start, end in regions(text):
        if (k := bisect_right(starts, start)) and ends[k - 1] >= end:
            continue  # within base spans, or one
        atoms = [m.span() for m in ATOM.finditer(text, start, end)]
        added += field.decode(len(atoms), _segments(text, start, atoms))
    added = [x for x in added if not (k := bisect_left(starts, x[2])) or ends[k - 1] <= x[1]]
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SemiMarkovField | None = None) -> DataFrame:
    """id_col and FIELDS for each row of df: counts of the base spans, their digest, and all spans.

    Null and empty texts have none; repeated rows give repeated results. The field's weights are broadcast (a few hundred).
    """
    shared = df.sparkSession.sparkContext.broadcast((field or fit()).weights)
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def make():
        own = SemiMarkovField(shared.value)

        def work(texts: list[bytes]):
            for t in texts:
                if not MARKED.search(t):
                    yield nothing
                    continue
                base, spans = all_spans(t.decode(), own)
                yield *(sum([x[0] == k for x in base]) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return work

    return map_texts(df, id_col, text_col, make, FIELDS)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])
