"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order of priority, into a deterministic automaton whose arcs are labelled with tokens
and whose only accepted token sequence for a word is that word's BPE encoding. It begins as one state with a loop
for every base symbol. The gadget of a merge (u, v -> w) is:

* the state that u-arcs lead to is copied without its v-arc, and all u-arcs are led to the copy, and
* wherever a u-arc leaves, a w-arc leaves too, to where v-arcs led.

All arcs of one label lead to one state, and a state never loses an arc (only its copy lacks it). So a state is kept
as (state it was copied from, label taken away, number of the merge), and the automaton takes space in proportion to
the merges. The transition table is filled in as words need it; a word is encoded by following, from each position
reached, the arcs that spell what comes next. Since the automaton is deterministic and has one path for a word, each
position is reached by at most one arc, and the path is read back from the end as soon as that is reached. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame

from .common import map_texts, once
from .unicode import char_class, lower, nfc

#: Words, and chunks between white space, kept with their encodings in one Python worker; twice that for a while.
CACHE_WORDS, CACHE_CHUNKS = 150_000, 100_000
#: White_Space of Unicode: what the tokenizer's pattern \s means.
BLANK = "\t-\r \x85\xa0  -     　"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class BpeAutomaton:
    """The automaton of a list of merges over base symbols 0-511: a byte, or 256 + the byte that ends a word.

    vocab and merges are those of a byte-level BPE with a word-end suffix. A merge that can never apply, since its
    parts never meet in an encoding, adds nothing.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, added: dict[str, int]):
        symbols = byte_symbols()
        base = [*symbols, *(c + suffix for c in symbols)]
        self.labels: list[str] = base.copy()
        number = {s: k for k, s in enumerate(base)}
        n = len(base)
        left: list[int] = [-1] * n
        born: list[int] = [-1] * n  # the merge that made the token
        spelled: list[tuple[int, ...]] = [(k,) for k in range(n)]
        leads: list[int] = [0] * n  # the state that arcs with this label lead to
        self.copied, self.lacks, self.made = [-1], [-1], [-1]
        self.left, self.born, self.leads = left, born, leads
        for k, (a, b) in enumerate(merges):
            u, v = number.get(a), number.get(b)
            if u is None or v is None or a + b in number:
                continue
            at, to = leads[u], leads[v]
            if not self._allows(at, v):
                continue
            self.copied.append(at)
            self.lacks.append(v)
            self.made.append(k)
            leads[u] = len(self.copied) - 1
            number[a + b] = len(left)
            self.labels.append(a + b)
            left.append(u)
            born.append(k)
            spelled.append(spelled[u] + spelled[v])
            leads.append(to)
        self.ids = [vocab[x] for x in self.labels]
        self.added = dict(added)
        self.trie: list[dict[int, int]] = [{}]  # node -> symbol -> node
        self.ends: list[int] = [-1]  # node -> token
        for t, parts in enumerate(spelled):
            node = 0
            for s in parts:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.ends)
                    self.trie.append({})
                    self.ends.append(-1)
                node = self.trie[node][s]
            self.ends[node] = t
        self.table: dict[int, bool] = {}

    def _allows(self, state: int, token: int) -> bool:
        """Has the state an arc with this label? Goes back through copies and merges, whichever is the younger."""
        made, born, copied, lacks, left = self.made, self.born, self.copied, self.lacks, self.left
        while state:
            if born[token] >= made[state]:
                token = left[token]
            elif lacks[state] == token:
                return False
            else:
                state = copied[state]
        return True

    def encode(self, word: bytes) -> list[int]:
        """The tokens (numbers of labels) of one pre-split word, which has at least a byte."""
        symbols = [*word[:-1], word[-1] + 256]
        n = len(symbols)
        arc = [-1] * (n + 1)
        size = [0] * (n + 1)
        trie, ends, table, leads = self.trie, self.ends, self.table, self.leads
        for i in range(n):
            if i and arc[i] < 0:
                continue
            state = leads[arc[i]] if i else 0
            node, j = 0, i
            while j < n:
                at = trie[node]
                if symbols[j] not in at:
                    break
                node = at[symbols[j]]
                j += 1
                token = ends[node]
                if token >= 0 and arc[j] < 0:
                    key = state << 20 | token
                    allowed = table.get(key)
                    if allowed is None:
                        if len(table) > 1_000_000:
                            table.clear()
                        allowed = table[key] = self._allows(state, token)
                    if allowed:
                        arc[j], size[j] = token, j - i
            if arc[n] >= 0:  # no other arc can end here
                break
        out, i = [], n
        while i:
            out.append(arc[i])
            i -= size[i]
        return out[::-1]


def compile_tokenizer(path: str) -> BpeAutomaton:
    """The automaton of a tokenizer file (JSON of the tokenizers library) with a byte-level BPE and a word-end suffix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BpeAutomaton(model["vocab"], merges, model["end_of_word_suffix"], {a["content"]: a["id"] for a in spec["added_tokens"]})


def word_pattern() -> re.Pattern:
    """The pre-tokenizer's pattern, with the tokenizer's classes of letters and numbers."""
    letters, numbers = char_class("L"), char_class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{BLANK}{letters}{numbers}]+")


class Recent:
    """make's results for the keys used lately: a full generation becomes the old one, from which what is used moves on."""

    def __init__(self, make, most: int):
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def __call__(self, key):
        if (got := self.new.get(key)) is None:
            if (got := self.old.get(key)) is None:
                got = self.make(key)
            if len(key) <= 200:
                if len(self.new) >= self.most:
                    self.old, self.new = self.new, {}
                self.new[key] = got
        return got


class Encoder:
    """Whole texts to ids and back, with a cache of what stands between white space."""

    def __init__(self, automaton: BpeAutomaton):
        self.a = automaton
        self.words = word_pattern()
        self.added = re.compile("(" + "|".join(map(re.escape, automaton.added)) + ")") if automaton.added else None
        self.ids = list(map(str, automaton.ids))
        self.word = Recent(self._word, CACHE_WORDS)
        self.chunk = Recent(self._chunk, CACHE_CHUNKS)

    def _word(self, word: str) -> tuple[str, str, int]:
        tokens = self.a.encode(word.encode())
        return " ".join([self.ids[t] for t in tokens]), " ".join([self.a.labels[t] for t in tokens]), len(tokens)

    def _chunk(self, text: str) -> tuple[str, str, int]:
        """ids joined by spaces, decoded text and number of tokens of a lower-cased text without white space."""
        words = self.words.findall(text)
        return self.word(words[0]) if len(words) == 1 else join(list(map(self.word, words)))

    def _plain(self, text: str) -> list[tuple[str, str, int]]:
        text = text.lower() if text.isascii() else lower(nfc(text))
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # split() takes these for white space
        chunks = [x for x in re.split(f"[{BLANK}]+", text) if x] if odd else text.split()
        known, chunk = self.chunk.new.get, self.chunk
        return [known(x) or chunk(x) for x in chunks]

    def encode(self, text: str) -> tuple[str, str, int]:
        """ids joined by one space, decoded text, number of tokens."""
        out: list[tuple[str, str, int]] = []
        if self.added and "<|" in text:
            for part in self.added.split(text):
                if part in self.a.added:
                    out.append((str(self.a.added[part]), part, 1))
                else:
                    out += self._plain(part)
        else:
            out += self._plain(text)
        return join(out)


def join(parts: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    return " ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]), sum([x[2] for x in parts])


def decode(automaton: BpeAutomaton, ids: list[int]) -> str:
    """The labels of the arcs with these ids, joined by a space as a tokenizer without a decoder does."""
    names = dict(zip(automaton.ids, automaton.labels, strict=True)) | {i: x for x, i in automaton.added.items()}
    return " ".join(names[i] for i in ids)


def encoder_of(shared) -> Encoder:
    """The worker's one Encoder for a broadcast automaton: its cache outlasts a task."""
    return once("bpe", shared.value, Encoder)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Columns id_col, n_tokens, ids (decimal, joined by one space) and decoded, for each row of df.

    Null and empty texts have no tokens; repeated rows give repeated results; other columns of df are left out.
    The compiled automaton is broadcast: its size is that of the vocabulary, whatever the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(compile_tokenizer(path or default_tokenizer()))

    def make():
        encode = encoder_of(shared).encode

        def work(texts: list[bytes]):
            for t in texts:
                ids, text, n = encode(t.decode())
                yield n, ids, text

        return work

    return map_texts(df, id_col, text_col, make, "n_tokens long, ids string, decoded string")


def digest_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """encode_documents with SHA-256 digests, made in the worker, in place of ids and decoded."""
    shared = df.sparkSession.sparkContext.broadcast(compile_tokenizer(path or default_tokenizer()))

    def make():
        encode = encoder_of(shared).encode

        def work(texts: list[bytes]):
            for t in texts:
                ids, text, n = encode(t.decode())
                yield n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

        return work

    return map_texts(df, id_col, text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
