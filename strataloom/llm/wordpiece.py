"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's initial and continuation pieces form two tries that share the automaton. Each node has a failure link,
to where matching goes on once the longest pieces that its string begins with are popped, and the number of pieces
popped on the way; a node whose string can't be popped has none. A word is then read once, symbol by symbol: where
no arc leaves, the link is followed and its count added. No piece is built and no text is read again.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame

from .bpe import byte_symbols
from .common import map_texts, once

CACHE_WORDS = 200_000
#: Longer words are counted like others, but not kept in the cache.
CACHED_BYTES = 400


class PieceAutomaton:
    """The automaton of pieces that begin a word and pieces that continue one, all of them byte strings."""

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        self.arcs: dict[int, int] = {}  # node << 8 | byte -> node
        self.link: list[int] = []
        self.popped: list[int] = []
        ends: list[bool] = []
        parent: list[tuple[int, int]] = []

        def node() -> int:
            self.link.append(-1)
            self.popped.append(0)
            ends.append(False)
            parent.append((-1, 0))
            return len(ends) - 1

        self.first, self.rest = node(), node()
        for root, pieces in ((self.first, initial), (self.rest, continuing)):
            for piece in pieces:
                at = root
                for b in piece:
                    if (to := self.arcs.get(at << 8 | b)) is None:
                        to = self.arcs[at << 8 | b] = node()
                        parent[to] = at, b
                    at = to
                ends[at] = ends[at] or bool(piece)
        if b"" in initial:  # a piece of nothing but what stands before the word
            self.link[self.first], self.popped[self.first] = self.rest, 1
        below: dict[int, list[int]] = {}
        for k, (p, _) in enumerate(parent):
            if p >= 0:
                below.setdefault(p, []).append(k)
        todo = deque(below.get(self.first, []) + below.get(self.rest, []))
        while todo:
            v = todo.popleft()
            todo += below.get(v, [])
            if ends[v]:
                self.link[v], self.popped[v] = self.rest, 1
                continue
            p, b = parent[v]
            at, n = self.link[p], self.popped[p]
            while at >= 0 and (at << 8 | b) not in self.arcs:
                n += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.popped[v] = self.arcs[at << 8 | b], n

    def count(self, word: bytes) -> int:
        """Pieces of a greedy longest-match split of the word; 0 if it has none (an unknown word)."""
        arcs, link, popped = self.arcs, self.link, self.popped
        at, n = self.first, 0
        for b in word:
            while (to := arcs.get(at << 8 | b)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 0
            at = to
        while at != self.rest:
            n += popped[at]
            at = link[at]
            if at < 0:
                return 0
        return n


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def compile_vocabulary(path: str) -> PieceAutomaton:
    """The automaton of a byte-level vocabulary: entries that begin with the space's symbol begin words, others go on with them.

    The bare space is a piece too, so a word has a split even where no entry joins the space to its first byte.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_symbols())}
    added = {a["content"] for a in spec["added_tokens"]}
    pieces = {bytes(byte[c] for c in x) for x in spec["model"]["vocab"] if x not in added and all(c in byte for c in x)}
    return PieceAutomaton({p[1:] for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "})


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col, n_words, n_pieces and n_unknown for each row of df.

    Words stand between white space. A word that has no split is unknown and counts as one piece.
    Null and empty texts have none of either; words and texts of any length are read whole. Repeated rows give repeated results, an empty table
    none, and other columns are left out. The automaton is broadcast; its size is that of the vocabulary.
    """
    shared = df.sparkSession.sparkContext.broadcast(compile_vocabulary(path or default_vocabulary()))

    def make():
        automaton = shared.value
        cache: dict[bytes, int] = once("wordpiece", automaton, lambda _: {})

        def work(texts: list[bytes]):
            for t in texts:
                words = t.split()
                pieces = unknown = 0
                for w in words:
                    n = cache.get(w)
                    if n is None:
                        n = automaton.count(w)
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        if len(w) <= CACHED_BYTES:
                            cache[w] = n
                    if n:
                        pieces += n
                    else:
                        unknown += 1
                yield len(words), pieces + unknown, unknown

        return work

    return map_texts(df, id_col, text_col, make, "n_words long, n_pieces long, n_unknown long")
