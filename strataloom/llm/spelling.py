"""Spelling variants: each word's near words, by forward and backward minimal acyclic automata.

Of two words one edit apart, the first half of one is a prefix of the other, or its second half a suffix. So a word is looked up twice: its
first half exactly in an automaton of the words, then the rest with one error; its reversed second half exactly in an automaton of the
reversed words, then the rest with one error. What the second search finds with the whole first half as prefix the first has found too,
and goes. States count the words that end below them, so a path adds up to its word's number in code-point order, at which the words and
their counts stand in arrays.

A forward automaton holds the words that share their first three code points, a backward one those that share their last three: both
halves have three at least. Words of a shard of over SHARD are dealt anew by the length and the whole half of the word looked up
(a word stands in the shards of the three lengths it can be near), and what is still larger is cut, its words once, its lookups in each part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, join_few

#: Fixed by the task: a run's code points, the least size and count of a word, the run's share that loses a code point, the factor of a form.
RUN = "[A-Za-zÀ-ÿ]{6,}"
LEAST_SIZE, LEAST_COUNT, ODD, FACTOR = 6, 5, 199, 5
#: Words of one automaton at most, and of the shards that one task works on together.
SHARD, UNIT = 32_768, 16_384
SHARED = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words. arcs[s][c] is (next state, words before those by c); a path's numbers add up to its word's place."""

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self.register: dict[tuple, int] = {}
        pending: list[tuple[bool, list]] = [(False, [])]
        last = ""
        for w in words:
            k = 0
            while k < len(last) and k < len(w) and last[k] == w[k]:
                k += 1
            self._close(pending, last, k)
            pending += [(False, []) for _ in w[k:]]
            pending[-1] = True, pending[-1][1]
            last = w
        self._close(pending, last, 0)
        self.start = self._state(*pending[0])
        del self.register

    def _close(self, pending: list, word: str, depth: int) -> None:
        """States below depth are done: equal ones become one."""
        while len(pending) > depth + 1:
            state = self._state(*pending.pop())
            pending[-1][1].append((word[len(pending) - 1], state))

    def _state(self, final: bool, arcs: list) -> int:
        key = final, *arcs
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            before, own = int(final), {}
            for c, to in arcs:
                own[c] = to, before
                before += self.count[to]
            self.arcs.append(own)
            self.final.append(final)
            self.count.append(before)
        return state

    def follow(self, state: int, number: int, text: str) -> tuple[int, int] | None:
        for c in text:
            to = self.arcs[state].get(c)
            if to is None:
                return None
            state, number = to[0], number + to[1]
        return state, number

    def near(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that are half exactly, then rest with one code point inserted, deleted or replaced."""
        found: set[int] = set()
        at = self.follow(self.start, 0, half)
        arcs, final, follow = self.arcs, self.final, self.follow

        def ends(state: int, number: int, text: str) -> None:
            got = follow(state, number, text)
            if got is not None and final[got[0]]:
                found.add(got[1])

        for k in range(len(rest) + 1):
            if at is None:
                break
            state, number = at
            here = rest[k : k + 1]
            after, tail = rest[k + 1 :], rest[k:]
            if here:
                ends(state, number, after)
            for c, (to, add) in arcs[state].items():
                if c != here:  # an insertion of the next code point is the same as one after it
                    if here:
                        ends(to, number + add, after)
                    ends(to, number + add, tail)
            at = follow(state, number, here) if here else None
        return found


def words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: what the runs of letters in all texts become, LEAST_SIZE code points or more, found LEAST_COUNT times or more.

    A run is lower-cased (A-Z only). Where 199 divides the crc32 of "<id>:<run>", its code point at crc32 mod length goes. A null text has no
    words, a null id counts as the empty one, a repeated row counts again. Shorter runs can't become words and aren't read.
    """
    word, doc, h = free_names(documents, "_word", "_doc", "_h")
    runs = documents.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(doc), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias(word))
    runs = runs.withColumn(word, F.translate(word, UPPER, LOWER))
    runs = runs.withColumn(h, F.crc32(F.concat_ws(":", doc, word).cast("binary")))
    size = F.char_length(word)
    at = (F.col(h) % size).cast("int")
    cut = F.concat(F.substring(F.col(word), F.lit(1), at), F.substring(F.col(word), at + 2, size))
    result = F.when(F.col(h) % ODD == 0, cut).otherwise(F.col(word))
    return runs.select(result.alias("word")).where(F.char_length("word") >= LEAST_SIZE).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def half_of(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def shards(vocabulary: DataFrame, backward: bool, shard: int = SHARD) -> DataFrame:
    """key, part, word, n, held (the word is in the shard's automaton) and asked (it is looked up there), words reversed if backward."""
    own = vocabulary.withColumn("word", F.reverse("word")) if backward else vocabulary
    own = own.withColumn("key", F.substring("word", 1, SHARED))
    counts = own.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > shard)
    marked = join_few(own, counts, "key")
    plain = marked.where("_n IS NULL").select("key", F.lit(0).alias("part"), "word", "n", F.lit(True).alias("held"), F.lit(True).alias("asked"))
    size = F.char_length("word")
    wide = marked.where("_n IS NOT NULL").select("word", "n", F.explode(F.sequence(size - 1, size + 1)).alias("asks"))
    exact = F.col("asks") - half_of(F.col("asks")) if backward else half_of(F.col("asks"))
    wide = wide.withColumn("key", F.concat_ws(":", "asks", F.substring(F.col("word"), F.lit(1), exact))).withColumn("asked", F.col("asks") == size)
    parts = wide.groupBy("key").agg(F.ceil(F.count("*") / shard).cast("int").alias("_parts"))
    wide = wide.join(parts.where("_parts > 1"), "key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))  # a key has what shares half its code points
    home = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    everywhere = F.when(F.col("asked"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(home))
    wide = wide.withColumn("part", F.explode(everywhere)).select("key", "part", "word", "n", (F.col("part") == home).alias("held"), "asked")
    return plain.unionByName(wide)


def _lookups(shard: list[tuple[str, int, bool, bool]], backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """(word, its near words, the greatest count of one, the first such one) of the words looked up that have any, from a shard's (word, n, held, asked)."""
    held = sorted((w, n) for w, n, has, _ in shard if has)
    names, counts = [w for w, _ in held], [n for _, n in held]
    automaton = Automaton(names)
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    for w, _, _, asks in shard:
        if not asks:
            continue
        half = len(w) - len(w) // 2 if backward else len(w) // 2
        found = automaton.near(w[:half], w[half:])
        if backward:
            start = w[half:][::-1]
            found = {k for k in found if not names[k][::-1].startswith(start)}
        if found:
            top = max(counts[k] for k in found)
            yield turn(w), len(found), top, min(turn(names[k]) for k in found if counts[k] == top)


def near_words(vocabulary: DataFrame, backward: bool, n_words: int, shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """word, n_near, top (the greatest count of a near word) and form (the first near word with it): what one direction finds first, a row for each automaton that finds any."""
    dealt = shards(vocabulary, backward, shard).withColumn("unit", F.pmod(F.xxhash64("key", "part"), F.lit(max(1, -(-n_words // unit)))).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        by: dict[tuple, list] = {}
        for key, part, *row in zip(*(t.column(c).to_pylist() for c in ("key", "part", "word", "n", "held", "asked")), strict=True):
            by.setdefault((key, part), []).append(tuple(row))
        rows = [r for s in by.values() for r in _lookups(s, backward)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "top", "form"])

    return dealt.groupBy("unit").applyInArrow(run, "word string, n_near long, top long, form string")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root of each word with a form, by pointer doubling. A form has FACTOR times its word's count at least, so a chain from
    LEAST_COUNT to most is short, and the rounds are known beforehand."""
    longest = 1
    while LEAST_COUNT * FACTOR ** (longest + 1) <= most:
        longest += 1
    now = forms.select("word", F.col("form").alias("root"))
    reached = 1
    while reached < longest:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = checkpointed(join_few(now, then, "root").select("word", F.coalesce("_next", "root").alias("root")))
        reached *= 2
    return now


def group_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, unit: int = UNIT) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of the texts (see words).

    Near words are one inserted, deleted or replaced code point apart. The form is the near word of the greatest n (of equal ones the first in
    code-point order) if that is FACTOR times the word's n at least, else null; the root is where following forms ends. Empty tables, and
    texts without words, give no row. Other columns are left out. Sharding (shard, unit) doesn't change the result.
    """
    vocabulary = checkpointed(words(documents, id_col, text_col))
    facts = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    none = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("top"), F.lit(None).cast("string").alias("form"))
    found = [near_words(vocabulary, b, facts.n, shard, unit).withColumn("n", F.lit(None).cast("long")) for b in (False, True)]
    every = none.unionByName(found[0]).unionByName(found[1])
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("top")).alias("top"), "form")))
    near = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("_best"))
    chosen = (-F.col("_best.top")) >= FACTOR * F.col("n")
    near = checkpointed(near.select("word", "n", "n_near", F.when(chosen, F.col("_best.form")).alias("form"), F.when(chosen, -F.col("_best.top")).alias("form_n")))
    ends = roots(near.where("form IS NOT NULL"), facts.most)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
