"""Language-model scores of texts: a log-bilinear model trained by noise-contrastive estimation.

A token's probability is that of its class after the class of the token before it, times its share of the class. The
WORD_CLASSES most frequent words, with the end of a text, are classes of their own; all other words, known or not,
fall into SUFFIX_CLASSES classes by a hash of their last three bytes. Class probabilities are log-bilinear: the
context word's vector r, projected, predicts a vector whose product with the next class's vector q, plus a bias, is its
score. They are trained by noise-contrastive estimation on the class-pair counts of all training texts: with the noise
known exactly, the expectation over noise samples is a matrix product too. Scoring normalises exactly: the table of all
classes' log-probabilities after all contexts is one batched matrix product and a log-sum-exp, made once in a worker.

Within a suffix class a word has the share (c + 0.1) / (sum of c + 0.1 of its known words + 0.1), the last 0.1 being
what an unknown word gets, so that the probabilities of a class, and of all tokens, sum to one.

Counts of words are over the whole corpus and not bounded. The most frequent words of all rows, held-out ones too, FREQUENT at
most, are broadcast with their training counts (which may be 0). The others' counts are joined by word, once for each row that has it, and
none of them can be hot: each makes up less than one token in FREQUENT.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, once, small_batches

WORD_CLASSES, SUFFIX_CLASSES = 1024, 512
FREQUENT = 100_000
SMOOTH, FOLDS = 0.1, 10
DIMENSIONS, NOISE, STEPS, RATE = 32, 10, 120, 0.05
#: Different words counted in a worker before the counts are handed on.
COUNTED = 250_000


def is_held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIX_CLASSES


def word_counts(rows: DataFrame) -> DataFrame:
    """word (bytes; the end of a text is the empty word), c (in training rows) and a (in all rows). rows: held_out and text."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            trained = [n - held.get(w, 0) for w, n in every.items()] if held else list(every.values())
            out = pa.RecordBatch.from_arrays([pa.array(list(every), pa.binary()), pa.array(trained, pa.int64()), pa.array(list(every.values()), pa.int64())], names=["word", "c", "a"])
            every.clear()
            held.clear()
            return out

        for batch in batches:
            for out, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = [*(t or b"").lower().split(), b""]
                every.update(words)
                if out:
                    held.update(words)
                if len(every) > COUNTED:
                    yield flush()
        yield flush()

    return rows.select("held_out", "text").mapInArrow(run, "word binary, c long, a long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def frequency_bound(counts: DataFrame, most: int) -> int:
    """The least a such that no more than `most` words are that frequent: from the words' numbers by size, in buckets of a few hundred."""
    bucket = F.floor(F.log2(F.col("a").cast("double")) * 8).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("a").alias("a")).orderBy(F.desc("b")).collect()
    total, least = 0, 1 << 62
    for r in sizes:
        total += r.n
        if total > most:
            break
        least = r.a
    return least


class Vocabulary(dict):
    """word -> class, for words with a class of their own; others by suffix."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: k for k, w in enumerate(words)})
        self.own = len(words)
        self.classes = self.own + SUFFIX_CLASSES

    def __missing__(self, word: bytes) -> int:
        return self.own + suffix_class(word)


def class_pairs(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """pair (context * classes + class) and n; the context of a text's first token is the end of a text."""
    n = vocabulary.classes
    shared = texts.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(shared.value)
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            codes: list[int] = [own[b""]]
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                codes += [own[w] for w in (t or b"").lower().split()]
                codes.append(own[b""])
            c = np.array(codes, np.int64)
            pairs, counts = np.unique(c[:-1] * n + c[1:], return_counts=True)
            total[pairs] += counts
        pairs = np.flatnonzero(total)
        for k in range(0, len(pairs), 100_000):
            part = pairs[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Class probabilities after a class: context vectors r, a projection to predictions, class vectors q and biases."""

    def __init__(self, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.r = rng.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
        self.c = np.eye(DIMENSIONS, dtype=np.float32)
        self.q = rng.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
        self.b = np.zeros(classes, np.float32)

    def fit(self, pairs: np.ndarray) -> None:
        """Noise-contrastive estimation on a matrix of pair counts, with NOISE samples of the class distribution for each."""
        total = pairs.sum()
        contexts, unigram = pairs.sum(1), pairs.sum(0) + SMOOTH
        noise = (unigram / unigram.sum()).astype(np.float32)
        self.b = np.log(noise)
        if not total:
            return
        data = (pairs / total).astype(np.float32)
        fake = (contexts / total).astype(np.float32)[:, None] * (NOISE * noise)
        odds = np.log(NOISE * noise)
        moments = {}
        for step in range(1, STEPS + 1):
            predicted = self.r @ self.c
            real = 1 / (1 + np.exp(np.clip(odds - (predicted @ self.q.T + self.b), -60, 60)))  # that a pair is no noise
            d = data * (1 - real) - fake * real
            dp = d @ self.q
            for name, g in (("q", d.T @ predicted), ("b", d.sum(0)), ("r", dp @ self.c.T), ("c", self.r.T @ dp)):
                m, v = moments.get(name, (0, 0))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                moments[name] = m, v
                getattr(self, name)[...] += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)

    def log10_table(self) -> np.ndarray:
        """log10 of each class's probability after each class, by blocks of contexts."""
        out = np.empty((len(self.b),) * 2, np.float32)
        for k in range(0, len(out), 256):
            s = (self.r[k : k + 256] @ self.c) @ self.q.T + self.b
            s -= s.max(1, keepdims=True)
            out[k : k + 256] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out


class Model:
    """What scoring needs besides the rarer words' counts."""

    def __init__(self, vocabulary: list[bytes], net: LogBilinear, frequent: dict[bytes, int], shares: np.ndarray, tokens: int, known: int):
        self.vocabulary, self.net, self.frequent, self.shares, self.tokens, self.known = vocabulary, net, frequent, shares, tokens, known


def train(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the rows that aren't held out (columns held_out and text), and the counts (word, lc = log10(c + 0.1)) of the training words that it doesn't hold."""
    counts = checkpointed(word_counts(rows))
    tokens, known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    least = frequency_bound(counts, FREQUENT)
    often = counts.where((F.col("a") >= least) | (F.col("word") == b"")).collect()  # FREQUENT at most, by the bound, and the end
    frequent = {bytes(r.word): r.c for r in sorted(often, key=lambda r: (-r.c, r.word))}
    own = [b"", *[w for w, c in frequent.items() if w and c][: WORD_CLASSES - 1]]
    vocabulary = Vocabulary(own)
    pairs = np.zeros(vocabulary.classes**2, np.int64)
    got = class_pairs(rows.where("NOT held_out").select("text"), vocabulary).toArrow()  # classes ** 2 rows at most
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    net = LogBilinear(vocabulary.classes)
    net.fit(pairs.reshape(vocabulary.classes, -1))
    shares = np.full(SUFFIX_CLASSES, SMOOTH)
    by_class = counts.where("c > 0").groupBy((F.crc32(F.substring("word", -3, 3)) % SUFFIX_CLASSES).alias("k")).agg((F.sum("c") + SMOOTH * F.count("*")).alias("s"))
    for r in by_class.collect():
        shares[r.k] += r.s
    for w in own:
        shares[suffix_class(w)] -= frequent[w] + SMOOTH if frequent.get(w) else 0
    rare = counts.where((F.col("a") < least) & (F.col("c") > 0)).select("word", F.log10(F.col("c") + SMOOTH).alias("lc"))
    return Model(own, net, frequent, np.maximum(shares, SMOOTH), tokens, known), rare


class Worker:
    """The model as tables, made once in a Python worker."""

    def __init__(self, model: Model):
        self.classes = Vocabulary(model.vocabulary)
        self.table = model.net.log10_table()
        own = self.classes.own
        self.of = {}  # frequent word -> its number in the arrays
        logs = [np.log10(c + SMOOTH) for c in model.frequent.values()]
        cls = [self.classes[w] for w in model.frequent]
        self.of = {w: k for k, w in enumerate(model.frequent)}
        self.n = len(logs)
        rare = range(SUFFIX_CLASSES)  # a rare word's entry, by its suffix
        self.log = np.array(logs + [0.0 for _ in rare])
        self.cls = np.array(cls + [own + k for k in rare], np.int64)
        share = np.log10(model.shares)
        self.inside = np.array([0.0 if c < own else lg - share[c - own] for lg, c in zip(logs, cls, strict=True)] + [-share[k] for k in rare])
        self.seen = np.array([c > 0 for c in model.frequent.values()] + [False for _ in rare])
        self.end = self.classes[b""]
        self.end_known = int(model.frequent.get(b"", 0) > 0)
        self.end_log = np.log10(model.frequent.get(b"", 0) + SMOOTH)
        self.all = np.log10(model.tokens + SMOOTH * (model.known + 1)) if model.tokens else np.log10(SMOOTH)

    def text(self, t: bytes) -> tuple[int, int, int, float, float]:
        """n_tokens; tokens whose words are held here, and of those the known ones; sums without the rare words' counts: of the base's logs, and of the model's."""
        of, n = self.of, self.n
        words = t.lower().split()
        at = np.fromiter([of[w] if w in of else n + zlib.crc32(w[-3:]) % SUFFIX_CLASSES for w in words], np.int64, len(words))
        cls = np.concatenate(([self.end], self.cls[at], [self.end]))
        tokens = len(words) + 1
        held = int((at < n).sum()) + 1
        known = int(self.seen[at].sum()) + self.end_known
        base = float(self.log[at].sum()) + self.end_log - tokens * self.all
        return tokens, held, known, base, float(self.table[cls[:-1], cls[1:]].sum(dtype=np.float64) + self.inside[at].sum())


def worker_of(shared) -> Worker:
    return once("lm", shared.value, Worker)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of df.

    Trained on the rows that aren't held out. A null or empty text is one token, the end. Without training rows every token
    is unknown. Rows that share an id, or have none, are each scored by themselves.
    """
    spark = df.sparkSession
    text = F.col(text_col).cast("string")
    model, rare_counts = train(df.select(is_held_out(F.col(id_col)).alias("held_out"), text.alias("text")))
    shared = spark.sparkContext.broadcast(model)
    rows = df.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("key"), text.alias("text"))

    def make():
        work = worker_of(shared).text
        return lambda texts: map(work, texts)

    docs = map_texts(rows, "key", "text", make, "n_tokens long, held long, known long, base double, model double")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = worker_of(shared).of
        for batch in batches:
            words: list[bytes] = []
            numbers: list[int] = []
            times: list[int] = []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t:
                    own = Counter([w for w in t.lower().split() if w not in of])
                    words += own
                    times += own.values()
                    numbers += [row] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32())], names=["row", "word", "n"])

    tokens = rows.select("key.row", "text").mapInArrow(rare, "row long, word binary, n int")
    unknown = float(np.log10(SMOOTH))
    # a rare word of no training text has log10(0.1); adding what its count gives beyond that needs only an inner join
    more = tokens.join(rare_counts, "word").groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * (F.col("lc") - unknown)).alias("more"))
    out = docs.select("key.row", F.col("key.id").alias("id"), "n_tokens", "held", "known", "base", "model").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0)) + (F.col("n_tokens") - F.col("held")) * unknown  # tokens whose counts come from the join, or from nowhere
    return out.select(
        F.col("id").alias(id_col), is_held_out(F.col("id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"),
    )
