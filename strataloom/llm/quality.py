"""A quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

The score of a feature vector x is sigmoid(w0 + w.x + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions at low rank, in time linear in x by the sum-of-squares identity. Weights come from at most MAX_TRAIN
labelled documents, those whose ids hash lowest; every text is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CONTINUATION, SPACE, map_texts

#: The bound of the training sample, in rows.
MAX_TRAIN = 4000
BUCKETS, FACTORS, STEPS, BATCH, RATE, DECAY = 2048, 8, 1000, 64, 0.05, 1e-4
THRESHOLD, FOLDS = 0.3, 5
CACHE_WORDS = 200_000
UPPER, LETTERS, DIGITS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)), b"0123456789"
SYMBOLS = b"#*$%&|<>"
STATISTICS = 12


class Buckets(dict):
    """word -> bucket of its hash; kept up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        got = zlib.crc32(word) % BUCKETS
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


def _share(text: bytes, chars: bytes) -> float:
    return (len(text) - len(text.translate(None, chars))) / max(1, len(text))


def features(text: bytes, buckets: Buckets) -> np.ndarray:
    """Hashed words (log counts, of length 1), then the structure statistics."""
    words = text.lower().split()
    x = np.zeros(BUCKETS + STATISTICS, np.float32)
    n = len(words)
    if n:
        counts = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, n), minlength=BUCKETS)
        logs = np.log1p(counts)
        x[:BUCKETS] = logs / np.sqrt((logs * logs).sum())
    lines = [y for y in text.split(b"\n") if y.strip(SPACE)]
    letters = len(text) - len(text.translate(None, LETTERS))
    x[BUCKETS:] = (
        np.log1p(n), np.log1p(len(text)), len(text.translate(None, SPACE)) / max(1, n), _share(text, SYMBOLS), _share(text, b"!"), (len(text) - len(text.translate(None, UPPER))) / max(1, letters),
        _share(text, DIGITS), _share(text, b".,;:?"), _share(text, CONTINUATION), np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, n),
    )
    return x


class FactorisationMachine:
    """Trained by Adagrad on log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        s = x[:, BUCKETS:] if len(x) else np.zeros((1, STATISTICS), np.float32)
        self.mean, self.scale = s.mean(0), s.std(0) + 1e-3
        d = BUCKETS + STATISTICS
        rate = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        self.w, self.v = np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32)
        x = self.scaled(x)
        gw, gv, gb = np.full(d, 1e-2, np.float32), np.full((d, FACTORS), 1e-2, np.float32), 1e-2
        for _ in range(-(-STEPS * BATCH // len(x)) if len(x) else 0):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                a, t = x[order[k : k + BATCH]], y[order[k : k + BATCH]]
                e = (self.raw(a) - t) / len(t)
                dw = a.T @ e + DECAY * self.w
                sums = a @ self.v
                dv = a.T @ (e[:, None] * sums) - self.v * ((a * a).T @ e)[:, None] + DECAY * self.v
                db = float(e.sum())
                gw += dw * dw
                gv += dv * dv
                gb += db * db
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= RATE * dv / np.sqrt(gv)
                self.bias -= RATE * db / gb**0.5

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - self.mean) / self.scale, -5, 5)
        return x

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores of scaled features."""
        pairs = 0.5 * (((x @ self.v) ** 2).sum(1) - ((x * x) @ (self.v * self.v)).sum(1))
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.w + pairs, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.raw(self.scaled(x)).astype(np.float64)


def fold(doc_id):
    """crc32 of the id as text, mod FOLDS; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> FactorisationMachine:
    """From labelled documents that aren't held out, max_train at most. Rows without a label or an id don't count; of several labels of an id the
    lowest does, and of several texts of an id one."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = own.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = documents.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.struct("doc_id", "quality").alias("key"), "text")

    def make():
        buckets = Buckets()
        return lambda texts: ((features(t, buckets).tobytes(),) for t in texts)

    one = map_texts(rows, "key", "text", make, "x binary").groupBy("key").agg(F.min("x").alias("x"))  # of rows that share an id, one
    got = sorted(one.collect(), key=lambda r: r.key.doc_id)  # max_train at most
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(-1, BUCKETS + STATISTICS)
    return FactorisationMachine(x, np.array([r.key.quality for r in got], np.float32))


def score_documents(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of documents.

    A null text is scored as an empty one, a text of any length whole. Repeated rows give repeated results; a null id is held out or not as the empty one.
    Without labelled rows every score is 0.5; an empty table gives none. Other columns are left out.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_train))

    def make():
        model, buckets = shared.value, Buckets()

        def work(texts: list[bytes]):
            for k in range(0, len(texts), 256):
                for s in model.score(np.array([features(t, buckets) for t in texts[k : k + 256]])).tolist():
                    yield (s,)

        return work

    out = map_texts(documents, "doc_id", "text", make, "score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
