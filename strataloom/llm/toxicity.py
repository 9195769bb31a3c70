"""A toxicity classifier: a convolutional network over hashed words, with thresholds calibrated by language.

A word's vector is the mean of the vectors of its hash and of its first letters' hash. Filters of several widths pass over the words'
vectors; each filter's greatest value in the text (at 0 at least) goes to a logistic unit. Max pooling sends the gradient of a filter to
one place of the text only, so training in numpy is a few sparse steps. It sees at most MAX_TRAIN labelled texts, and texts of MAX_WORDS
words together, those whose ids hash lowest; CALIBRATE in ten of them set the thresholds and the score's scale and train nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

#: Bounds of the training sample: texts, and words of all of them.
MAX_TRAIN, MAX_WORDS = 6000, 4_000_000
BUCKETS, DIM, WIDTHS, FILTERS, PREFIX = 1 << 15, 16, (1, 2, 3), 16, 4
EPOCHS, BATCH, RATE, DECAY, LEAK, KEEP, HIDE = 6, 32, 0.1, 1e-5, 0.1, 0.7, 0.35
THRESHOLD, FOLDS, HELD_OUT, CALIBRATE = 0.3, 4, 2, 2
#: A language's own threshold needs so many toxic texts, and as many others, in the calibration sample.
MIN_TEXTS = 8
CACHE_WORDS = 200_000
#: Marks taken off both ends of a word.
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_"


class Buckets(dict):
    """word -> (bucket of its hash, bucket of its first letters' hash), as one number; kept up to CACHE_WORDS words. Bucket 0 is no word."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(EDGES) or word
        start = bare.decode("utf-8", "replace")[:PREFIX].encode()
        got = (1 + zlib.crc32(bare) % (BUCKETS - 1)) * BUCKETS + 1 + zlib.crc32(b"^" + start) % (BUCKETS - 1)
        if len(self) < CACHE_WORDS:
            self[word] = got
        return got


def numbers(text: bytes, buckets: Buckets) -> np.ndarray:
    """The text's words as bucket numbers: words are split at the contract's white space, A-Z in lower case."""
    words = text.lower().split()
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


class Network:
    """Trained by Adagrad on log loss, a toxic and another text in turn as often as there are of the larger class."""

    def __init__(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.words[0] = 0
        self.filters = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        rate = (float(y.sum()) + 1) / (len(y) + 2)
        self.bias, self.scale, self.offset = float(np.log(rate / (1 - rate))), 1.0, 0.0
        if len(set(y.tolist())) < 2:  # nothing to tell apart
            self.out[:] = 0
            return
        self.bias = 0.0
        self.g_words = np.full((BUCKETS, 1), 1e-3, np.float32)
        self.g_filters, self.g_out, self.g_bias = [np.full_like(f, 1e-3) for f in self.filters], np.full_like(self.out, 1e-3), 1e-3
        self.g_shift = [np.full_like(b, 1e-3) for b in self.shift]
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        size = max(map(len, classes))
        for _ in range(EPOCHS):
            order = np.stack([np.resize(rng.permutation(c), size) for c in classes], 1).ravel()
            for k in range(0, len(order), BATCH):
                self._step([self._thinned(texts[i], rng) for i in order[k : k + BATCH]], y[order[k : k + BATCH]])
        del self.g_words, self.g_filters, self.g_out, self.g_bias, self.g_shift

    @staticmethod
    def _thinned(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The text without some of its words, some others known by their first letters only: what must be learnt is what many texts share."""
        draw = rng.random(len(text))
        return np.where(draw < HIDE, text % BUCKETS, text)[draw < KEEP]

    def _join(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' word numbers in a row, with the widest filter's reach of no-words after each; and each text's first place."""
        gap = np.zeros(max(WIDTHS), np.int64)
        starts = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
        return np.concatenate([x for t in texts for x in (t, gap)]), starts

    def _pool(self, texts: list[np.ndarray]):
        """(word numbers, their vectors, for each width the places of the greatest values by text and filter, those values)."""
        ids, starts = self._join(texts)
        own = (self.words[ids // BUCKETS] + self.words[ids % BUCKETS]) / 2
        places, values = [], []
        wide = max(WIDTHS)
        for w, f, b in zip(WIDTHS, self.filters, self.shift, strict=True):
            n = len(own) - w + 1
            z = sum(own[k : k + n] @ f[k * DIM : (k + 1) * DIM] for k in range(w)) + b
            at, top = [], []
            for s, e in zip(starts, starts[1:], strict=False):
                part = z[s : max(s + 1, e - wide)]  # a window may run into the no-words behind its text
                j = part.argmax(0)
                at.append(s + j)
                top.append(part[j, np.arange(FILTERS)])
            places.append(np.array(at))
            values.append(np.array(top))
        return ids, own, places, values

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log odds, before calibration."""
        _, _, _, values = self._pool(texts)
        hidden = np.concatenate(values, 1)
        return np.where(hidden > 0, hidden, LEAK * hidden) @ self.out + self.bias

    def _step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        ids, own, places, values = self._pool(texts)
        hidden = np.concatenate(values, 1)
        slope = np.where(hidden > 0, 1, LEAK).astype(np.float32)
        act = hidden * slope
        e = (1 / (1 + np.exp(-np.clip(act @ self.out + self.bias, -30, 30))) - y).astype(np.float32) / len(y)
        back = slope * e[:, None] * self.out
        d_out, d_bias = act.T @ e + DECAY * self.out, float(e.sum())
        moved: dict[int, np.ndarray] = {}
        at_words, d_words = [], []
        for i, (w, f, at) in enumerate(zip(WIDTHS, self.filters, places, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            d = np.zeros_like(f)
            for k in range(w):
                own_at = own[at + k]  # text, filter, DIM
                d[k * DIM : (k + 1) * DIM] = np.einsum("tfd,tf->df", own_at, g)
                at_words.append((at + k).ravel())
                d_words.append((g[:, :, None] * f[k * DIM : (k + 1) * DIM].T).reshape(-1, DIM) / 2)
            d += DECAY * f
            moved[i] = d
            b = g.sum(0)
            self.g_shift[i] += b * b
            self.shift[i] -= RATE * b / np.sqrt(self.g_shift[i])
        for i, d in moved.items():
            self.g_filters[i] += d * d
            self.filters[i] -= RATE * d / np.sqrt(self.g_filters[i])
        self.g_out += d_out * d_out
        self.out -= RATE * d_out / np.sqrt(self.g_out)
        self.g_bias += d_bias * d_bias
        self.bias -= RATE * d_bias / self.g_bias**0.5
        hit, grad = ids[np.concatenate(at_words)], np.concatenate(d_words)
        rows, where = np.unique(np.concatenate([hit // BUCKETS, hit % BUCKETS]), return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, where.ravel(), np.concatenate([grad, grad]))
        total[rows == 0] = 0
        self.g_words[rows] += (total * total).mean(1, keepdims=True)
        self.words[rows] -= RATE * total / np.sqrt(self.g_words[rows])

    def calibrate(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        """Shift and scale the log odds so that THRESHOLD is where the two classes of the calibration texts are told apart best."""
        if len(set(y.tolist())) < 2 or not self.out.any():
            return
        raw = self.scores(texts, plain=True)
        cut = best_cut(raw, y)
        self.scale = 1 / max(0.25, float(np.std(raw)) / 2)
        self.offset = float(np.log(THRESHOLD / (1 - THRESHOLD))) - self.scale * cut

    def scores(self, texts: list[np.ndarray], plain: bool = False) -> np.ndarray:
        """A score from 0 to 1 for each text, or its plain log odds. Texts go through together, some 20,000 words at a time."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 20_000:
                out.append(self.raw(group))
                group, size = [], 0
        if group:
            out.append(self.raw(group))
        raw = np.concatenate(out) if out else np.empty(0)
        return raw if plain else 1 / (1 + np.exp(-np.clip(self.offset + self.scale * raw.astype(np.float64), -30, 30)))


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between two neighbouring scores that leaves the fewest texts on the wrong side, errors of a class weighed by its size;
    of equally good gaps the widest."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order].astype(np.float64), y[order]
    wrong = np.cumsum(t) / t.sum() + (len(t) - t.sum() - np.cumsum(1 - t)) / (len(t) - t.sum())  # toxic below or at, clean above
    gaps = np.append(s[1:] - s[:-1], 0.0)
    wrong = np.where(gaps > 0, wrong, np.inf)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[gaps[best].argmax()]
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def fold(doc_id):
    """crc32 of the id as text, mod FOLDS; HELD_OUT is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> tuple[Network, dict[str, float]]:
    """The network, and the threshold of each language that has MIN_TEXTS texts of both classes to set it by.

    From labelled documents that aren't held out. Rows without a label or an id don't count; of several labels of an id the lowest does,
    and of several texts of an id one. Languages serve to set thresholds, never a score.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    own = own.where(fold(F.col("doc_id")) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = documents.select("doc_id", "text", "lang").join(F.broadcast(own), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one")).select("doc_id", "toxic", "one.text", "one.lang")
    size = F.char_length(F.coalesce("text", F.lit("")))  # a bound of the number of words, twice over
    before = F.sum("_size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = rows.select("doc_id", size.alias("_size")).withColumn("_to", before).where((F.col("_to") <= 2 * max_words) | (F.col("_to") == F.col("_size"))).select("doc_id")  # max_train ids
    rows = rows.join(F.broadcast(within), "doc_id").select(F.struct("doc_id", "toxic", "lang").alias("key"), "text")

    def make():
        buckets = Buckets()
        return lambda texts: ((numbers(t, buckets).tobytes(),) for t in texts)

    got = sorted(map_texts(rows, "key", "text", make, "x binary").collect(), key=lambda r: r.key.doc_id)  # max_train texts, max_words words at most
    x, y = [np.frombuffer(r.x, np.int64) for r in got], np.array([r.key.toxic for r in got], np.float32)
    apart = np.array([zlib.crc32(b"c%d" % k) % 10 < CALIBRATE for k in range(len(x))], bool)
    network = Network([t for t, a in zip(x, apart, strict=True) if not a], y[~apart])
    texts, toxic = [t for t, a in zip(x, apart, strict=True) if a], y[apart]
    network.calibrate(texts, toxic)
    scores, langs = network.scores(texts), np.array([r.key.lang for r, a in zip(got, apart, strict=True) if a], object)
    limits = {}
    for lang in sorted({v for v in langs if v is not None}):
        at = langs == lang
        if min(toxic[at].sum(), (1 - toxic[at]).sum()) >= MIN_TEXTS:
            limits[lang] = best_cut(scores[at], toxic[at])
    return network, limits


def score_documents(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3), threshold (of the row's language) and flagged (a score of that or more).

    A null text is scored as an empty one, a text of any length whole. Repeated rows give repeated results, up to a rounding in the sixth place
    (products of floats are added in an order that depends on the texts scored together); a null id is held out or not as
    the empty one. Languages without a threshold of their own, and null, have 0.3. Labels of one kind only, or none, give every row
    the share of toxic ones (0.5 without any); an empty table gives no row. Other columns are left out.
    """
    network, limits = fit(documents, labels, max_train, max_words)
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def make():
        model, buckets = shared.value, Buckets()

        def work(texts: list[bytes]) -> Iterable[tuple]:
            for k in range(0, len(texts), 64):
                for s in model.scores([numbers(t, buckets) for t in texts[k : k + 64]]).tolist():
                    yield (round(s, 6),)

        return work

    rows = documents.select(F.struct("doc_id", "lang").alias("key"), "text")
    own = F.lit(THRESHOLD)
    for lang, limit in limits.items():
        own = F.when(F.col("key.lang") == lang, limit).otherwise(own)
    out = map_texts(rows, "key", "text", make, "score double").withColumn("threshold", own)
    return out.select("key.doc_id", (fold(F.col("key.doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
