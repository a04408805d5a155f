"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 5, with word edges) and of itself, all hashed into one
table; a passage is the mean of the words of `PASSAGE` consecutive ones (a word repeated at once counts as zero); a
linear softmax over that mean gives the odds of label 1. Embeddings (from random ones) and softmax are trained jointly in
numpy, both by their gradients (both classes weigh alike), with momentum, decay and n-gram dropout, which keeps any one spelling from carrying a word
alone. A document is labelled as a whole but usually toxic in few places, so its score is that of its most toxic passage,
over every start; training moves from the mean of all passages to the strongest ones. Unseen misspellings share
n-grams with known words and so score like them.

Only fitting uses a sample: at most `SAMPLE` labelled rows of each class, taken in the order of a hash of doc_id and
never held-out ones (crc32(doc_id as text) mod 5 = 0), as long as the texts of a class have at most `SAMPLE_CHARS`
characters together (a row that doesn't fit any more is passed over); of a repeated doc_id its shortest text counts.
Every document is scored on its whole text. The model that is broadcast has a fixed size (one number per hash bucket:
as the softmax is linear, an embedding enters a score by its product with the softmax's weights only).

Defined results: null and empty texts have no passage and get the score of the bias alone; labels that are null are not
used; without labels of both classes the score is the share of label 1 among those there are (0 without labels);
repeated rows are scored each. Output columns replace columns of equal name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import U64, append_columns, blobs, mix

BITS = 17
DIM = 16
PASSAGE = 12
SAMPLE = 2000
SAMPLE_CHARS = 32_000_000
STEPS = 100
#: Log odds that the n-gram of the steepest gradient so far gains in a step (falling to a tenth), and how much of a step goes on in the next one.
RATE, MOMENTUM = 20.0, 0.9
#: What is left of every embedding after a step, before the gradient: chance n-grams of few documents fade.
DECAY = 0.97
DROPOUT = 0.2
#: How much the strongest passages outweigh the others at the end of training.
SHARPNESS = 4.0
_EDGES = bytes(b for b in range(128) if not chr(b).isalnum())


def features(words: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of raw tokens and of the words themselves, word by word, and how many each word has.

    Punctuation at a token's edges is no part of the word."""
    cores = [f"<{w.strip(_EDGES).decode('utf-8', 'replace').lower()}>" for w in words]
    sizes = np.fromiter(map(len, cores), np.int32, len(cores))
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    ends = np.cumsum(sizes, dtype=np.int64)
    owner = np.repeat(np.arange(len(cores), dtype=np.int32), sizes)
    size = sizes[owner]
    left = (ends[owner] - np.arange(len(codes))).astype(np.int32)
    whole = np.add.reduceat(mix(codes + (size - left + 1).astype(U64) * U64(0x9E3779B97F4A7C15)), ends - sizes)
    shift = U64(64 - bits)
    owners, buckets = [np.arange(len(cores), dtype=np.int32)], [(mix(whole) >> shift).astype(np.int32)]
    h = codes
    for n in range(2, 6):
        h = h[:-1] * U64(0x100000001B3) + codes[n - 1 :]
        if n >= 3:
            at = np.flatnonzero((left[: len(h)] >= n) & (size[: len(h)] > n))
            owners.append(owner[at])
            buckets.append((mix(h[at] + U64(n)) >> shift).astype(np.int32))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    return bucket[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(cores))


@dataclass
class Model:
    """embedding (buckets x dim), softmax weights (dim x 2) and bias (2)."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def collapsed(self) -> tuple[np.ndarray, float]:
        """What scoring needs: the log odds each bucket adds, and the bias."""
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def constant(share: float) -> Model:
    """The model that gives every text the same score."""
    share = min(max(share, 1e-12), 1 - 1e-12)
    return Model(np.zeros((1, 1)), np.zeros((1, 2)), np.array([0.0, np.log(share / (1 - share))]))


def first_of_run(ids: np.ndarray) -> np.ndarray:
    """1 for every item but those equal to the one before, which have 0."""
    return np.append(True, ids[1:] != ids[:-1]).astype(np.float32)[: len(ids)]


def passage_starts(sizes: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every passage of texts that lie one after another."""
    count = np.where(sizes > 0, np.maximum(sizes - passage + 1, 1), 0)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return text, ((np.cumsum(sizes) - sizes)[text] + inside).astype(np.int32), np.minimum(sizes, passage).astype(np.int32)[text]


#: Words whose n-grams, and texts whose passages, are worked on at a time, so that training needs little beside its tables.
WORDS_AT_A_TIME, TEXTS_AT_A_TIME = 40_000, 250


def tokenised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list]:
    """(word numbers of all texts, sizes, n-grams): the n-grams as (first word, buckets, how many each word has)."""
    index: dict[bytes, int] = {}
    tokens = [np.fromiter((index.setdefault(w, len(index)) for w in (t or b"").split()), np.int32) for t in texts]
    words = list(index)
    del index
    grams = [(a, *features(words[a : a + WORDS_AT_A_TIME])) for a in range(0, len(words), WORDS_AT_A_TIME)]
    return np.concatenate(tokens), np.array([len(t) for t in tokens]), grams


def train(texts: list[bytes], labels: list[int], dim: int = DIM, steps: int = STEPS, passage: int = PASSAGE, seed: int = 7) -> Model:
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    tokens, sizes, grams = tokenised(texts)
    has = sizes > 0
    share = float(y[has].mean()) if has.any() else 0.0
    if not 0 < share < 1:
        return constant(float(y.mean()))
    per_word = np.concatenate([n for _, _, n in grams])
    blocks = []  # (texts, their words, passages)
    ends = np.cumsum(sizes)
    for x in range(0, len(sizes), TEXTS_AT_A_TIME):
        own = slice(x, min(x + TEXTS_AT_A_TIME, len(sizes)))
        if has[own].any():
            words = slice(int(ends[x] - sizes[x]), int(ends[own.stop - 1]))
            blocks.append((own, words, first_of_run(tokens[words]), *passage_starts(sizes[own], passage)))

    rng = np.random.default_rng(seed)
    buckets = 1 << BITS
    E = (rng.normal(0, 0.02 / np.sqrt(dim), (buckets, dim))).astype(np.float32)
    W = rng.normal(0, 1 / np.sqrt(dim), (dim, 2)).astype(np.float32)
    b = np.zeros(2)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both classes weigh alike
    speed, steepest = np.zeros(buckets, np.float32), 0.0
    for step in range(steps):
        direction = W[:, 1] - W[:, 0]
        keep = (rng.random(buckets, np.float32) >= DROPOUT).astype(np.float32) / np.float32(1 - DROPOUT)
        scores = (E @ direction) * keep
        word = np.concatenate([np.add.reduceat(scores[own], np.cumsum(n) - n) for _, own, n in grams]) / per_word
        sharp = SHARPNESS * min(1.0, 0.125 + 2 * step / steps)
        by_word, total = np.zeros(len(per_word)), 0.0
        for own, words, fresh, doc, begin, length in blocks:
            mine = tokens[words]
            sums = np.append(0.0, np.cumsum(word[mine] * fresh, dtype=np.float64))
            z = (sums[begin + length] - sums[begin]) / length
            # passages count by softmax over the text's passages, ever more sharply
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            a = np.exp(sharp * (z - np.repeat(np.maximum.reduceat(z, first), np.diff(np.append(first, len(z))))))
            n = own.stop - own.start
            a /= np.bincount(doc, a, n)[doc]
            logit = np.bincount(doc, a * z, n) + b[1] - b[0]
            g = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[own]) * weight[own] * has[own]
            total += g.sum()
            each = g[doc] * a / length
            cover = np.cumsum(np.bincount(begin, each, len(mine) + 1) - np.bincount(begin + length, each, len(mine) + 1))[:-1]
            np.add.at(by_word, mine, cover * fresh)
        by_word /= per_word
        to_logit = np.zeros(buckets)  # the loss's gradient by each bucket's log odds
        for a, own, n in grams:
            to_logit += np.bincount(own, np.repeat(by_word[a : a + len(n)], n), buckets)
        to_logit = to_logit.astype(np.float32) * keep
        by_weights = E.T @ to_logit
        # the gradient by an embedding is its bucket's times the softmax's direction
        steepest = max(steepest, float(np.abs(to_logit).max()))
        speed = MOMENTUM * speed + to_logit / (steepest + 1e-12)
        rate = RATE * (1 - 0.9 * step / steps) / float(direction @ direction)
        E *= np.float32(DECAY)
        for x in range(0, buckets, 1 << 14):
            E[x : x + (1 << 14)] -= np.outer(rate * speed[x : x + (1 << 14)], direction).astype(np.float32)
        W -= 0.05 * np.stack([-by_weights, by_weights], 1) / (np.abs(by_weights).max() + 1e-12)
        b += 0.3 * total / has.sum() * np.array([1.0, -1.0])
    return Model(E, W, b)


class Scorer(dict):
    """Log odds of raw tokens under the collapsed model, remembered up to a bound."""

    def __init__(self, scores: np.ndarray, bias: float, passage: int = PASSAGE, limit: int = 300_000):
        super().__init__()
        self.scores, self.bias, self.passage, self.limit = scores, bias, passage, limit
        self.bits = len(scores).bit_length() - 1

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        tokens = [t.split() if t else [] for t in texts]
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = [w for t in tokens for w in t]
        z = np.full(len(texts), self.bias)
        if flat:
            every = set(flat)
            new = list(every.difference(self))
            if len(self) + len(new) > self.limit:
                self.clear()
                new = list(every)
            for a in range(0, len(new), 50_000):
                part = new[a : a + 50_000]
                grams, per = features(part, self.bits)
                self.update(zip(part, (np.add.reduceat(self.scores[grams], np.cumsum(per) - per) / per).tolist()))
            s = np.fromiter(map(self.__getitem__, flat), np.float64, len(flat))
            s[1:][[x == y for x, y in zip(flat, flat[1:])]] = 0  # a word said again at once adds nothing, as in training
            sums = np.append(0.0, np.cumsum(s))
            text, begin, length = passage_starts(sizes, self.passage)
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            z[text[first]] += np.maximum.reduceat((sums[begin + length] - sums[begin]) / length, first)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic").distinct()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = usable.where("toxic = 1").orderBy(*order).limit(sample).unionByName(usable.where("toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    sizes = texts.select("doc_id", F.length("text").alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("n").alias("n"))
    taken, used = [], {0: 0, 1: 0}
    for r in sizes.orderBy(*order).collect():  # at most 2 * sample rows
        if used[r.toxic] + r.n <= chars:
            used[r.toxic] += r.n
            taken.append((r.doc_id, r.toxic, r.n))
    if not taken:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int, n int")
    rows = (
        texts.join(F.broadcast(wanted), "doc_id")
        .where(F.length("text") == F.col("n"))
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").cast("binary").alias("text"))
        .toPandas()
        .sort_values(["doc_id", "toxic"])
    )
    return train(rows.text.tolist(), rows.toxic.tolist())


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 if the score is at least 0.5)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.collapsed())

    def make():
        scorer = Scorer(*shipped.value)

        def work(batch):
            scores = scorer.score(blobs(batch, text))
            return {"score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return work

    return append_columns(docs, "score double, predicted int", make)


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents the model doesn't reject, with their own columns."""
    plain = docs.select(*[F.col(c).alias(f"_d_{c}") for c in docs.columns])
    return score_toxicity(plain, model, "_d_text").where("predicted = 0").select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])
