"""LM scoring by masked pseudo-likelihood with a bidirectional window network.

Every token is predicted from the tokens on both sides of it (`SIDE` each way): their embeddings, concatenated, pass one
tanh layer and a softmax over classes, and for a frequent word a second softmax over the words of its class. A
document's score is the sum over its tokens of the log probability of the token given its neighbours, so the masked token
is never seen by its own prediction.

The vocabulary comes from the counts of all words of all documents. The most frequent words are dealt by rank to `GROUPS`
classes of `SLOTS` words; all others share `CLASSES` hash classes. The network predicts the class, and the word within
a class of frequent words; which word of a hash class it is has the probability c / (n + 1), from the counts c of the word
and n of its class, and words that the corpus lacks share one count. These counts are a distributed table of all words,
joined when documents are scored, so every token pays for its own word whatever the size of the vocabulary, and the
probabilities of all words sum to one. The counts of the commonest words, at most `HEAD`, are sent to every task, which spares
these words the join and changes no score. The network starts as the model that knows counts alone and is trained in numpy on
the whole corpus, data-parallel: in each round every task trains the shared parameters on its documents, and the
parameters are averaged, weighted by tokens and slice by slice on the executors, so the driver sees one model whatever the
size of the corpus (its few megabytes are averaged by as many tasks as it has slices). A hash of row key and position
deals the positions to the rounds, so each position of each document is masked and predicted in exactly one round. The
number of messages grows with the input, the model's size doesn't. As tasks train apart, the parameters, and with them
the scores' last digits, depend on how the documents are cut into partitions; with equal partitions they are equal.

Defined results: null, empty and wordless texts have no tokens, a pseudo log-likelihood of 0 and no mean; at the edges of
a document the missing neighbours are one padding token; rows with a null key mask the same positions as key 0; repeated
rows score alike; without any token every class has the same probability. Logarithms of word counts are summed as multiples of 2^-32, so
that sums don't depend on the order of rows. Output columns replace columns of equal name.
"""

from __future__ import annotations

import struct
from collections import Counter
from itertools import filterfalse

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import U64, alnum_words, append_columns, blobs, cut, mix, partitions, sliced, small_batches

SIDE, DIM, HIDDEN = 2, 16, 16
GROUPS, SLOTS, CLASSES = 16, 64, 32
ROUNDS, RATE = 2, 0.1
#: Tokens of a training step, and tokens that are scored at a time.
STEP, CHUNK = 2048, 2048
#: Words that a task counts before it posts them.
HELD_WORDS = 150_000
#: Words whose counts every task gets, so that they need no join. The counts of all other words are joined.
HEAD = 100_000
#: The logit of a place without a word.
NEVER = -1e4


#: Logarithms of word counts are integers of this many to one.
GRID = 1 << 32


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): the counts of all words over all documents."""

    def count(batches):
        import pyarrow as pa

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in sliced(batches):
            for t in blobs(batch, text):
                seen.update(alnum_words(t))
            if len(seen) > HELD_WORDS:
                yield flush()
                seen.clear()
        yield flush()

    return cut(small_batches(docs).select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame, words: int = GROUPS * SLOTS) -> list[tuple[bytes, int]]:
    """The most frequent words, with their counts."""
    top = counts.orderBy(F.desc("n"), "word").limit(words).collect()
    return [(bytes(r.word), r.n) for r in top]


def class_totals(counts: DataFrame, tokens) -> np.ndarray:
    """The summed counts of the words of each hash class."""
    shipped = counts.sparkSession.sparkContext.broadcast(tokens)

    def add(batches):
        import pyarrow as pa

        token = shipped.value
        first = token.words
        sums = np.zeros(token.classes, np.int64)
        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                if w not in token.known:
                    sums[token[w] - first] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(token.classes, dtype=np.int32)), pa.array(sums)], names=["class", "n"])

    out = np.zeros(tokens.classes, np.int64)
    for r in small_batches(counts).mapInArrow(add, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        out[r["class"]] = r.n
    return out


class Tokens(dict):
    """Token numbers by word: frequent words by rank, from groups * slots on hash classes; the padding token comes last.
    Numbers of other words are remembered up to a bound. totals: the summed counts of each hash class; counts: the table of
    all words, which stays with the driver's plan and isn't shipped."""

    def __init__(self, words: list[bytes], groups: int, slots: int, classes: int, totals: np.ndarray | None = None, counts: DataFrame | None = None):
        super().__init__()
        self.totals = np.zeros(classes, np.int64) if totals is None else totals
        self.counts = counts
        self.known = {w: i for i, w in enumerate(words)}
        self.groups, self.slots, self.classes = groups, slots, classes
        self.words = groups * slots
        self.size = self.words + classes
        self.update(self.known)

    def __reduce__(self):
        return Tokens, (list(self.known), self.groups, self.slots, self.classes, self.totals)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
            self.update(self.known)
        self[word] = i = self.words + xxhash.xxh32_intdigest(word) % self.classes
        return i

    def __call__(self, text: bytes | None) -> np.ndarray:
        return self.of(alnum_words(text))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def initial(groups: int, slots: int, classes: int, words=(), totals=(), seed: int = 3) -> list[np.ndarray]:
    """embedding, hidden weights and bias, class weights and bias, word weights and bias by group. The biases are the
    logarithms of the counts: of the frequent words by rank, and the totals of the hash classes."""
    rng = np.random.default_rng(seed)
    f = np.float32
    count = np.zeros(groups * slots)
    count[: len(words)] = words
    count = count.reshape(slots, groups).T
    mass = np.append(count.sum(1), np.asarray(totals, float) if len(totals) else np.zeros(classes))
    if not mass.any():
        mass[:], count[:] = 1.0, 1.0
    with np.errstate(divide="ignore"):
        low = np.maximum(np.log(mass / mass.sum()), NEVER)
        inner = np.maximum(np.log(count) - np.log(np.maximum(count.sum(1, keepdims=True), 1)), NEVER)
    low[groups:] = np.maximum(low[groups:], np.log(1 / (mass.sum() + classes)))  # a word that the corpus lacks may come
    return [
        rng.normal(0, 0.3, (groups * slots + classes + 1, DIM)).astype(f), rng.normal(0, 1 / np.sqrt(2 * SIDE * DIM), (2 * SIDE * DIM, HIDDEN)).astype(f),
        np.zeros(HIDDEN, f), rng.normal(0, 0.01, (HIDDEN, groups + classes)).astype(f), low.astype(f),
        rng.normal(0, 0.01, (groups, HIDDEN, slots)).astype(f), inner.astype(f),
    ]


def contexts(ids: np.ndarray, pad: int, at: np.ndarray | None = None) -> np.ndarray:
    """The neighbours of every token, or of those at the given places, from the far left to the far right."""
    wide = np.concatenate([np.full(SIDE, pad, np.int32), ids, np.full(SIDE, pad, np.int32)])
    sides = [o for o in range(2 * SIDE + 1) if o != SIDE]
    return np.stack([wide[o : o + len(ids)] if at is None else wide[at + o] for o in sides], 1)


def heads(p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes, and of the words by group, each with its bias as the last row."""
    return tuple(np.concatenate([weights, bias[..., None, :]], -2) for weights, bias in ((p[3], p[4]), (p[5], p[6])))


def forward(p: list[np.ndarray], around: np.ndarray):
    """(inputs, hidden layer with a last column of ones)."""
    x = p[0].take(around.ravel(), 0).reshape(len(around), -1)
    h = np.ones((len(around), len(p[2]) + 1), x.dtype)
    z = x @ p[1]
    z += p[2]
    np.tanh(z, out=h[:, :-1])
    return x, h


def lowered(z: np.ndarray, bounded: bool) -> np.ndarray:
    """Logits less their maximum, unless exp of them is known to stay in range."""
    if not bounded:
        z -= z.max(1, keepdims=True)
    return z


def word_logits(h: np.ndarray, inner: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """The logits within the own group of all rows that have one; by_group puts these rows first."""
    z = np.empty((parts[-1][2] if parts else 0, inner.shape[-1]), h.dtype)
    for k, a, b in parts:
        np.matmul(h[a:b], inner[k], out=z[a:b])
    return z


def is_bounded(p: list[np.ndarray]) -> bool:
    """Whether no logit is large and every softmax has one that isn't low: the hidden layer lies within -1 and 1."""
    for weights, bias in ((p[3], p[4]), (p[5], p[6])):
        reach = np.abs(weights).sum(-2)
        if (bias + reach).max() > 60 or (bias - reach).max(-1).min() < -60:
            return False
    return True


def class_of(p: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    groups, _, slots = p[5].shape
    return np.where(ids < groups * slots, ids % groups, ids - groups * slots + groups)


def by_group(p: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that has the words of a group together, hash classes last; and (group, from, to) of every group that occurs."""
    groups, _, slots = p[5].shape
    own = np.where(ids < groups * slots, ids % groups, groups).astype(np.int16)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(groups + 1)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def log_probabilities(p: list[np.ndarray], ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids))
    bounded = is_bounded(p)
    outer, inner = heads(p)
    groups = len(inner)
    ones, inner_ones = np.ones(outer.shape[-1], outer.dtype), np.ones(inner.shape[-1], inner.dtype)
    for a in range(0, len(ids), CHUNK):
        order, parts = by_group(p, ids[a : a + CHUNK])
        own = ids[a : a + CHUNK][order]
        h = forward(p, around[a : a + CHUNK][order])[1]
        z = lowered(h @ outer, bounded)
        lp = z[np.arange(len(own)), class_of(p, own)].astype(np.float64)
        lp -= np.log((np.exp(z, out=z) @ ones).astype(np.float64))
        z = lowered(word_logits(h, inner, parts), bounded)
        lp[: len(z)] += z[np.arange(len(z)), own[: len(z)] // groups]
        lp[: len(z)] -= np.log((np.exp(z, out=z) @ inner_ones).astype(np.float64))
        out[a + order] = lp
    return out


def summed_rows(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Row i is the sum of the values whose place is i."""
    at = at.astype(np.min_scalar_type(size))  # short numbers sort by radix
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.zeros((size, values.shape[1]), values.dtype)
    out[at[starts]] = np.add.reduceat(values.take(order, 0), starts, axis=0)
    return out


class Trainer:
    """Adagrad steps on masked positions; returns the parameters and the number of positions seen."""

    def __init__(self, p: list[np.ndarray], rate: float = RATE):
        self.p = [x.copy() for x in p]
        self.rate = rate
        self.square = [np.full_like(x, 1e-3) for x in p]
        self.seen = self.steps = 0
        self.bounded = False
        self.ones, self.inner_ones = np.ones(p[4].shape[-1], p[4].dtype), np.ones(p[6].shape[-1], p[6].dtype)

    def step(self, ids: np.ndarray, around: np.ndarray):
        p, n = self.p, len(ids)
        if self.steps % 16 == 0:  # a step moves a weight by at most the rate, so this holds for the next ones with room to spare
            self.bounded = is_bounded(p)
        self.steps += 1
        order, parts = by_group(p, ids)
        ids, around = ids[order], around[order]
        outer, inner = heads(p)
        # the gradient at the logits is z times share, row by row; the share is multiplied where rows are short
        x, h = forward(p, around)
        z = lowered(h @ outer, self.bounded)
        total = np.exp(z, out=z) @ self.ones
        z[np.arange(n), class_of(p, ids)] -= total
        share = (1 / (n * total))[:, None]
        dh = z @ p[3].T
        dh *= share
        d_outer, d_inner = (h * share).T @ z, np.zeros_like(inner)
        z = lowered(word_logits(h, inner, parts), self.bounded)
        total = np.exp(z, out=z) @ self.inner_ones
        z[np.arange(len(z)), ids[: len(z)] // len(inner)] -= total
        share = (1 / (n * total))[:, None]
        scaled, back = h[: len(z)] * share, np.empty((len(z), len(p[2])), z.dtype)
        for k, a, b in parts:
            np.matmul(z[a:b], p[5][k].T, out=back[a:b])
            np.matmul(scaled[a:b].T, z[a:b], out=d_inner[k])
        back *= share
        dh[: len(z)] += back
        h = h[:, :-1]
        dh *= 1 - h * h
        rows = summed_rows(around.ravel(), (dh @ p[1].T).reshape(-1, DIM), len(p[0]))
        for own, square, g in zip(p, self.square, (rows, x.T @ dh, np.ones(n, dh.dtype) @ dh, d_outer[:-1], d_outer[-1], d_inner[:, :-1], d_inner[:, -1])):
            square += g * g
            g *= self.rate
            g /= np.sqrt(square)
            own -= g
        self.seen += n


def masked(n: int, key: int, turn: int, rounds: int) -> np.ndarray:
    """The positions of a text that a round predicts: each falls to one of the rounds, by hash."""
    h = mix(np.arange(n, dtype=U64) + U64(key & 0xFFFFFFFFFFFFFFFF))
    return np.flatnonzero(h % U64(rounds) == U64(turn))


def train(docs: DataFrame, key: str, text: str, tokens, start: list[np.ndarray], turn: int, rounds: int) -> list[np.ndarray]:
    """One round over all documents: local training in every task, then the weighted mean of the parameters."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((tokens, start))
    shapes = [x.shape for x in start]
    sizes = [x.size for x in start]
    slices = 16
    cuts = np.linspace(0, sum(sizes), slices + 1).astype(int)

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        token, p = shipped.value
        trainer, held, size = Trainer(p), [], 0

        def flush():
            if held:
                ids, around = (np.concatenate(x) for x in zip(*held))
                for a in range(0, len(ids), STEP):
                    trainer.step(ids[a : a + STEP], around[a : a + STEP])
                held.clear()

        for batch in sliced(batches):
            for d, t in zip(batch.column(key).to_pylist(), blobs(batch, text)):
                ids = token(t)
                if len(ids):
                    at = masked(len(ids), xxhash.xxh64_intdigest(f"{0 if d is None else d}"), turn, rounds)
                    held.append((ids[at], contexts(ids, token.size, at)))
                    size += len(at)
            if size > 8192:
                flush()
                size = 0
        flush()
        if trainer.seen:
            flat = np.concatenate([x.ravel() for x in trainer.p]).astype(np.float64) * trainer.seen
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(slices, dtype=np.int32)), pa.array(np.full(slices, number, np.int32)), pa.array(np.full(slices, trainer.seen, np.int64)),
                    pa.array([flat[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                ],
                names=["slice", "task", "seen", "sum"],
            )

    def mean(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            for s, _, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                sums[s] = sums.get(s, 0.0) + np.frombuffer(raw, np.float32).astype(np.float64)
                seen[s] = seen.get(s, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / seen[s]).tobytes() for s, x in sums.items()], pa.binary())], names=["slice", "mean"])

    sent = docs.select(key, text).mapInArrow(local, "slice int, task int, seen long, sum binary")
    rows = sent.repartition(min(slices, partitions(spark)), "slice").sortWithinPartitions("slice", "task").mapInArrow(mean, "slice int, mean binary").collect()
    if not rows:
        return start
    flat = np.concatenate([np.frombuffer(r["mean"], np.float64) for r in sorted(rows, key=lambda r: r["slice"])]).astype(np.float32)
    return [x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: int = GROUPS, slots: int = SLOTS, classes: int = CLASSES, rounds: int = ROUNDS):
    """(tokens, parameters) of the network trained on all documents."""
    counts = count_words(docs, text)
    top = vocabulary(counts, groups * slots)
    tokens = Tokens([w for w, _ in top], groups, slots, classes, counts=counts)
    tokens.totals = class_totals(counts, tokens)
    p = initial(groups, slots, classes, [n for _, n in top], tokens.totals)
    for turn in range(rounds):
        p = train(docs, key, text, tokens, p, turn, rounds)
    return tokens, p


def word_digests(words) -> np.ndarray:
    """64 bits of each word as a signed number, as xxhash64 of a column gives them."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), U64, len(words)).view(np.int64)


def log_counts():
    """The column of the logarithms of the counts, in units of 1 / GRID."""
    return F.round(F.log("n") * GRID).cast("long")


def head(counts: DataFrame) -> tuple[int, list[bytes], np.ndarray]:
    """(least, words, logs): all words that occur at least `least` times, at most HEAD, and the logarithms of their counts.

    Counts that fall to the same eighth of a doubling are taken or left together; a word that occurs once has no share."""
    by_size = counts.where("n > 1").groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, taken = None, 0
    for r in sorted(by_size.collect(), key=lambda r: -r["size"]):
        taken += r.words
        if taken > HEAD:
            break
        least = r.least
    if least is None:
        return (1 << 63) - 1, [], np.empty(0, np.int64)
    got = counts.where(F.col("n") >= least).select("word", log_counts().alias("log")).toArrow()
    return least, got["word"].to_pylist(), got["log"].to_numpy()


def numbered(tokens: Tokens, words: list[bytes]) -> Tokens:
    """The same numbers, but words of the head that share classes have their own: from tokens.size + 1 on, by place in the head."""
    out = Tokens(list(tokens.known), tokens.groups, tokens.slots, tokens.classes, tokens.totals)
    out.known = {w: tokens.size + 1 + i for i, w in enumerate(words)} | out.known
    out.update(out.known)
    return out


def text_digest(text: bytes | None) -> tuple[int, int]:
    """128 bits of a text as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(text or b""))


def rest_of_documents(docs: DataFrame, tokens: Tokens, text: str, least: int, shipped) -> DataFrame:
    """(_rest1, _rest2, _logs): the summed log counts of the words that share classes and aren't in the head, by digest of the
    text, in units of 1 / GRID. least and shipped: the least count of the head's words, and the broadcast that has them second.

    Words that occur once or never add nothing and need no row. Words travel as 64-bit digests, which sort fast; of two
    words with one digest the larger count would stand for both."""

    def post(batches):
        import pyarrow as pa

        (frequent, _), common, _ = shipped.value
        known = frequent.known.keys() | set(common)
        for batch in sliced(batches):
            firsts, seconds, words, times = [], [], [], []
            for t in set(blobs(batch, text)):
                own = Counter(filterfalse(known.__contains__, alnum_words(t)))
                if own:
                    a, b = text_digest(t)
                    firsts.append(np.full(len(own), a))
                    seconds.append(np.full(len(own), b))
                    words.append(word_digests(own))
                    times.extend(own.values())
            keys = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (firsts, seconds)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(words) if words else np.empty(0, np.int64)), pa.array(times, pa.int32())], names=["_rest1", "_rest2", "word", "times"])

    posted = small_batches(docs).select(text).mapInArrow(post, "_rest1 long, _rest2 long, word long, times int")
    others = tokens.counts.where((F.col("n") > 1) & (F.col("n") < least))
    logs = others.groupBy(F.xxhash64("word").alias("word")).agg(F.max("n").alias("n")).select("word", log_counts().alias("log"))
    # the batches that a repeated text is in post it once each: one row a text and word counts
    once = posted.join(logs, "word").groupBy("word", "_rest1", "_rest2").agg(F.max(F.col("times") * F.col("log")).alias("logs"))
    return cut(once.groupBy("_rest1", "_rest2").agg(F.sum("logs").alias("_logs")))


def score_documents(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """Append n_tokens, pll (summed conditional log probabilities) and mean_pll (null without tokens)."""
    tokens, _ = model
    least, common, logs = head(tokens.counts)
    shipped = docs.sparkSession.sparkContext.broadcast((model, common, logs))

    def make():
        (tokens, p), common, logs = shipped.value
        shared = np.concatenate([np.zeros(tokens.words), np.log(tokens.totals + 1.0)])
        number = numbered(tokens, common)
        plain = np.concatenate([np.arange(tokens.size + 1, dtype=np.int32), tokens.of(common)])
        own_logs = np.concatenate([np.zeros(tokens.size + 1, np.int64), logs])

        def work(batch):
            raw = blobs(batch, text)
            numbers = [number(t) for t in raw]
            ids = [plain[x] for x in numbers]
            sizes = np.array([len(x) for x in ids], np.int64)
            around = [contexts(x, tokens.size) for x in ids if len(x)]
            sums, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            if around:
                flat = np.concatenate(ids)
                ends = np.cumsum(sizes)
                reached = np.append(0, np.cumsum(own_logs[np.concatenate(numbers)]))
                known = reached[ends] - reached[ends - sizes]
                lp = log_probabilities(p, flat, np.concatenate(around)) - shared[flat]
                sums = np.bincount(np.repeat(np.arange(len(ids)), sizes), lp, len(ids))
            first, second = zip(*map(text_digest, raw)) if raw else ((), ())
            return {"n_tokens": sizes, "pll": sums, "_known": known, "_rest1": list(first), "_rest2": list(second)}

        return work

    rest = rest_of_documents(docs, tokens, text, least, shipped)
    scored = append_columns(docs.drop("mean_pll"), "n_tokens bigint, pll double, _known bigint, _rest1 bigint, _rest2 bigint", make)
    summed = scored.join(rest, ["_rest1", "_rest2"], "left").withColumn("pll", F.col("pll") + (F.col("_known") + F.coalesce("_logs", F.lit(0))) / F.lit(float(GRID)))
    return summed.drop("_known", "_rest1", "_rest2", "_logs").withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))
