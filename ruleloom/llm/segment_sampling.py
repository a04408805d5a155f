"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text becomes the model's normalised form (a leading space, spaces as U+2581). Its segmentations are the paths of a
lattice of vocabulary pieces. The lattice falls apart wherever no piece holds the two characters that meet, so a text is
cut there into units whose lattices are made once; no piece of the vocabulary crosses a cut. Characters without a piece
go through byte pieces. A piece has the weight 1 / (rank + 2.7), its rank in the vocabulary (this model
stores merge ranks, not probabilities), to the power `alpha`; a path's probability is its share of all paths of the text.

`k` distinct segmentations are drawn without replacement by perturbed A-star search: each set of paths has a Gumbel
value, the maximum over its members; the search pops the set with the largest value, draws its best member, and pushes
what is left of it, with values below the popped one: at every step of the path the set of paths that turn off there.
Sets are drawn lazily, all steps of all paths of a batch in few numpy passes, so a sample costs time in proportion to the text. The
inclusion score of a sample with log probability l is 1 - exp(-exp(l - kappa)), kappa being the value of the next sample
(the probability that it is among the k); with weights 1 / score sums over samples are unbiased.

Draws depend on the row key, the seed and the position only, never on batches or partitions. decode() is exact: decoding
any sample gives the text back.

Defined results: null and empty texts have one empty segmentation with log probability 0 and inclusion 1; texts with
fewer than k segmentations give all of them, each with inclusion 1; a null key counts as 0; rows with equal key and text
give equal samples; long texts are encoded whole. The other columns are kept; a column named like an output is replaced.
"""

from __future__ import annotations

import itertools
import math
import os

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ruleloom.llm.common import U64, append_columns, mix, sliced, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K = 2
SPACE = "▁"
#: A literal U+2581 in a text, which must not become a space, travels through byte pieces under this stand-in, which no text holds.
STAND_IN = "\udfff"
#: Cumulative probabilities are multiples of this, and draws lie halfway between them.
GRID = 2.0**-28
#: Edges that a task remembers, and characters that it takes at a time.
MAX_EDGES, CHARS = 2_000_000, 2_000_000


class Pieces:
    """The vocabulary of a model file: pieces with log weights, byte pieces, and the bytes each id stands for."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.weights: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.raw: list[bytes] = []
        rank = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.weights[piece] = (i, -alpha * float(np.log(rank + 2.7)))
                self.raw.append(piece.replace(SPACE, " ").encode())
                rank += 1
        self.longest = max(map(len, self.weights))
        self._pairs()
        self.alphabet = np.array(sorted({ord(c) for x in self.weights for c in x}), np.int64)
        self._trie()
        self.byte_weight = -alpha * float(np.log(rank + 2.7)) - 10.0

    def _pairs(self):
        """Which neighbours some piece holds: classes of the characters (0: in no pair) and a table over two classes."""
        pairs = {x[i : i + 2] for x in self.weights for i in range(len(x) - 1)}
        letters = sorted({c for x in pairs for c in x})
        self.class_of = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        for i, c in enumerate(letters, 1):
            self.class_of[ord(c)] = i
        self.classes = len(letters) + 1
        self.paired = np.zeros(self.classes * self.classes, bool)
        for a, b in pairs:
            self.paired[self.class_of[ord(a)] * self.classes + self.class_of[ord(b)]] = True

    def units(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The units of all texts, and how many each text has."""
        marked = [SPACE + t.replace(SPACE, STAND_IN).replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        whole = "".join(marked)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.class_of[np.minimum(codes, len(self.class_of) - 1)]
        begins = np.append(True, ~self.paired[kind[:-1] * self.classes + kind[1:]])
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        at = np.flatnonzero(begins)
        cuts = at.tolist()
        ends = np.cumsum(sizes)
        return [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)])], np.searchsorted(at, ends) - np.searchsorted(at, ends - sizes)

    def _trie(self):
        """Transitions as sorted keys (state * letters + letter), and the piece that ends in each state."""
        letters = len(self.alphabet)
        at = {int(c): i for i, c in enumerate(self.alphabet)}
        steps: dict[int, int] = {}
        ends: list[tuple[int, float]] = [(-1, 0.0)]
        for piece, (i, w) in self.weights.items():
            state = 0
            for c in piece:
                k = state * letters + at[ord(c)]
                if k not in steps:
                    steps[k] = len(ends)
                    ends.append((-1, 0.0))
                state = steps[k]
            ends[state] = (i, w)
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[int(k)] for k in self.keys], np.int64)
        self.end_id = np.array([e[0] for e in ends], np.int32)
        self.end_weight = np.array([e[1] for e in ends])
        self.single = np.array([chr(c) in self.weights for c in self.alphabet])

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Lattices:
    """Nodes and edges of the units seen so far, as flat arrays: by edge the cumulative probability within its node, the
    node it leads to (-1: the unit's end), the piece, its log probability and its node; by node its first edge. A node's
    edges are one range, longer pieces first, as these are mostly the likelier ones."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self):
        self.base: dict[str, int] = {}
        self.nodes = 0
        self.new: tuple[list, ...] = ([], [], [], [], [], [])
        self.arrays = [np.empty(0, t) for t in (np.float64, np.int32, np.int32, np.float64, np.int32, np.int32)]

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """(end, id, log weight) from every position. Byte chains go through positions beyond the unit's length, in order."""
        p, n = self.pieces, len(unit)
        get, longest = p.weights.get, p.longest
        out: list[list] = []
        for i in range(n):
            own = []
            for j in range(i + 1, (n if n < i + longest else i + longest) + 1):
                w = get(unit[i:j])
                if w is not None:
                    own.append((j, w[0], w[1]))
            out.append(own)
        out.append([])
        for i, c in enumerate(unit):
            if c not in p.weights:
                raw = (SPACE if c == STAND_IN else c).encode()
                at = i
                for b in raw[:-1]:
                    out[at].append((len(out), p.bytes[b], p.byte_weight))
                    at = len(out)
                    out.append([])
                out[at].append((i + 1, p.bytes[raw[-1]], p.byte_weight))
        return out

    def add(self, unit: str) -> int:
        out, n = self.edges(unit), len(unit)
        beta = [0.0] * len(out)
        # a chain position leads to a later chain position or, last of its chain, to a later place of the unit
        for i in range(n - 1, -1, -1):
            for j, _, w in out[i]:
                if j > n:
                    chain = [j]
                    while out[chain[-1]][0][0] > n:
                        chain.append(out[chain[-1]][0][0])
                    for c in reversed(chain):
                        beta[c] = out[c][0][2] + beta[out[c][0][0]]
            if len(out[i]) == 1:
                beta[i] = out[i][0][2] + beta[out[i][0][0]]
            else:
                ws = [w + beta[j] for j, _, w in out[i]]
                top = max(ws)
                beta[i] = top + math.log(sum([math.exp(w - top) for w in ws]))
        first = self.nodes
        cdf, target, ids, logps, node, begin = self.new
        for i, own in enumerate(out):
            if i == n:
                continue
            start = first + i - (i > n)
            total = 0.0
            begin.append(len(self.arrays[0]) + len(cdf))
            for j, piece, w in reversed(own):
                logp = min(w + beta[j] - beta[i], 0.0)
                total += math.exp(logp)
                cdf.append(min(round(total / GRID) * GRID, 1.0))
                target.append(-1 if j == n else first + j - (j > n))
                ids.append(piece)
                logps.append(logp)
                node.append(start)
            cdf[-1] = 1.0
        self.base[unit] = first
        self.nodes += len(out) - 1
        return first

    def add_all(self, us: list[str]):
        """Add many units at once; those with characters without a piece, and very long ones, go one by one."""
        p = self.pieces
        sizes = np.array([len(u) for u in us], np.int64)
        codes = np.frombuffer("".join(us).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = np.minimum(np.searchsorted(p.alphabet, codes), len(p.alphabet) - 1)
        plain = (p.alphabet[letter] == codes) & p.single[letter]
        begin = np.cumsum(sizes) - sizes
        simple = np.logical_and.reduceat(plain, begin) & (sizes <= 48)
        for k in np.flatnonzero(~simple).tolist():
            self.add(us[k])
        if not simple.any():
            return
        letter, sizes = letter[np.repeat(simple, sizes)], sizes[simple]
        end_of = np.repeat(np.cumsum(sizes), sizes)
        n, letters = len(letter), len(p.alphabet)
        at, state, depth, found = np.arange(n), np.zeros(n, np.int64), 0, []
        while len(at):
            key = state * letters + letter[at + depth]
            k = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
            ok = p.keys[k] == key
            at, state, depth = at[ok], p.to[k[ok]], depth + 1
            piece = p.end_id[state]
            hit = piece >= 0
            found.append((at[hit], at[hit] + depth, piece[hit], p.end_weight[state[hit]]))
            on = at + depth < end_of[at]
            at, state = at[on], state[on]
        # by node, longer pieces first; then the nodes by what is left of their unit, so that ends come before starts
        a, b, ids, w = (np.concatenate(x[::-1]) for x in zip(*found))
        order = np.argsort(a, kind="stable")
        a, b, ids, w = a[order], b[order], ids[order], w[order]
        last = b == end_of[a]
        left = (end_of[a] - a).astype(np.int8)
        order = np.argsort(left, kind="stable")
        beta = np.zeros(n + 1)
        cuts = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y > x:
                at = order[x:y]
                own = a[at]
                v = w[at] + np.where(last[at], 0.0, beta[b[at]])
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                top = np.maximum.reduceat(v, new)
                beta[own[new]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(new, y - x)))), new))
        logp = np.minimum(w + np.where(last, 0.0, beta[b]) - beta[a], 0.0)
        likely = np.exp(logp)
        total = np.cumsum(likely)
        new = np.append(True, a[1:] != a[:-1])
        begin = np.flatnonzero(new)
        before = np.repeat((total - likely)[begin], np.diff(np.append(begin, len(a))))
        cdf = np.minimum(np.rint((total - before) / GRID) * GRID, 1.0)
        cdf[np.append(new[1:], True)] = 1.0
        self.ready()
        first = self.nodes
        more = (cdf, np.where(last, -1, b + first), ids, logp, a + first, begin + len(self.arrays[0]))
        for k, new in enumerate(more):  # one by one, so that no two copies of all are held
            self.arrays[k] = np.concatenate([self.arrays[k], new.astype(self.arrays[k].dtype)])
        self.nodes += n
        self.base.update(zip(itertools.compress(us, simple.tolist()), (first + np.cumsum(sizes) - sizes).tolist()))

    def starts(self, us: list[str]) -> np.ndarray:
        """The first nodes of units."""
        new = list(set(us).difference(self.base))
        if new:
            self.add_all(new)
        return np.fromiter(map(self.base.__getitem__, us), np.int64, len(us))

    def ready(self) -> list[np.ndarray]:
        """The arrays, with all units added so far."""
        if self.new[0]:
            self.arrays = [np.concatenate([a, np.array(x, a.dtype)]) for a, x in zip(self.arrays, self.new)]
            self.new = ([], [], [], [], [], [])
        return self.arrays


def uniform(keys: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the arguments only: odd multiples of half a GRID step."""
    h = mix(at.astype(U64) * U64(0x9E3779B97F4A7C15) + (keys + U64((step * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)))
    return ((h >> U64(36)).astype(np.float64) + 0.5) * GRID


def walk(arrays, nodes: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw a path through each unit from the given nodes; (edges in order, edges of each unit). at, keys: what the draws depend on."""
    cdf, target, begin = arrays[0], arrays[1], arrays[5]
    who, step, seen = np.arange(len(nodes)), 0, []
    while len(who):
        e, u = begin[nodes], uniform(keys, at, step)
        on = np.flatnonzero(cdf[e] <= u)
        while len(on):
            e[on] += 1
            on = on[cdf[e[on]] <= u[on]]
        seen.append((who, e))
        nodes = target[e]
        more = nodes >= 0
        who, nodes, at, keys, step = who[more], nodes[more], at[more], keys[more], step + 1
    counts = np.zeros(len(seen[0][0]) if seen else 0, np.int64)
    for step, (who, _) in enumerate(seen):
        counts[who] = step + 1
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for step, (who, e) in enumerate(seen):
        out[first[who] + step] = e
    return out, counts


def arrivals(t, rates: np.ndarray, uniforms: np.ndarray) -> np.ndarray:
    """Log times of the next arrivals after log time t at log rates."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(rates), np.inf, np.logaddexp(t, np.log(-np.log(uniforms)) - rates))


def off(logp: np.ndarray) -> np.ndarray:
    """Log probability of not taking a step."""
    with np.errstate(divide="ignore"):
        return np.where(logp > -1e-12, -np.inf, np.log(-np.expm1(np.minimum(logp, 0))))


class Search:
    """The open sets of one text: the turn-offs of every drawn path, and what is left at nodes used twice."""

    def __init__(self):
        self.paths: list[tuple] = []  # edges, units, log probability before each step, arrival times of the turn-offs
        self.least: list[tuple[float, int]] = []
        self.rests: list[tuple] = []
        self.out: list[tuple] = []

    def push(self, edges, owner, before, times, logp, t):
        self.paths.append((edges, owner, before, times))
        self.least.append(self._least(times))
        self.out.append((edges, logp, t))

    @staticmethod
    def _least(times):
        i = int(times.argmin()) if len(times) else 0
        return (float(times[i]) if len(times) else math.inf, i)

    def next_time(self) -> float:
        return min([x[0] for x in self.least] + [r[0] for r in self.rests], default=math.inf)

    def pop(self):
        """(time, path, step, edges used at that node) of the set with the earliest arrival."""
        path = min(range(len(self.least)), key=lambda i: self.least[i][0])
        rest = min(self.rests, key=lambda r: r[0], default=None)
        if rest and rest[0] < self.least[path][0]:
            self.rests.remove(rest)
            return rest
        t, step = self.least[path]
        times = self.paths[path][3]
        times[step] = np.inf
        self.least[path] = self._least(times)
        return t, path, step, (int(self.paths[path][0][step]),)


def sample_many(arrays, texts: list[tuple[np.ndarray, int]], k: int) -> list[list[tuple]]:
    """For each text (first nodes of its units, key) up to k distinct (ids, log probability, Gumbel value, inclusion).

    Values are kept as log arrival times, the negated Gumbel values: a set with log rate r that is open from log time t on
    has its next arrival at log(exp(t) + E / exp(r)), E exponential.
    """
    _, _, ids, logp, _, _ = arrays
    searches = [Search() for _ in texts]
    key_of = np.array([key for _, key in texts], U64)
    tails: list[tuple] = []  # text, time, edges before, their units, first unit and nodes of what is to be drawn
    first = arrivals(-np.inf, np.zeros(len(texts)), uniform(key_of ^ U64(0xA5A5A5A5), np.zeros(len(texts), np.int64), 0))
    for d, (starts, _) in enumerate(texts):
        if len(starts):
            tails.append((d, float(first[d]), np.empty(0, np.int64), np.empty(0, np.int64), 0, starts))
    for turn in range(k):
        if not tails:
            break
        sizes = np.array([len(x[5]) for x in tails], np.int64)
        text = np.repeat([x[0] for x in tails], sizes)
        unit = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - np.array([x[4] for x in tails]), sizes)
        turn_key = U64((turn * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        drawn, counts = walk(arrays, np.concatenate([x[5] for x in tails]), unit, key_of[text] + turn_key)
        ends = np.cumsum(counts)[np.cumsum(sizes) - 1] if len(counts) else np.zeros(len(tails), np.int64)
        ends = np.where(sizes > 0, ends, 0)
        ends = np.maximum.accumulate(ends)
        owner = np.repeat(unit, counts)
        lp = logp[drawn]
        turn_off = off(lp)
        total = np.cumsum(lp) - lp
        per = np.diff(np.append(0, ends))
        which = np.repeat(np.arange(len(tails)), per)
        base = np.array([float(logp[x[2]].sum()) for x in tails])
        began = np.append(0, ends[:-1])
        head = np.where(per > 0, total[np.minimum(began, len(total) - 1)] if len(total) else 0.0, 0.0)
        before = total - head[which] + base[which]
        place = np.arange(len(drawn)) - np.repeat(began, per)
        who = np.array([x[0] for x in tails])[which]
        times = arrivals(np.array([x[1] for x in tails])[which], before + turn_off, uniform(key_of[who] + turn_key ^ U64(0x3C3C3C3C), place, 1))
        again: list[tuple] = []
        for i, (d, t, edges, units_, _, _) in enumerate(tails):
            x, y = int(began[i]), int(ends[i])
            s = searches[d]
            whole = np.concatenate([edges, drawn[x:y]])
            own = logp[edges]
            s.push(
                whole, np.concatenate([units_, owner[x:y]]), np.concatenate([np.cumsum(own) - own, before[x:y]]),
                np.concatenate([np.full(len(edges), np.inf), times[x:y]]), float(base[i] + lp[x:y].sum()), t,
            )
            if turn + 1 < k and math.isfinite(s.next_time()):
                again.append(_turn(arrays, s, d, texts[d], turn))
        tails = again
    out = []
    for s in searches:
        t = s.next_time()
        found = [(ids[e], lp, -when, 1.0 if not math.isfinite(t) else -math.expm1(-math.exp(min(lp + t, 700.0)))) for e, lp, when in s.out]
        out.append(found or [(np.empty(0, np.int32), 0.0, 0.0, 1.0)])
    return out


def _turn(arrays, s: Search, d: int, text: tuple, turn: int) -> tuple:
    """Pop the next set of a text: the path so far with the new step, and what remains to be drawn after it."""
    _, target, _, logp, node, begin = arrays
    starts, key = text
    t, path, step, used = s.pop()
    edges, owner, before, _ = s.paths[path]
    at = int(node[edges[step]])
    a, b = int(begin[at]), int(begin[at + 1]) if at + 1 < len(begin) else len(target)
    left = [e for e in range(a, b) if e not in used]
    weights = [math.exp(logp[e]) for e in left]
    u, v = uniform(np.full(2, key, U64) ^ U64(0x5C5C5C5C), np.arange(2), turn + 2).tolist()
    mark, pick = u * sum(weights), 0
    while pick < len(left) - 1 and mark >= weights[pick]:
        mark -= weights[pick]
        pick += 1
    e = left[pick]
    others = sum(weights) - weights[pick] if len(left) > 1 else 0.0
    if others > 0:
        rate = float(before[step]) + math.log(others)
        s.rests.append((float(np.logaddexp(t, math.log(-math.log(v)) - rate)), path, step, (*used, e)))
    unit, inside = int(owner[step]), int(target[e])
    nodes = starts[unit + 1 :] if inside < 0 else np.concatenate([[inside], starts[unit + 1 :]])
    return d, t, np.append(edges[:step], e), np.append(owner[:step], unit), unit + (inside < 0), nodes


def sample(arrays, starts: np.ndarray, key: int, k: int) -> list[tuple]:
    return sample_many(arrays, [(starts, key)], k)[0]


def row_key(value, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{0 if value is None else value}", seed)


def sample_segmentations(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, seed: int = 1, model: str = MODEL, alpha: float = 1.0) -> DataFrame:
    """A row for each document and sample: the other columns of `df`, then sample (from 1), ids, log_prob, gumbel, inclusion."""
    import pyarrow as pa

    name = _with_model(df, model)
    new = StructType.fromDDL("sample int, ids array<int>, log_prob double, gumbel double, inclusion double")
    keep = [f for f in df.schema.fields if f.name not in new.names]

    def run(batches):
        lattices = Lattices(Pieces(SparkFiles.get(name), alpha))
        for batch in sliced(batches):
            texts, keys = batch.column(text), batch.column(key)
            start = 0  # few texts at a time: the ids are many times their bytes
            while start < len(texts):
                rows, got, size, these = [], [], 0, []
                if len(lattices.arrays[0]) > MAX_EDGES:
                    lattices.clear()
                while start + len(these) < len(texts) and size < CHARS:
                    these.append(texts[start + len(these)].as_py() or "")
                    size += len(these[-1])
                own, counts = lattices.pieces.units(these)
                first = np.split(lattices.starts(own), np.cumsum(counts)[:-1])
                drawn = sample_many(lattices.ready(), [(f, row_key(keys[start + i].as_py(), seed)) for i, f in enumerate(first)], k)
                for row, found in enumerate(drawn, start):
                    for s in enumerate(found, 1):
                        rows.append(row)
                        got.append(s)
                start += len(these)
                sizes = np.cumsum([0] + [len(s[1][0]) for s in got]).astype(np.int32)
                flat = np.concatenate([s[1][0] for s in got]).astype(np.int32)
                part = batch.take(pa.array(rows))
                out = [part.column(f.name) for f in keep]
                out += [pa.array([s[0] for s in got], pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))]
                out += [pa.array([s[1][i] for s in got], pa.float64()) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in keep] + new.names)

    return small_batches(df).mapInArrow(run, StructType(keep + new.fields))


def _with_model(df: DataFrame, model: str) -> str:
    sc, name = df.sparkSession.sparkContext, os.path.basename(model)
    if name not in {os.path.basename(f) for f in sc.listFiles}:
        sc.addFile(model)
    return name


def encode(df: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """Append ids: the model's own segmentation, the one encoding without sampling (null and empty texts: no ids). The
    model itself turns U+2581 into a space and may merge white space; samples keep both."""
    name = _with_model(df, model)

    def make():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
        return lambda batch: {"ids": [sp.encode(t) if t else [] for t in batch.column(text).to_pylist()]}

    return append_columns(df, "ids array<int>", make)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Append text: what the ids stand for (null or no ids: the empty text). Ids outside the vocabulary are an error."""
    name = _with_model(df, model)

    def make():
        pieces = Pieces(SparkFiles.get(name))
        return lambda batch: {"text": [pieces.decode(x or ()) for x in batch.column(ids).to_pylist()]}

    return append_columns(df, "text string", make)
