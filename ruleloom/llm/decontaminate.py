"""Benchmark decontamination with suffix arrays over the training texts.

Each batch of documents is a shard. Its words become numbers (those of words that no test item has are all alike) and
the shard's suffix array is built over them: the start positions of all words that some test item has, sorted by the words
that follow, to the depth of a window. Every suffix of the test items is then binary-searched in every shard; the range of
equal prefixes gives all verbatim occurrences and their places, and runs of them the longest matches, of any length, with
their places. Test items are shipped in blocks of bounded size; a batch meets the blocks one after the other, and a
worker holds at most `HELD` of them, so neither a task nor a message grows with the test set. No shuffle takes place.

Defined results: null or wordless documents have no words and no hits; null or wordless items have no windows; an item
id that is null counts as "null"; repeated items count once an id; an empty test set marks nothing. Output columns
replace columns of equal name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import alnum_words, append_columns, blobs, sha256_hex

WINDOW = 13
#: A document is contaminated if its hit words are at least one in so many.
ONE_IN = 20
#: Bytes of test texts in a block (a block takes about thirty times as much), and blocks that a worker keeps.
BLOCK_BYTES, HELD = 2 << 20, 2

SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, matches array<struct<item: string, item_word: int, word: int, size: int>>"


class Block:
    """The searchable suffixes of some test items: one key of `width` vocabulary numbers for each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.ids = sorted({i for i, _ in items})
        order = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        seen = self.vocabulary
        rows, sizes, item, start = [], [], [], []
        for name, words in items:
            numbers = [seen.setdefault(w, len(seen) + 1) for w in words]
            size = min(width, len(numbers))
            for j in range(len(numbers) - size + 1):
                rows.append(numbers[j : j + size] + [0] * (width - size))
                sizes.append(size)
                item.append(order[name])
                start.append(j)
        rows = np.array(rows, np.uint32).reshape(-1, width)
        self.sizes, self.item, self.start = (np.array(x, np.int32) for x in (sizes, item, start))
        self.low = keys(rows)
        rows[np.arange(width) >= self.sizes[:, None]] = 2**32 - 1
        self.high = keys(rows)

    def search(self, numbers: np.ndarray):
        """(window, position) of every occurrence in a shard; `numbers` ends with `width` zeros."""
        n = len(numbers) - self.width
        if n <= 0 or not len(self.low):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(numbers[:n])
        order, suffixes = suffix_array(numbers, at, self.width)
        at = at[order]
        left, right = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        count = right - left
        window = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return window, at[left[window] + inside]


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings that sort like the rows."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.empty(0, f"S{4 * rows.shape[1]}")


def suffix_array(numbers: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at the given places by their first `width` numbers, and these as sorted keys.

    Most suffixes differ in their first words: they are sorted by two numbers at a time, and only those that are equal so
    far by the next two."""
    first = numbers[at] << 32 | numbers[at + 1]
    order = np.argsort(first, kind="stable")
    first = first[order]
    places = np.arange(len(at))
    new = np.append(True, first[1:] != first[:-1])[: len(at)]
    group = np.maximum.accumulate(np.where(new, places, 0)) if len(at) else places  # the place where a suffix's equals begin
    for depth in range(2, width, 2):
        same = group[1:] == group[:-1]
        k = np.flatnonzero((np.append(same, False) | np.append(False, same))[: len(at)])
        if not len(k):
            break
        own = at[order[k]]
        more = numbers[own + depth] << 32
        if depth + 1 < width:
            more |= numbers[own + depth + 1]
        by = np.lexsort((more, group[k]))
        order[k] = order[k][by]
        more, held = more[by], group[k]
        new = np.append(True, (held[1:] != held[:-1]) | (more[1:] != more[:-1]))
        group[k] = k[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    return order, keys(numbers[at[order][:, None] + np.arange(width)])


def longest(window: np.ndarray, at: np.ndarray, block: Block) -> list[tuple[int, int, int, int]]:
    """Join occurrences that continue each other: (item, item word, position, words)."""
    out: dict[tuple[int, int], list[int]] = {}
    for w, p in sorted(zip(window.tolist(), at.tolist()), key=lambda x: (x[1], x[0])):
        i, j, size = int(block.item[w]), int(block.start[w]), int(block.sizes[w])
        run = out.pop((i, j - 1, p - 1), None)
        out[(i, j, p)] = [i, run[1], run[2], run[3] + 1] if run else [i, j, p, size]
    return [tuple(x) for x in out.values()]


def forget(block) -> None:
    """Let a worker drop a broadcast value; it is read again when it is used again."""
    if hasattr(block, "_value") and hasattr(block, "_path"):
        del block._value


def blocks_of(benchmark: DataFrame, width: int, bound: int) -> list:
    """Broadcast blocks of test items, each at most `bound` bytes of text."""
    sc = benchmark.sparkSession.sparkContext
    out, items, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("binary").alias("t")).distinct()
    for row in rows.toLocalIterator(prefetchPartitions=False):
        words = alnum_words(row.t)
        if words:
            items.append((row.i, words))
            size += len(row.t)
        if size >= bound:
            out.append(sc.broadcast(Block(items, width)))
            items, size = [], 0
    if items:
        out.append(sc.broadcast(Block(items, width)))
    return out


def search_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WINDOW, bound: int = BLOCK_BYTES) -> DataFrame:
    """Append the word count, hit words, items and the longest matches (item, word in the item, word in the document, words)."""
    blocks = blocks_of(benchmark, width, bound)

    def make():
        def work(batch):
            texts = blobs(batch, text)
            words = [alnum_words(t) for t in texts] if len(blocks) > 1 else None
            sizes = items = matches = cover = None
            for block in blocks:
                b = block.value
                get = b.vocabulary.get
                parts, lengths = [], []
                for k, t in enumerate(texts):
                    w = words[k] if words is not None else alnum_words(t)
                    lengths.append(len(w))
                    parts.append(np.fromiter(map(get, w, (0,) * len(w)), np.int64, len(w)))
                    parts.append(np.zeros(1, np.int64))
                numbers = np.concatenate([*parts, np.zeros(width, np.int64)])
                if sizes is None:
                    sizes = np.array(lengths, np.int64)
                    first = np.cumsum(sizes + 1) - sizes - 1
                    cover = np.zeros(len(numbers) + 1, np.int64)
                    items, matches = [set() for _ in texts], [[] for _ in texts]
                window, at = b.search(numbers)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + b.sizes[window], -1)
                doc = np.searchsorted(first, at, "right") - 1
                for d, i in np.unique(np.stack([doc, b.item[window]]), axis=1).T.tolist():
                    items[d].add(b.ids[i])
                for i, j, p, size in longest(window, at, b):
                    d = int(np.searchsorted(first, p, "right")) - 1
                    matches[d].append({"item": b.ids[i], "item_word": j, "word": int(p - first[d]), "size": size})
                if len(blocks) > HELD:
                    forget(block)
            if sizes is None:
                return {"n_words": [len(alnum_words(t)) for t in texts], "n_hit": [0] * len(texts), "n_items": [0] * len(texts), "items": [[]] * len(texts), "matches": [[]] * len(texts)}
            hit = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
            return {
                "n_words": sizes,
                "n_hit": hit[first + sizes] - hit[first],
                "n_items": [len(x) for x in items],
                "items": [sorted(x) for x in items],
                "matches": matches,
            }

        return work

    return append_columns(docs, SCHEMA, make)


def contaminated(width_words: str = "n_words", hit: str = "n_hit", one_in: int = ONE_IN):
    return (F.col(hit) > 0) & (one_in * F.col(hit) >= F.col(width_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    plain = docs.select(*[F.col(c).alias(f"_d_{c}") for c in docs.columns])
    found = search_documents(plain, benchmark, text="_d_text")
    return found.where(~contaminated()).select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])


def items_digest():
    return F.sha2(F.array_join("items", ",").cast("binary"), 256)


def matches_digest():
    """Of the longest matches as item:word in the item:word:words, sorted as strings and joined by commas."""
    one = F.transform("matches", lambda m: F.concat_ws(":", m["item"], m["item_word"], m["word"], m["size"]))
    return F.sha2(F.array_join(F.array_sort(one), ",").cast("binary"), 256)
