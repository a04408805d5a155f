"""Substring dedup with repeated-phrase automata.

A window is 50 consecutive words; a word goes if a window that covers it also starts in a document with a smaller doc_id.

1. Every document posts anchors: of its 6-word phrases the smallest by hash in any stretch of 50 words, so equal windows
   share one. An anchor is confirmed as recurring if two documents post it; a batch posts each once, with its smallest
   and largest doc_id.
2. The recurring anchors go back to the documents that post them: as a table of anchors by document, broadcast if it is
   measured to be small and joined by shuffle otherwise, so there is one pass over the documents whatever their number,
   and nothing is gathered on the driver. Each batch is a shard: it compiles the recurring phrases of its documents into an
   Aho-Corasick automaton (over word numbers) and streams its documents through it, which locates every occurrence of
   every such phrase. The windows around the occurrences are judged inside the batch first; per window the smallest
   document is posted on.
3. Posts meet by window: each that isn't of the smallest document sends its place back. Places of a document are merged
   and its covered words removed.

Every group is a window's posts, at most one a batch, so a passage in a third of all documents loads no task.

Defined results: null texts have no words; rows with a null doc_id are returned unchanged and remove nothing; rows that
repeat a doc_id never remove each other's words; texts shorter than a window lose nothing. Where no word goes, the text
stays as it is; otherwise the kept words are joined by one space. Output columns replace columns of equal name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import BROADCAST_BYTES, U64, WordHash, append_columns, blobs, cut, grouped, mix, partitions, sha256_hex, sliced, small_batches, space_words, window_hashes

WINDOW = 50
PHRASE = 6


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    n = len(x) - width + 1
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:n], x[width - size : width - size + n])


def anchors(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all phrases, and the positions of those that are smallest in some window."""
    p = window_hashes(h, phrase)
    width = window - phrase + 1
    least = sliding(p, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    return p, np.flatnonzero(sliding(padded, width, np.maximum) == p)


def recurring(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(anchor) hashes that two documents or more post. docs: doc_id, text."""

    def post(batches):
        import pyarrow as pa

        words = WordHash()
        for batch in sliced(batches):
            found, owner = [], []
            for d, t in zip(batch.column("doc_id").to_pylist(), blobs(batch, "text")):
                w = space_words(t)
                if len(w) >= window:
                    p, at = anchors(words.of(w), window, phrase)
                    a = np.unique(p[at])
                    found.append(a)
                    owner.append(np.full(len(a), d, np.int64))
            if found:
                h, d = np.concatenate(found), np.concatenate(owner)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                first = np.append(True, h[1:] != h[:-1])
                last = np.append(first[1:], True)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(d[first]), pa.array(d[last])], names=["anchor", "lo", "hi"])

    posted = docs.mapInArrow(post, "anchor long, lo long, hi long")
    return posted.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("anchor")


def recurring_by_document(docs: DataFrame, known: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, mark, known): the recurring anchors of each document. docs: doc_id, text, mark."""

    def post(batches):
        import pyarrow as pa

        words = WordHash()
        for batch in sliced(batches):
            found, rows = [], []
            for i, t in enumerate(blobs(batch, "text")):
                w = space_words(t)
                if len(w) >= window:
                    p, at = anchors(words.of(w), window, phrase)
                    found.append(np.unique(p[at]))
                    rows.append(np.full(len(found[-1]), i))
            if found:
                rows = np.concatenate(rows)
                keys = [pa.array(batch.column(c).to_numpy()[rows]) for c in ("doc_id", "mark")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "mark", "anchor"])

    posted = docs.mapInArrow(post, "doc_id long, mark long, anchor long")
    return posted.join(known, "anchor").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("known"))


def automaton(phrases):
    """Aho-Corasick over sequences of word numbers; every phrase gives its length."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in phrases:
        out.add_word(p, len(p))
    out.make_automaton()
    return out


def located(batch_words: list, known: list[np.ndarray], window: int, phrase: int) -> list[np.ndarray]:
    """Starts of the windows of each document (word hashes) that hold a recurring phrase, found by the batch's automaton."""
    phrases, streams = set(), []
    for h, own in zip(batch_words, known):
        stream = None
        if len(h) >= window and len(own):
            p, at = anchors(h, window, phrase)
            at = at[np.isin(p[at], own)]
            if len(at):
                stream = tuple((h & U64(0x7FFFFFFF)).tolist())
                phrases.update(stream[i : i + phrase] for i in at.tolist())
        streams.append(stream)
    if not phrases:
        return [np.empty(0, np.int64)] * len(batch_words)
    shard = automaton(phrases)
    out = []
    for stream in streams:
        if stream is None:
            out.append(np.empty(0, np.int64))
            continue
        n = len(stream) - window + 1
        ends = np.fromiter((e for e, _ in shard.iter(stream)), np.int64)
        first, last = np.maximum(ends - window + 1, 0), np.minimum(ends - phrase + 1, n - 1)
        cover = np.zeros(n + 1, np.int64)
        ok = first <= last
        np.add.at(cover, first[ok], 1)
        np.add.at(cover, last[ok] + 1, -1)
        out.append(np.flatnonzero(np.cumsum(cover[:n]) > 0))
    return out


#: starts: pairs of the first and last of consecutive starts.
_PLACES = "doc_id long, mark long, starts binary"


def _rows(keys: list[np.ndarray], starts: np.ndarray) -> list[tuple]:
    """(doc_id, mark, runs of starts) of each document among places."""
    if not len(starts):
        return []
    d, m = keys
    order = np.lexsort((starts, m, d))
    d, m, s = d[order], m[order], starts[order].astype(np.int32)
    cuts = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (m[1:] != m[:-1])))
    return [(int(d[a]), int(m[a]), _runs(s[a:b]).tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(s)))]


def _runs(s: np.ndarray) -> np.ndarray:
    """First and last of every run of consecutive numbers in a sorted array."""
    new = np.append(True, s[1:] > s[:-1] + 1)
    return np.stack([s[new], s[np.append(new[1:], True)]], 1)


def repeated_places(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, bound: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, mark, starts): runs of windows of a document (mark: hash of its text) that a smaller doc_id has too."""
    spark = docs.sparkSession
    docs = small_batches(docs).where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = 4 * partitions(spark)
    marked = docs.withColumn("mark", F.xxhash64("text"))
    known = cut(recurring(docs, window, phrase))
    known = cut(recurring_by_document(marked, known, window, phrase))
    size = known.agg(F.sum(F.size("known") * 8 + 48)).first()[0] or 0
    # what a batch decides for itself must not change when a task runs again, so rows have a fixed order
    held = marked.join(F.broadcast(known), ["doc_id", "mark"]) if size <= bound else marked.join(known, ["doc_id", "mark"]).sortWithinPartitions("doc_id", "mark")
    posted = held.mapInArrow(_poster(window, phrase, n), "b int, h binary, doc_id binary, mark binary, starts binary")

    def judge(batches):
        for b, rows in grouped(batches, lambda b: b < 0):
            if b < 0:
                d, m, s = (np.frombuffer(x, t) for x, t in zip(rows[0][1:], (np.int64, np.int64, np.int32)))
            else:
                h, d, m, s = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((U64, np.int64, np.int64, np.int32)))
                order = np.lexsort((d, h))
                h, d, m, s = h[order], d[order], m[order], s[order]
                first = np.append(True, h[1:] != h[:-1])
                later = d > d[first][np.cumsum(first) - 1]
                d, m, s = d[later], m[later], s[later]
            if len(d):
                yield _table(_rows([d, m], s))

    places = posted.repartition(partitions(spark), "b").sortWithinPartitions("b").mapInArrow(judge, _PLACES)
    return places.groupBy("doc_id", "mark").agg(F.collect_list("starts").alias("starts"))


def _table(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "mark", "starts"])


def route(h: np.ndarray, starts: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Where windows meet: a hash of their smallest phrase. Equal windows share it, and so do about twenty neighbours, so
    the places of a document stay together."""
    return mix(sliding(window_hashes(h, phrase), window - phrase + 1, np.minimum)[starts])


def _poster(window: int, phrase: int, n: int):
    def post(batches):
        import pyarrow as pa

        words = WordHash()
        for batch in sliced(batches):
            known = [np.array(x, np.int64).view(U64) for x in batch.column("known").to_pylist()]
            hashes = [words.of(space_words(t)) for t in blobs(batch, "text")]
            starts = located(hashes, known, window, phrase)
            parts = [(window_hashes(h, window)[s], s, i, route(h, s, window, phrase)) for i, (h, s) in enumerate(zip(hashes, starts)) if len(s)]
            del hashes
            if not parts:
                continue
            h = np.concatenate([p[0] for p in parts])
            s = np.concatenate([p[1] for p in parts]).astype(np.int32)
            row = np.repeat([p[2] for p in parts], [len(p[1]) for p in parts])
            d = batch.column("doc_id").to_numpy()[row]
            m = batch.column("mark").to_numpy()[row]
            to = ((np.concatenate([p[3] for p in parts]) >> U64(32)) * U64(n)) >> U64(32)
            order = np.lexsort((s, d, h, to))
            h, d, m, s, to = h[order], d[order], m[order], s[order], to[order]
            first = np.append(True, h[1:] != h[:-1])
            least = d[first][np.cumsum(first) - 1]
            # of a document that has the window twice, or of rows with equal doc_id, all places go on
            on, later = d == least, d > least
            rows = [(-1 - int(d[later][0] % n), b"", d[later].tobytes(), m[later].tobytes(), s[later].tobytes())] if later.any() else []
            h, d, m, s, to = h[on], d[on], m[on], s[on], to[on]
            cuts = np.searchsorted(to, np.arange(n + 1))
            rows += [(b, h[x:y].tobytes(), d[x:y].tobytes(), m[x:y].tobytes(), s[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=["b", "h", "doc_id", "mark", "starts"])

    return post


def kept_mask(n: int, starts: list[bytes], window: int) -> np.ndarray:
    cover = np.zeros(n + 1, np.int64)
    for blob in starts:
        first, last = np.frombuffer(blob, np.int32).reshape(-1, 2).T
        np.add.at(cover, first, 1)
        np.add.at(cover, last + window, -1)
    return np.cumsum(cover[:n]) == 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Replace text by what is kept of it and append n_words, n_removed and kept_sha256 (of the kept words joined by a space)."""
    places = cut(repeated_places(docs, window, phrase, bound))
    size = places.agg(F.sum(F.expr("aggregate(starts, 48L, (a, x) -> a + length(x) + 16)"))).first()[0] or 0
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    plain = docs.select(*[F.col(c).alias(f"_d_{c}") for c in names])
    places = F.broadcast(places) if size <= bound else places
    joined = plain.withColumn("_m", F.xxhash64(F.col("_d_text").cast("string"))).join(
        places, (F.col("_d_doc_id") == F.col("doc_id")) & (F.col("_m") == F.col("mark")), "left"
    )

    def make():
        def work(batch):
            out = {"_kept": [], "n_words": [], "n_removed": [], "kept_sha256": []}
            for t, starts in zip(blobs(batch, "_d_text"), batch.column("starts").to_pylist()):
                words = space_words(t)
                n, kept = len(words), t
                if starts:
                    words = [words[i] for i in np.flatnonzero(kept_mask(n, starts, window)).tolist()]
                    kept = b" ".join(words)
                out["_kept"].append(None if kept is None else kept.decode())
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(sha256_hex(b" ".join(words)))
            return out

        return work

    done = append_columns(joined.drop("doc_id", "mark", "_m"), "_kept string, n_words bigint, n_removed bigint, kept_sha256 string", make)
    return done.select(*[F.col("_kept" if c == "text" else f"_d_{c}").alias(c) for c in names], "n_words", "n_removed", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is kept of their texts; n_chars, if there is one, follows the text."""
    done = dedup_substrings(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
