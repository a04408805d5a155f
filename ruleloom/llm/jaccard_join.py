"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles (64-bit hashes) in one global order: by rising document count, then by hash. Of two
sets with a similarity of at least the threshold, each overlap is at least t = ceil(threshold * size); so for every
l <= t both share at least l shingles among their first size - t + l.

1. Exact copies (equal texts) collapse to their smallest doc_id.
2. All shingles of all documents are counted. Only documents of whose shingles at least t occur elsewhere can have a
   partner. Batches post 32-bit fingerprints by ranges of hashes (a shingle that a batch holds twice goes once, without
   its documents) and get back a number for each document.
3. The shingles of these documents are counted again, exactly, which gives the order. Each document posts its prefix for
   l = 1, less the shingles that nobody else has. Equal shingles tie documents into families by stars: each poster to
   the smallest poster.
4. Families are verified in groups of bounded size. Each document lengthens its prefix by the estimated cost of its
   candidates, and two documents are compared exactly only if they share min(l, l') prefix shingles. Families beyond
   the bound are cut into blocks: all pairs inside blocks, then a few members of every block among each other, then
   everything that isn't in the family's largest component yet against all blocks; only pairs that are already connected
   are skipped, so no link between components can be lost and groups of copies cost no square of their size.
5. Verified links and copies give the components.

Defined results: null and wordless texts have an empty set and link with nothing; fewer words than a shingle make one
shingle of the whole sequence; rows with a null doc_id take no part in links and get a null component; rows that repeat
a doc_id are one node. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import SLICE_BYTES, U64, WordHash, append_columns, blobs, broadcast_if_small, cut, grouped, joined_steadily, partitions, sliced, small_batches, space_words, window_hashes
from ruleloom.llm.components import Forest, components

WIDTH = 5
PERCENT = 75
#: Largest group of documents, and of shingles, that one verification takes.
GROUP, GROUP_SHINGLES = 256, 2_000_000


class Shingler:
    def __init__(self, width: int = WIDTH):
        self.width, self.hash = width, WordHash()

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        words = space_words(text, lower=True)
        if not words:
            return np.empty(0, U64)
        h = self.hash.of(words)
        return np.unique(window_hashes(h, min(self.width, len(h))))


def least_overlap(n, percent: int = PERCENT):
    return (n * percent + 99) // 100


def _split(h: np.ndarray, n: int):
    """(bucket, slice) of sorted hashes; buckets are ranges of hashes."""
    cuts = np.append(np.searchsorted(h, np.array([(b << 64) // n for b in range(n)], U64)), len(h))
    return [(b, slice(int(x), int(y))) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]


def _batch(names: list[str], kinds: list, rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def _shingled(batches, width: int, limit: int = SLICE_BYTES):
    """(batch number, doc_ids, sets) of every batch; the number is unique in a stage."""
    from pyspark import TaskContext

    shingles = Shingler(width)
    for k, batch in enumerate(sliced(batches, limit)):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        if len(ids):
            yield TaskContext.get().partitionId() << 32 | k, ids, [shingles(t) for t in blobs(batch, "text")]


def active(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id) of the documents of whose shingles enough occur in another document too."""
    import pyarrow as pa

    spark = docs.sparkSession
    n = 4 * partitions(spark)
    names, kinds = ["b", "batch", "one", "per", "many"], [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def post(batches):
        for number, ids, sets in _shingled(batches, width):
            sizes = np.array([len(s) for s in sets], np.uint32)
            h = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            same = h[1:] == h[:-1]
            alone = ~(np.append(False, same) | np.append(same, False))
            local = np.bincount(owner[~alone], minlength=len(sets)).astype(np.uint32)
            rows = [(-1 - number % n, number, ids.astype(np.int64).tobytes(), sizes.tobytes(), local.tobytes())]
            for b, part in _split(h, n):
                low, whose, single = (h[part] & U64(0xFFFFFFFF)).astype(np.uint32), owner[part], alone[part]
                mine = np.argsort(whose[single], kind="stable")
                rows.append((b, number, low[single][mine].tobytes(), np.bincount(whose, single, len(sets)).astype(np.uint32).tobytes(), np.unique(low[~single]).tobytes()))
            del sets, h, owner
            yield _batch(names, kinds, rows)

    def reply(batches):
        for b, rows in grouped(batches, lambda b: b < 0):
            if b < 0:
                yield _batch(names[1:], kinds[1:], [tuple(rows[0])])
                continue
            ones = [np.frombuffer(r[1], np.uint32) for r in rows]
            many = [np.frombuffer(r[3], np.uint32) for r in rows]
            every = np.concatenate([*ones, *many, *many])
            _, at, times = np.unique(every, return_inverse=True, return_counts=True)
            again = times[at] > 1
            start, out = 0, []
            for r, one in zip(rows, ones):
                per = np.frombuffer(r[2], np.uint32)
                found = np.bincount(np.repeat(np.arange(len(per)), per), again[start : start + len(one)], len(per))
                out.append((r[0], b"", found.astype(np.uint32).tobytes(), b""))
                start += len(one)
            yield _batch(names[1:], kinds[1:], out)

    def decide(batches):
        for _, rows in grouped(batches):
            head = next(r for r in rows if r[0])
            ids, sizes = np.frombuffer(head[0], np.int64), np.frombuffer(head[1], np.uint32).astype(np.int64)
            total = np.zeros(len(ids), np.int64)
            for one, per, many in rows:
                total += np.frombuffer(many if one else per, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[(100 * total >= percent * sizes) & (sizes > 0)])], names=["doc_id"])

    ddl = "batch long, one binary, per binary, many binary"
    posted = docs.select("doc_id", "text").mapInArrow(post, "b int, " + ddl).repartition(partitions(spark), "b").sortWithinPartitions("b")
    return posted.mapInArrow(reply, ddl).repartition(partitions(spark), "batch").sortWithinPartitions("batch").mapInArrow(decide, "doc_id long").distinct()


def ordered_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, wanted, h, head): all shingles in the global order, the document's l, and the shared ones of its prefix for l = 1."""
    import pyarrow as pa

    spark = docs.sparkSession
    n = 4 * partitions(spark)
    names, kinds = ["b", "batch", "ids", "h", "n"], [pa.int32(), pa.int64(), *[pa.binary()] * 3]

    def post(batches):
        for number, ids, sets in _shingled(batches, width, SLICE_BYTES // 4):  # a row holds all sets of a slice
            rows = [(-1 - number % n, number, ids.astype(np.int64).tobytes(), np.concatenate(sets).tobytes(), np.array([len(s) for s in sets], np.uint32).tobytes())]
            h, times = np.unique(np.concatenate(sets), return_counts=True)
            rows += [(b, number, b"", h[s].tobytes(), times[s].astype(np.uint32).tobytes()) for b, s in _split(h, n)]
            yield _batch(names, kinds, rows)

    def reply(batches):
        for b, rows in grouped(batches, lambda b: b < 0):
            if b < 0:
                yield _batch(names[1:], kinds[1:], [tuple(rows[0])])
                continue
            parts = [np.frombuffer(r[2], U64) for r in rows]
            _, at = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(at, np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])).astype(np.int64)[at]
            start, out = 0, []
            for r, h in zip(rows, parts):
                t = total[start : start + len(h)]
                start += len(h)
                out.append((r[0], b"", h[t > 1].tobytes(), np.minimum(t[t > 1], 2**32 - 1).astype(np.uint32).tobytes()))
            yield _batch(names[1:], kinds[1:], out)

    def arrange(batches):
        for _, parts in grouped(batches):
            ids, every, sizes = next(r for r in parts if r[0])
            h = np.frombuffer(b"".join(r[1] for r in parts if not r[0]), U64)
            times = np.frombuffer(b"".join(r[2] for r in parts if not r[0]), np.uint32)
            order = np.argsort(h)
            h, times = h[order], times[order]
            rows, start = [], 0
            for d, size in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.uint32).tolist()):
                own = np.frombuffer(every, U64, size, 8 * start)
                start += size
                if not size:
                    continue
                count = np.ones(size, np.int64)
                if len(h):
                    at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                    count = np.where(h[at] == own, times[at], 1).astype(np.int64)
                o = np.lexsort((own, count))
                own, count = own[o], count[o]
                first = size - int(least_overlap(size, percent)) + 1
                rows.append((d, matches_wanted(size, count, percent), own.tobytes(), own[:first][count[:first] > 1].tobytes()))
            yield _batch(["doc", "wanted", "h", "head"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)

    ddl = "batch long, ids binary, h binary, n binary"
    posted = docs.select("doc_id", "text").mapInArrow(post, "b int, " + ddl).repartition(partitions(spark), "b").sortWithinPartitions("b")
    return posted.mapInArrow(reply, ddl).repartition(partitions(spark), "batch").sortWithinPartitions("batch").mapInArrow(arrange, "doc long, wanted int, h binary, head binary")


def star_links(sets: DataFrame) -> DataFrame:
    """(a, b): documents tied by an equal shingle of their prefixes, each to the smallest that has it."""

    def post(batches):
        import pyarrow as pa

        for batch in batches:
            heads = batch.column("head").to_pylist()
            h = np.frombuffer(b"".join(heads), np.int64)
            d = np.repeat(batch.column("doc").to_numpy(), [len(x) // 8 for x in heads])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d)], names=["h", "doc"])

    posted = sets.select("doc", "head").mapInArrow(post, "h long, doc long")
    least = posted.groupBy("h").agg(F.min("doc").alias("b"), F.max("doc").alias("last")).where("b <> last").drop("last")
    return posted.join(least, "h").where("doc <> b").select(F.col("doc").alias("a"), "b").distinct()


def matches_wanted(n: int, counts: np.ndarray, percent: int) -> int:
    """The l of a document: from 1 up, as long as a longer prefix lowers the estimated cost.

    The prefix is paid once for every posting of its shingles (their document counts); the candidates that remain, about
    postings / l, are paid by a comparison of about n / 16 postings each.
    """
    t = int(least_overlap(n, percent))
    postings = np.cumsum(counts.astype(float))
    best, l = None, 1
    while l <= t:
        size = postings[min(n, n - t + l) - 1]
        cost = size + size / l * (1 + n / 16)
        if best is None or cost < best[0]:
            best = (cost, l)
        l *= 2
    return best[1] if best else 1


def links_among(ids: list, sets: list, wanted: list, percent: int, left: np.ndarray | None = None, known=None) -> Forest:
    """Join linked documents of a bounded group. left: only pairs with one of these; known: labels whose pairs are skipped."""
    m = len(ids)
    forest = Forest()
    sizes = np.array([len(s) for s in sets], np.int64)
    prefix = [s[: len(s) - int(least_overlap(len(s), percent)) + w] for s, w in zip(sets, wanted)]
    shared = overlaps(prefix)
    w = np.array(wanted)
    may = (shared >= np.minimum(w[:, None], w[None, :])) & (100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :]))
    may &= np.triu(np.ones((m, m), bool), 1)
    if left is not None:
        may &= left[:, None] | left[None, :]
    if known is not None:
        known = np.array(known)
        may &= known[:, None] != known[None, :]
    if not may.any():
        return forest
    rows, cols = np.nonzero(may)
    if len(rows) <= 4 * m:
        for i, j in zip(rows.tolist(), cols.tolist()):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                forest.join(ids[i], ids[j])
        return forest
    both = overlaps(sets)
    ok = may & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    for i, j in zip(*(x.tolist() for x in np.nonzero(ok))):
        forest.join(ids[i], ids[j])
    return forest


def overlaps(sets: list, columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 blocks over the shingles that two or more sets have."""
    m = len(sets)
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    twice = np.bincount(column)[column] > 1 if len(h) else new
    column, owner = column[twice], owner[twice]
    if not len(column):
        return np.zeros((m, m), np.int64)
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1
    out = np.zeros((m, m), np.int64)
    cuts = np.searchsorted(column, np.arange(0, column[-1] + columns + 1, columns))
    for x, y in zip(cuts[:-1], cuts[1:]):
        if y > x:
            block = np.zeros((m, int(min(columns, column[y - 1] - column[x] + 1))), np.float32)
            block[owner[x:y], column[x:y] - column[x]] = 1
            out += np.rint(block @ block.T).astype(np.int64)
    return out


_MEMBER = "g long, k int, doc long, side int, label long, wanted int, h binary"


def verified(members: DataFrame, percent: int, pivots: int = 0) -> DataFrame:
    """(a, b, h, wanted, g) links inside every group (g, k); with `pivots`, also so many members of its largest parts (b null)."""

    def run(batches):
        import pyarrow as pa

        def work(group):
            ids = [r[2] for r in group]
            sets = [np.frombuffer(r[6], U64) for r in group]
            left = np.array([r[3] == 1 for r in group])
            known = [r[4] for r in group] if group[0][4] is not None else None
            forest = links_among(ids, sets, [r[5] for r in group], percent, left if left.any() else None, known)
            out = [(x, forest.find(x), None, None, group[0][0]) for x in forest if forest.find(x) != x]
            if pivots:
                parts: dict[int, list[int]] = {}
                for i, x in enumerate(ids):
                    parts.setdefault(forest.find(x), []).append(i)
                for part in sorted(parts.values(), key=lambda p: (-len(p), ids[p[0]]))[:pivots]:
                    i = part[len(part) // 2]
                    out.append((ids[i], None, group[i][6], group[i][5], group[0][0]))
            return out

        def groups():
            group, key = [], None
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                    if row[:2] != key and group:
                        yield group
                        group = []
                    key = row[:2]
                    group.append(row)
            if group:
                yield group

        rows = []
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        for group in groups():
            rows += work(group)
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["a", "b", "h", "wanted", "g"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["a", "b", "h", "wanted", "g"])

    n = partitions(members.sparkSession)
    return members.select(*[c.split()[0] for c in _MEMBER.split(", ")]).repartition(n, "g", "k").sortWithinPartitions("g", "k").mapInArrow(run, "a long, b long, h binary, wanted int, g long")


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, group: int = GROUP, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(a, b) links that connect exactly the documents that similar pairs connect."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    worded = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    classes = worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last")
    copies = cut(worded.drop("text").join(broadcast_if_small(cut(classes), 32), ["k1", "k2"]).where("doc_id <> rep").distinct())
    keys = ["doc_id", "k1", "k2"]
    single = joined_steadily(worded, copies.drop("rep"), keys, "left_anti", 32, keys).drop("k1", "k2")
    copies = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    some = cut(active(single, width, percent))
    few = joined_steadily(single, some, ["doc_id"], "left_semi", 16, ["doc_id", "text"])
    sets = cut(ordered_sets(few, width, percent))
    family = broadcast_if_small(cut(components(star_links(sets))), 24)
    sets = sets.join(family, F.col("doc") == F.col("node")).select(F.col("component").alias("g"), "doc", "wanted", "h")
    total = sets.groupBy("g").agg(F.count("*").alias("m"), F.sum(F.length("h") / 8).alias("s"))
    blocks = total.select("g", F.greatest(F.ceil(F.col("m") / group), F.ceil(F.col("s") / group_shingles)).cast("int").alias("blocks"))
    blocks = cut(blocks)
    large = blocks.where("blocks > 1")
    plain = F.lit(None).cast("long").alias("label")
    deal = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = sets.join(broadcast_if_small(blocks, 16), "g").select("g", "blocks", deal.alias("k"), "doc", F.lit(0).alias("side"), plain, "wanted", "h")
    out = cut(verified(dealt.where("blocks = 1"), percent).select("a", "b"))  # no two Python functions in one stage
    if not large.isEmpty():
        pivots = max(1, min(4, group // 8))
        found = cut(verified(dealt.where("blocks > 1"), percent, pivots=pivots))
        out = out.union(found.where("b is not null").select("a", "b"))
        few = found.where("b is null").select("g", F.col("a").alias("doc"), "wanted", "h")
        # blocks' pivots meet in blocks of their own until one block holds them; this only saves work below, so it ends
        # as soon as it saves none
        left = None
        while True:
            parts = cut(few.groupBy("g").agg(F.count("*").alias("m"), F.ceil(F.greatest(F.count("*") / group, F.sum(F.length("h")) / 8 / group_shingles)).cast("int").alias("blocks")))
            held = parts.where("blocks > 1").agg(F.sum("m")).first()[0] or 0
            last = held == 0 or left is not None and 2 * held > left
            left = held
            dealt = few.join(broadcast_if_small(parts.drop("m"), 16), "g").select("g", deal.alias("k"), "doc", F.lit(0).alias("side"), plain, "wanted", "h")
            got = cut(verified(dealt, percent, pivots=0 if last else pivots))
            out = out.union(got.where("b is not null").select("a", "b"))
            if last:
                break
            few = got.where("b is null").join(broadcast_if_small(parts.where("blocks > 1").select("g"), 16), "g").select("g", F.col("a").alias("doc"), "wanted", "h")
        out = cut(out)
        label = cut(components(out))
        big = sets.join(broadcast_if_small(large, 16), "g").join(broadcast_if_small(label, 16), F.col("doc") == F.col("node"), "left")
        big = cut(big.select("g", "blocks", "doc", "wanted", "h", F.coalesce("component", "doc").alias("label")))
        sizes = big.groupBy("g", "label").agg(F.count("*").alias("m"))
        largest = sizes.groupBy("g").agg(F.max(F.struct("m", "label")).alias("x")).select("g", F.col("x.label").alias("main"))
        rest = big.join(largest, "g").where("label <> main").drop("main")
        many = rest.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / (group // 2)), F.ceil(F.sum(F.length("h")) / 8 / group_shingles)).cast("int").alias("lots"))
        many = cut(many)
        cross = big.join(broadcast_if_small(many, 16), "g").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        cross = cross.select("g", (F.col("lot") * F.col("blocks") + deal).cast("int").alias("k"), "doc", F.lit(0).alias("side"), "label", "wanted", "h")
        own = F.pmod(F.xxhash64("doc", F.lit(7)), F.col("lots")).cast("int")
        lone = rest.join(broadcast_if_small(many, 16), "g").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lone = lone.select("g", (own * F.col("blocks") + F.col("at")).cast("int").alias("k"), "doc", F.lit(1).alias("side"), "label", "wanted", "h")
        out = out.union(cut(verified(cross.union(lone), percent).select("a", "b")))
    return out.union(copies)


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, **bounds) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    part = cut(components(links(docs, width, percent, **bounds)))

    def make():
        shingles = Shingler(width)
        return lambda batch: {"n_shingles": [len(shingles(t)) for t in blobs(batch, "text")]}

    sized = append_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "n_shingles bigint", make).drop("text")
    part = broadcast_if_small(part, 16)
    return sized.join(part, sized.doc_id == part.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each component the rows with the smallest doc_id; rows with a null doc_id, and texts without words, stay.

    Of rows that repeat a doc_id all texts stay that are unlike, and one row of each text that they share: of equal texts
    the row that is smallest by its columns in their order."""
    part = cut(components(links(docs, width, percent)))
    gone = broadcast_if_small(part.where("node <> component").select(F.col("node").alias("_gone")), 16)
    kept = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    digest = F.xxhash64(F.col("text").cast("string"), F.lit(1))
    again = cut(kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again"), digest.alias("_digest")).count().where("count > 1").drop("count"))
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again, 24)
    on = (F.col("doc_id") == F.col("_again")) & (digest == F.col("_digest"))
    order = [F.col(f.name).cast("string") for f in docs.schema.fields]
    twice = kept.join(again, on, "left_semi")
    first = twice.groupBy("doc_id", digest.alias("_digest")).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("_row"))
    return kept.join(again, on, "left_anti").unionByName(first.select("_row.*"))
