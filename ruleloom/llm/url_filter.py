"""URL filters by a sorted digest array.

Entries (host, path, verdict) become 64-bit xxhash keys of `host + path`, sorted by Spark and written to one file in the
shared folder, beside their full strings. The file goes to every executor once (SparkContext.addFile) and is
memory-mapped, so all Python workers of an executor share its pages and a replacement executor fetches it again. A URL is
probed with every host suffix times every path length that occurs among the entries, by one vectorised binary search a
batch; equal keys are confirmed on the stored strings, so collisions change nothing. A list is a DataFrame or a Python
list; its size is measured, and lists beyond `max_bytes` are joined by shuffle instead.

Defined results: null URLs and URLs without `://` have an empty host and path, fit no entry and are allowed; repeated
rows are judged each; an empty list allows everything; list rows with a null host, path or verdict fit nothing, and of rows that give one
string two verdicts block wins. Of several rules that fit, the longest string wins, of equally
long ones that with the longer host. Rules come before listed entries. Output columns replace columns of equal name.
"""

from __future__ import annotations

import os
import uuid
from array import array

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import U64, append_columns, ascii_lower, shared_dir

#: Bytes of entries, 32 each beside their strings, that are shipped as a file.
MAX_BYTES = 256 << 20
#: xxhash64 of a column has this seed.
SEED = 42

#: Rules of the standing policy: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Hosts that the method itself blocks where no rule fits: an example list. Give your own as a DataFrame of host, path, verdict.
LISTED_HOSTS = ("adult-x", "casino-win", "free-bets", "spam-farm")
LISTED_ZONES = ("example.com", "example.net", "example.org")
LISTED = [(f"{host}.{zone}", "", "block") for host in LISTED_HOSTS for zone in LISTED_ZONES]


def host_of(url):
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def packed(rows) -> bytes:
    """The digest array of (string, host length, is rule, is block) rows sorted by unsigned key."""
    keys, ends, flags, text, lengths = array("Q"), array("Q", [0]), bytearray(), bytearray(), set()
    for s, host, rule, block in rows:
        raw = s.encode()
        keys.append(xxhash.xxh64_intdigest(raw, SEED))
        text += raw
        ends.append(len(text))
        flags.append(rule | block << 1)
        lengths.add(len(s) - host)
    head = array("Q", [len(keys), len(text)])
    return b"".join([head.tobytes(), keys.tobytes(), ends.tobytes(), bytes(flags), bytes(text), array("Q", sorted(lengths)).tobytes()])


def entries_of(spark: SparkSession, rules, listed) -> DataFrame:
    """(s, h, is_rule, v): one row a string and kind of list. rules, listed: DataFrames of host, path, verdict, or lists of such rows."""
    out = None
    for is_rule, group in ((0, listed), (1, rules)):
        df = group if isinstance(group, DataFrame) else spark.createDataFrame(list(group), "host string, path string, verdict string")
        one = df.where("host is not null and path is not null and verdict in ('allow', 'block')").select(
            F.concat("host", "path").alias("s"), F.length("host").alias("h"), F.lit(is_rule).alias("is_rule"), F.col("verdict").alias("v")
        )
        out = one if out is None else out.union(one)
    return out.groupBy("s", "is_rule").agg(F.max(F.struct("v", "h")).alias("x")).select("s", F.col("x.h").alias("h"), "is_rule", F.col("x.v").alias("v"))


def write_index(entries: DataFrame) -> str:
    """Write the digest array to the shared folder; the file is named by its content, so equal lists share one file."""
    spark = entries.sparkSession
    key = F.xxhash64("s")
    rows = entries.orderBy(key < 0, key, "s", "is_rule").toLocalIterator()
    data = packed((r.s, r.h, r.is_rule, r.v == "block") for r in rows)
    name = f"urls-{xxhash.xxh3_128_hexdigest(data)}.bin"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/url-lists/{x}")
    fs = path(name).getFileSystem(conf)
    if not fs.exists(path(name)):
        part = f"{name}.{uuid.uuid4().hex}"
        out = fs.create(path(part))
        try:
            for a in range(0, len(data), 1 << 20):
                out.write(bytearray(data[a : a + (1 << 20)]))
        finally:
            out.close()
        fs.rename(path(part), path(name))
    return fs.makeQualified(path(name)).toString()


class DigestArray:
    """The memory-mapped file: sorted keys, string offsets, flags, strings."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, size = (int(x) for x in raw[:16].view(U64))
        at = 16
        self.keys = raw[at : at + 8 * n].view(U64)
        at += 8 * n
        self.offsets = raw[at : at + 8 * (n + 1)].view(U64)
        at += 8 * (n + 1)
        self.flags = raw[at : at + n]
        at += n
        self.text = raw[at : at + size]
        self.lengths = [int(x) for x in np.frombuffer(raw[at + size :].tobytes(), U64)]

    def string(self, i: int) -> bytes:
        return self.text[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def probe(self, strings: list[bytes]) -> list[tuple[int, int]]:
        """(position in strings, entry) for every confirmed string."""
        if not strings or not len(self.keys):
            return []
        keys = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), U64, len(strings))
        at = np.searchsorted(self.keys, keys)
        there = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        found = []
        for k in there:
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == keys[k]:
                if self.string(i) == strings[k]:
                    found.append((int(k), i))
                i += 1
        return found


def candidates(host: str, path: str, lengths: list[int]):
    """(string, host length) of every entry that could fit."""
    while True:
        for n in lengths:
            if n <= len(path):
                yield host + path[:n], len(host)
        dot = host.find(".")
        if dot < 0:
            return
        host = host[dot + 1 :]


def judge_batch(index: DigestArray, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    strings, meta = [], []
    for row, (host, path) in enumerate(zip(hosts, paths)):
        if host:
            for s, h in candidates(host, path, index.lengths):
                strings.append(s.encode())
                meta.append((row, len(s), h, s))
    best: dict[int, tuple] = {}
    for k, i in index.probe(strings):
        row, size, h, s = meta[k]
        flag = int(index.flags[i])
        best[row] = max(best.get(row, (-1,)), (flag & 1, size, h, s, flag >> 1))
    rules = [best[r][3] if r in best and best[r][0] else None for r in range(len(hosts))]
    verdicts = ["block" if r in best and best[r][4] else "allow" for r in range(len(hosts))]
    return rules, verdicts


def filter_urls(df: DataFrame, rules=RULES, listed=LISTED, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Append host, path, rule (null where none fits) and verdict to every row of `df`."""
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    entries = entries_of(df.sparkSession, rules, listed)
    if (entries.agg(F.sum(F.octet_length("s") + 32)).first()[0] or 0) > max_bytes:
        return _joined(df, entries)
    sc = df.sparkSession.sparkContext
    path = write_index(entries)
    name = os.path.basename(path)
    if name not in {os.path.basename(f) for f in sc.listFiles}:
        sc.addFile(path)

    def make():
        index = DigestArray(SparkFiles.get(name))

        def work(batch):
            rule, verdict = judge_batch(index, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            return {"rule": rule, "verdict": verdict}

        return work

    return append_columns(df, "rule string, verdict string", make)


def _joined(df: DataFrame, entries: DataFrame) -> DataFrame:
    """The same judgement for lists too large to ship: candidates and entries meet by string in a shuffle."""
    found = entries.select((F.length("s") - F.col("h")).alias("n")).distinct().collect()  # no more than the longest path has characters
    lengths = F.array(*[F.lit(r.n) for r in found]).cast("array<int>")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    cands = (
        keyed.where("host <> ''")
        .select("_row", F.explode(suffixes).alias("_h"), "path")
        .select("_row", "_h", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("_n"), "path")
        .select("_row", F.concat("_h", F.expr("substring(path, 1, _n)")).alias("s"))
    )
    best = cands.join(entries, "s").groupBy("_row").agg(F.max(F.struct("is_rule", F.length("s").alias("size"), "h", "s", "v")).alias("_b"))
    out = keyed.join(best, "_row", "left")
    return out.withColumns(
        {"rule": F.when(F.col("_b.is_rule") == 1, F.col("_b.s")), "verdict": F.coalesce(F.col("_b.v"), F.lit("allow"))}
    ).drop("_row", "_b")
