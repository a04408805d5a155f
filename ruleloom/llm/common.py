"""Pieces the corpus operators share: reading, word splitting, hashing, shared folders, checked joins."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was measured to be at most this large.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Byte table: lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(
    ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

U64 = np.uint64
_K = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary folder serves in
    local mode (tests); on a cluster that is an error, as executors couldn't see it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ruleloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised table for broadcasting if its counted rows fit the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= bound else df


def alnum_words(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None, lower: bool = False) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ (bytes.split knows exactly these six separators)."""
    return (text.lower() if lower else text).split() if text else []


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive word hashes, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out, done, level, size = None, 0, mix(h), 1
    while True:
        if width & size:
            part = level[done : done + n]
            out = part.copy() if out is None else mix(out * _K + part)
            done += size
        if done == width:
            return out
        level = mix(level[:-size] * _K + level[size:] + U64(size))
        size *= 2


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def append_columns(df: DataFrame, ddl: str, make) -> DataFrame:
    """Append the columns of `ddl`, computed batch by batch in Arrow form; all other columns pass through untouched.

    make() runs once a task and returns batch -> {column: list or array}. A column of `df` with the name of a new one is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(ddl)
    keep = [f for f in df.schema.fields if f.name not in set(new.names)]
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]
    names = [f.name for f in keep]

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in sliced(batches):
            got = work(batch)
            arrays = [batch.column(n) for n in names]
            arrays += [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], type=t) for n, t in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in kinds])

    return small_batches(df).mapInArrow(run, StructType(keep + new.fields))


#: Rows of an Arrow batch. Spark sizes its buffers by whole batches, and rows here are texts.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """See that the session passes no larger Arrow batches than BATCH_ROWS to Python."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


#: Bytes of an Arrow batch that a task works on at a time. Rows that tasks post are as large, and small rows spare the JVM's heap.
SLICE_BYTES = 1 << 20


@functools.cache
def _libc(kept: int = 4 << 20):
    """The C library, told to keep freed arrays of up to `kept` bytes in the process, so that numpy's temporary arrays aren't
    given back to the system and faulted in anew at each step; None where it lacks the setting."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        for setting in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(setting, kept)
        libc.malloc_trim(0)
        return libc


def start_lean() -> None:
    """Give back what earlier tasks of a reused worker left, and keep small arrays from now on."""
    if libc := _libc():
        gc.collect()
        libc.malloc_trim(0)


def sliced(batches, limit: int = SLICE_BYTES):
    """The batches in slices of about `limit` bytes, so that a task's memory doesn't follow the length of the texts."""
    start_lean()
    for batch in batches:
        step = max(1, batch.num_rows // max(1, -(-batch.nbytes // limit)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def grouped(batches, passing=lambda key: False):
    """(value of the first column, rows of the other columns) of neighbouring rows with the same first column, which sorted
    partitions have together; a group is held, the partition isn't. Rows with a passing key come one by one."""
    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if rows and k != key:
                yield key, rows
                rows = []
            if passing(k):
                yield k, [row]
            else:
                key = k
                rows.append(row)
    if rows:
        yield key, rows


def joined_steadily(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int, order: list[str]) -> DataFrame:
    """A join whose rows come in the same order whenever a task runs again: of a broadcast, in the order of the left side's
    files, otherwise sorted. Needed where what a task makes is numbered by the order of its rows."""
    small = right.count() * row_bytes <= BROADCAST_BYTES
    out = left.join(F.broadcast(right) if small else right, on, how)
    return out if small else out.sortWithinPartitions(*order)


def blobs(batch, name: str) -> list:
    """A text column of an Arrow batch as bytes objects (None stays)."""
    import pyarrow as pa

    col = batch.column(name)
    return (col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col).to_pylist()
