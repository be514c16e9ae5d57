"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of one Arrow batch, so that a Python worker holds a few MB of text at a time.
BATCH_ROWS = 1024
#: Texts longer than this are cut into words piece by piece (whole, but never as one list).
LONG_TEXT = 4 << 20
#: Bytes of text whose words are looked at together, as arrays.
PART = 1 << 20


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and makes sure that checkpoint() has a folder.

    A cluster names its shared folder in spark.checkpoint.dir; a folder of our own is only set where that
    setting is missing and all tasks run in this process, as in tests. Elsewhere a missing setting is an error.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="factloom-"))
    return spark


def hashable(rows: DataFrame) -> list[Column]:
    """The columns as hash functions take them: those that hold maps or variants as JSON."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if re.search(r"map<|variant", f.dataType.simpleString()) else F.col(f"`{f.name}`") for f in rows.schema.fields]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder: it is computed once and survives a lost executor."""
    session(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle and checkpoint files of what is gone.

    Between rounds that shuffle much: with a large heap, a driver may not come to that by itself before disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_made: list[list[str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    path = f"{session(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def made_here() -> Iterator[list[str]]:
    """The paths that place() gives out meanwhile."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def removed(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet files in the shared checkpoint folder: as cut(), but compressed and with its statistics."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key with more rows than this is joined by sending what it joins with to every task.
HOT = 100_000


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str = "__n") -> DataFrame:
    """Inner join with right, which has one row a key and, in the column `rows`, how many rows of left have it.

    Rows of hot keys stay where they are. What goes to every task is at most one row of right for each HOT rows of left.
    """
    plain = right.drop(rows)
    if right.where(F.col(rows) > HOT).isEmpty():
        return left.join(plain, key)
    hot = F.broadcast(right.where(F.col(rows) > HOT).drop(rows))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) <= HOT).drop(rows), key)
    return left.join(hot, key).unionByName(cold)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def schema_with(rows: DataFrame, keep: Iterable[str], more: str) -> StructType:
    """The kept columns exactly as rows has them, and the columns that `more` declares."""
    return StructType([*(rows.schema[c] for c in keep), *StructType.fromDDL(more).fields])


def trimmed() -> None:
    """Gives what a Python worker has freed back to the system: workers are used again, by tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """mapInArrow with one state a task: make() runs once in each task and returns what maps each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, batch, out = make(), None, None
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out
        del step, batch, out
        trimmed()

    return df.mapInArrow(run, schema)


def binary_list(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def pieces(data: bytes, space: re.Pattern[bytes], size: int = LONG_TEXT) -> Iterator[bytes]:
    """data in pieces of about size bytes, cut where space matches, so that no word is divided."""
    at = 0
    while len(data) - at > size:
        found = space.search(data, at + size)
        if not found:
            break
        yield data[at : found.end()]
        at = found.end()
    yield data[at:] if at else data


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


#: Random odd factors of a byte's place in its word and of a word's place in a run.
_BYTES, RUN, RUN_TOO = _odd(1 << 12, 1), _odd(256, 2), _odd(256, 3)


class Words:
    """The words of texts, one text after another: where they begin and end in the folded bytes, their hashes and their texts."""

    def __init__(self, texts: list[bytes], fold: bytes) -> None:
        """fold: 256 bytes for all bytes, a blank for those between words."""
        self.data = b" ".join(texts).translate(fold)
        codes = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate(([False], codes != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        place = np.arange(len(codes))
        if len(self.starts):
            place[self.starts[0] :] -= np.repeat(self.starts, np.diff(np.append(self.starts, len(codes))))
        values = np.where(inside[1:-1], (codes.astype(np.uint64) + np.uint64(1)) * _BYTES[place & (len(_BYTES) - 1)], np.uint64(0))
        self.hashes = mix(np.add.reduceat(values, self.starts)) if len(self.starts) else np.empty(0, np.uint64)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(begins, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, begins)  # of each text, its first word; one more for the end

    def __len__(self) -> int:
        return len(self.starts)

    def said(self, first: int, n: int) -> list[bytes]:
        return self.data[self.starts[first] : self.ends[first + n - 1]].split()

    def runs(self, width: int, factors: np.ndarray = RUN) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the `width` words from each word on, and whether they are of one text."""
        n = max(0, len(self) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out += self.hashes[k : k + n] * factors[k]
        return mix(out), self.text[:n] == self.text[width - 1 : width - 1 + n]


def text_batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first text, and texts of about PART bytes together; a longer text comes by itself."""
    held, size, first = [], 0, 0
    for k, data in enumerate(binary_list(column)):
        if held and size + len(data or b"") > PART:
            yield first, held
            held, size, first = [], 0, k
        held.append(data or b"")
        size += len(held[-1])
    if held:
        yield first, held
