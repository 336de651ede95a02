"""What the corpus operators share: table access, materialised tables, and byte-level text kernels.

The kernels work on whole Arrow batches as numpy arrays; they never loop over characters in Python.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; a batch of documents stays at a few MB.
BATCH_ROWS = 400

#: Words are maximal runs of bytes other than these (space, tab, LF, VT, FF, CR).
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Keys that a counting task holds before it merges them or sends them on.
HELD = 4_000_000

#: Bytes of text whose words are hashed at a time.
HASHED = 1 << 19

WORD = r"[^\x20\x09-\x0D]+"

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the folder, pruned to the columns asked for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a single machine where it is unset, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="cladeframe-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again; later stages start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % modulus == remainder


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each text begins (n + 1 offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and text number of every word; no word crosses texts."""
    inside = ~_IS_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased: a polynomial over the bytes, taken from running sums.

    Words are hashed in runs of about HASHED bytes, so memory does not grow with the text; where a run begins makes no
    difference to a hash."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, side="right")))
        begin, end = starts[at], ends[upto - 1]
        up, down = _power_tables(int(end - begin) + 1)
        run = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[data[begin:end]]] * up[: end - begin], out=run[1:])
        some, size = starts[at:upto] - begin, ends[at:upto] - starts[at:upto]
        out[at:upto] = mix((run[some + size] - run[some]) * down[some] + size.astype(np.uint64))
        at = upto
    return out


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(column: pa.Array, width: int = 5):
    """Per text: sorted distinct 64-bit hashes of its word shingles; a shorter text is one shingle, no word none."""
    data, bounds = text_bytes(column)
    starts, ends, owner = words(data, bounds)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(owner, np.arange(len(bounds)))
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * _STEP[k % 5] * np.uint64(2 * (k // 5) + 1)
    total = mix(total)
    for k in range(len(bounds) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= width:
            yield np.unique(total[a : b - width + 1])
        elif b > a:
            few = hashes[a:b]
            yield mix(np.array([(few * np.array(_STEP[: len(few)])).sum() + np.uint64(len(few) * 0x51_7C_C1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Counts:
    """Sums by key; never more than HELD keys beyond the distinct ones."""

    def __init__(self, dtype=np.int64):
        self.dtype, self.parts, self.size = dtype, [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        if len(keys):
            self.parts.append((keys.astype(self.dtype, copy=False), times.astype(np.int64, copy=False)))
            self.size += len(keys)
            if len(self.parts) > 1 and self.size > 2 * max(HELD, len(self.parts[0][0])):
                self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, at, np.concatenate([n for _, n in self.parts]))
            self.parts, self.size = [(keys, times)], len(keys)
        return self.parts[0] if self.parts else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
