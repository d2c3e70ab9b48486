"""What several operators of this package share: scratch tables and word hashing.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  Hashes are 64-bit values
computed for a whole chunk of documents at once; they are equal on every machine.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that one vectorised step takes (a longer document is a step of its own).
CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5


class Scratch:
    """Intermediate tables in the folder that all executors share.

    cut() writes a DataFrame and reads it again, so that a lost executor costs no
    more than the reading; drop() deletes tables which later steps do not read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            # a folder of this machine serves where all tasks run on it, as in tests
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="postsieve-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._postsieve_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_postsieve_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and the n + 1 bounds of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(bounds: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most `limit` bytes, or of one row."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = max(first + 1, last)
        yield first, last
        first = last


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | U64(1)


_BYTE = _table(11, 256)
_BASE = int(_table(12, 1)[0]) * 2 + 1 & 2**64 - 1
_UNBASE = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        x = np.full(n, base, U64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(_BASE), of(_UNBASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (plus one) the number of its first word."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = ~SPACE[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[1:-1] = solid[:-1] & solid[1:]
    inner[bounds] = False
    starts = np.flatnonzero(solid & ~inner[:-1])
    ends = np.flatnonzero(solid & ~inner[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, U64)
    size = 1 << max(10, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, for each start."""
    if len(words) < n:
        return np.zeros(0, U64)
    h = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        h *= U64(0x9E3779B97F4A7C15)
        h += words[j : len(words) - n + 1 + j]
    return mix(h)


def documents_words(column: pa.Array, lower: bool):
    """For each step: its first row and the list of each row's word hashes."""
    data, bounds = text_bytes(column)
    for first, last in steps(bounds):
        part = data[bounds[first] : bounds[last]]
        own = bounds[first : last + 1] - bounds[first]
        if lower:
            part = LOWER[part]
        starts, ends, at = word_spans(part, own)
        hashes = word_hashes(part, starts, ends)
        yield first, [hashes[at[i] : at[i + 1]] for i in range(last - first)]


def shingle_set(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of the whole text if it has fewer words."""
    if len(words) == 0:
        return np.zeros(0, U64)
    return np.unique(gram_hashes(words, min(n, len(words))))


def split(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal stretches of solid bytes as binary values, none across rows, and the rows' n + 1 bounds in them."""
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts, inside = np.flatnonzero(solid & ~before), np.cumsum(solid, dtype=np.int64)
    at = np.append(inside[starts] - 1, inside[-1] if len(inside) else 0).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[solid])]), np.searchsorted(starts, bounds)
