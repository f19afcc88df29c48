"""Helpers shared by the training-data operators: shared-folder tables and vectorised byte hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local default in local mode (tests), an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or "file:///tmp/checkpoints/veilspark"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # shuffle files of what was just written go once nothing refers to them
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: rows that hold whole texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable) -> Callable:
    """A function over batches that hands freed memory back to the system at its end, as the worker stays for later tasks."""

    @wraps(run)
    def inner(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            release()

    return inner


def release() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """Schema of ``df`` followed by the fields of ``ddl``."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: F.Column) -> F.Column:
    """UTF-8 bytes of a string column, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply rounds); wraps modulo 2**64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_POW: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls, doubled when too short."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, U64)
        out[0], k = 1, 1
        while k < size:
            out[k : 2 * k] = out[:k] * U64(pow(base, k, 1 << 64))
            k *= 2
        _POW[base] = have = out
    return have[:n]


class Rolling:
    """Polynomial fingerprints modulo 2**64 of any byte range of one buffer, by prefix sums and the inverse of an odd base."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        self.inverse = powers(len(data) + 1, pow(base, -1, 1 << 64))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data), base) if len(data) else data.astype(U64), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(((self.sums[end] - self.sums[start]) * self.inverse[start]) ^ (np.asarray(end - start).astype(U64) << U64(40)))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def pieces(frame: pd.DataFrame, *columns: str, limit: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Runs of rows of ``frame`` with about ``limit`` characters in the text columns, so that whole-array steps stay small."""
    size = sum(frame[c].str.len().fillna(0).astype(np.int64) for c in columns)
    part = ((size.cumsum() - size) // limit).to_numpy()
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
        if b > a:
            yield frame.iloc[a:b]


# Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_ENDS = np.zeros(256, bool)
WORD_ENDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_TABLE_AT = 64
SLICE = 1 << 20


def _word_table(seed: int) -> np.ndarray:
    """Random values for the bytes at the first places of a word, drawn from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 1 << 64, _TABLE_AT * 256, U64)


_WORD_TABLES = (_word_table(64), _word_table(65))


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each word data[ws:we]: the sum of random values of its bytes at their places, and the length, mixed. Texts are read in
    slices, so that a long one takes no more memory than its bytes."""
    out, values = np.zeros(len(ws), U64), _WORD_TABLES[which]
    for a in range(0, len(data), SLICE):
        b = min(len(data), a + SLICE)
        i, j = np.searchsorted(we, a, side="right"), np.searchsorted(ws, b, side="left")
        if i == j:
            continue
        s, e = np.maximum(ws[i:j], a), np.minimum(we[i:j], b)
        size = e - s
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(s - ends + size, size)
        place = at - np.repeat(ws[i:j], size)
        part = values[((place & (_TABLE_AT - 1)) << 8) | data[at]]
        far = np.flatnonzero(place >= _TABLE_AT)
        if len(far):
            part[far] = mix(part[far] + (place[far] // _TABLE_AT).astype(U64) * U64(_BASE))
        out[i:j] += np.add.reduceat(part, ends - size)
    return mix(out ^ ((we - ws).astype(U64) << U64(40)))


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run without word ends) of a byte buffer."""
    inside = np.concatenate([[False], ~WORD_ENDS[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]
