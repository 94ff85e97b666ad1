"""Helpers shared by the corpus operators: shared-folder tables, Arrow batches, vectorised text hashing."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch, shared_dir, sweep, written  # noqa: F401

#: Bytes of text hashed at once by one worker; a single longer text is still taken whole.
CHUNK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch while a table of this package is written.
BATCH_ROWS, BATCH_BYTES = 512, "8m"

_shipped: str | None = None


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = BATCH_BYTES):
    """Smaller Arrow batches while the block runs; the session's own settings stand again afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stash(df: DataFrame, *partition_by: str, path: str | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, "tables")
    with arrow_batches(spark, rows):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need not have it installed."""
    global _shipped
    app = spark.sparkContext.applicationId
    if _shipped != app:
        top = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(target := Path(tempfile.mkdtemp(prefix="shortlister-")) / f"{top.name}.zip", "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped = app


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most, whatever the session's own limit is."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory that its task has freed back to the system: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, taken: list[str]) -> str:
    """A column name like this one that no column has yet."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


# --- hashing -------------------------------------------------------------------------------------

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The separators of words: space and the control characters 09 to 0D; 1 in the table.
IS_SPACE = bytes(int(i == 0x20 or 9 <= i <= 13) for i in range(256))
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 256


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.frombuffer(raw.tobytes().translate(_LOWER), np.uint8)


class Words64:
    """Eight bytes from any place of an array of bytes as one number; zeros follow its end."""

    def __init__(self, raw: np.ndarray):
        padded = np.zeros((len(raw) >> 3) + 3 << 3, np.uint8)
        padded[: len(raw)] = raw
        self.raw, self.words = raw, padded.view("<u8")

    def at(self, places: np.ndarray) -> np.ndarray:
        word, shift = places >> 3, ((places & 7) << 3).astype(np.uint64)
        out = self.words[word] >> shift
        out |= (self.words[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return out

    def heads(self, starts: np.ndarray, n: int) -> np.ndarray:
        """The first n bytes, 8 at most."""
        return self.at(starts) & _KEEP[n]


def span_hashes(raw: np.ndarray | Words64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes start:end of an array, for many spans.

    Eight bytes at a time go through a bijective scrambling, so that equal lengths up to 8 never collide, and longer
    ones only as random numbers do, whatever the text; long spans get a cryptographic hash.
    """
    w = raw if isinstance(raw, Words64) else Words64(raw)
    length = ends - starts
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix64(h ^ (w.at(starts) & _KEEP[np.minimum(length, 8)]))
    left = np.flatnonzero(length > 8)
    if len(left):
        for i in left[length[left] > _LONG].tolist():
            h[i] = int.from_bytes(hashlib.blake2b(w.raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        left = left[length[left] <= _LONG]
    done = 8
    while len(left):
        x = w.at(starts[left] + done) & _KEEP[np.minimum(length[left] - done, 8)]
        h[left] = mix64(h[left] ^ x)
        done += 8
        left = left[length[left] > done]
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; at least one row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def word_spans(raw: np.ndarray, offsets: np.ndarray, sep: bytes = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's first word number (rows + 1 of them)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    outside = np.frombuffer(raw.tobytes().translate(sep), bool)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = ~outside
    end = start.copy()
    start[1:] &= outside[:-1] | first[1:n]
    end[:-1] &= outside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_K = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of k-word shingles; with fewer words the whole sequence as one, none without words."""
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(lowered(raw), starts, ends)
    n = max(0, len(words) - k + 1)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * _K + words[i : i + n]
    grams = mix64(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * _K + w
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def column_shingles(column, k: int = 5) -> Iterator[np.ndarray]:
    raw, off = utf8(column)
    for a, b in chunks(off):
        yield from shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
