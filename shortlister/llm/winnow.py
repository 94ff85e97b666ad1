"""Document fingerprints by winnowing.

The k-grams of a text's code points are hashed by a rolling polynomial. From each window of w consecutive k-gram hashes
the smallest is chosen, the rightmost of equal ones, and kept with its position. Any two texts that share a run of at
least w + k - 1 code points therefore share a chosen hash, and no match shorter than k counts. Windows are WINDOW wide;
in a text of fewer than 10 * WINDOW code points a tenth of it, LEAST_WINDOW at least, so that short texts have more than
one or two hashes, too. A narrower window chooses all that a wider one does: two texts of different windows share a
chosen hash as if both had the wider one.

A fingerprint is the chosen ``hash@position`` pairs (hash: 10 hex digits; position: code points before the k-gram),
separated by spaces, by position. Likeness is the Jaccard similarity of the sets of chosen hashes.

Defined cases: a null text is empty; the empty text has the empty fingerprint, alike (1.0) to another empty one and not
(0.0) to any other text. A text shorter than k is one gram; one with fewer than w grams is one window. Texts are taken
as they are: case and white space count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, ship, shuffle_width, slices, text_or_empty, trimmed

GRAM = 16
WINDOW = 64
LEAST_WINDOW = 4
_HASH_BITS = 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)
_CODE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 1 << 12, dtype=np.uint64)


def _grams(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of each k neighbouring code points, or of all if there are fewer.

    A polynomial modulo 2 ** 64 over scrambled code points, cut to its upper bits after a scrambling; the windows are
    far too short for two of them to agree by construction.
    """
    values = _CODE[points & 0xFFF] + points.astype(np.uint64)
    k, m, acc = min(k, len(values)), 1, values
    for bit in f"{k:b}"[1:]:  # twice the length, and one more
        acc = acc[:-m] * np.uint64(pow(int(_BASE), m, 1 << 64)) + acc[m:]
        m *= 2
        if bit == "1":
            acc = acc[:-1] * _BASE + values[m : m + len(acc) - 1]
            m += 1
    return mix64(acc) >> np.uint64(64 - _HASH_BITS)


def _sliding_choice(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w, from the running minima of blocks of w in both directions."""
    n = len(key) - w + 1
    pad = (-len(key)) % w
    blocks = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def window_of(n: int) -> int:
    """The window of a text of n code points."""
    return min(WINDOW, max(LEAST_WINDOW, n // 10))


def winnow(points: np.ndarray, k: int = GRAM, w: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions chosen from an array of code points; without w, the window is that of the text's length."""
    n = len(points)
    w = window_of(n) if w is None else w
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = _grams(points, k)
    out_hash, out_at = [], []
    step = int(_LOW) - w
    for at in range(0, len(grams), step):  # blocks that overlap by w - 1, so that a position fits its bits
        part = grams[at : at + step + w - 1]
        if at and len(part) < w:
            break
        key = (part << np.uint64(24)) | (_LOW - np.arange(len(part), dtype=np.uint64))
        chosen = _sliding_choice(key, min(w, len(part)))
        chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
        out_hash.append(chosen >> np.uint64(24))
        out_at.append((_LOW - (chosen & _LOW)).astype(np.int64) + at)
    h, p = np.concatenate(out_hash), np.concatenate(out_at)
    new = np.r_[True, p[1:] != p[:-1]]
    return h[new], p[new]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def written(hashes: np.ndarray, at: np.ndarray) -> str:
    return " ".join(f"{h:010x}@{p}" for h, p in zip(hashes.tolist(), at.tolist()))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two arrays of hashes, as sets."""
    x, y = np.unique(x), np.unique(y)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    cols = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def _compare(k: int, w: int | None):
    """Rows (part, borrowed, doc_id, text) of whole parts, in descending order, each followed by the first row of the next part."""

    def row(last: tuple, next_text: str, after: tuple) -> tuple:
        doc_id, text, own = last
        m = len(text) // 3
        points = _points(text)
        edited = np.concatenate((points[: len(points) - m], _points(next_text[:m])))
        data = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        changed = winnow(edited, k, w)
        return doc_id, len(points), hashlib.sha256(data).hexdigest(), written(*own), written(*changed), likeness(own[0], changed[0]), likeness(own[0], after[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, None
        for batch in slices(batches, 128):
            out = []
            for part, borrowed, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = winnow(_points(text), k, w)
                if last and part == at:
                    out.append(row(last, text, own))
                last, at = (None if borrowed else (doc_id, text, own)), part
            yield _batch(out)

    return run


class _Ranges:
    """Ranges of ids in descending order, nulls last; an id that fills several ranges has them by parts of the tie's values."""

    def __init__(self, quantiles: list[float], nulls: int):
        at, times = np.unique(np.array(quantiles, np.float64).astype(np.int64), return_counts=True)
        self.at, self.times = at, np.where(times > 1, times, 0)
        # From the highest id downwards: what is above the last point, then each point's own ranges and what is below it.
        self.region, self.own = np.zeros(len(at) + 1, np.int64), np.zeros(len(at), np.int64)
        n = 1
        for j in range(len(at) - 1, -1, -1):
            self.own[j] = n
            self.region[j] = n + self.times[j]
            n += self.times[j] + 1
        self.nulls, self.first_null, self.count = max(1, nulls), n, int(n) + max(1, nulls)

    def part(self, ids: pd.Series, ties: np.ndarray) -> np.ndarray:
        upper = (ties.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        known = ids.notna().to_numpy()
        out = self.first_null + (upper * np.uint64(self.nulls) >> np.uint64(32)).astype(np.int64)
        x = ids[known].astype("int64").to_numpy()
        j = np.searchsorted(self.at, x, "left")
        part = self.region[j]
        if len(self.at):
            i = np.minimum(j, len(self.at) - 1)
            own = (self.at[i] == x) & (self.times[i] > 0)
            part[own] = (self.own[i] + (upper[known] * self.times[i].astype(np.uint64) >> np.uint64(32)).astype(np.int64))[own]
        out[known] = part
        return out


def edited_likeness(documents: DataFrame, k: int = GRAM, w: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to this and to the next document.

    The next document is the one with the next smaller id (null ids come last; equal ids by a hash of the text, then
    the text); after the last one the first. The edited text has the last third (rounded down) of the code points
    replaced by as many first ones of the next document, or all of them. The texts are dealt by ranges of ids (and of
    the hash, where many rows share an id or have none) and sorted within a range, and the first row of each range goes
    to the range before as well, so that a document meets the next one in its own task. Only one id and hash of each
    range pass through the driver.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = max(1, shuffle_width(spark))
    counted = docs.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    known = max(1, round(parts * (1 - counted.none / max(1, counted.n))))
    points = docs.approxQuantile("doc_id", [i / known for i in range(1, known)], 0.2 / known) if known > 1 else []
    ranges = _Ranges(points, round(parts * counted.none / max(1, counted.n)))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(ranges.part(ids, ties.to_numpy()).astype(np.int32))

    docs = docs.withColumn("tie", F.xxhash64("text")).select(part_of("doc_id", "tie").alias("part"), "doc_id", "tie", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.coalesce("doc_id", F.lit(0)).cast("decimal(20,0)")).alias("neg"), F.col("tie"))).alias("first")
    heads = sorted((r.part, r.first) for r in docs.groupBy("part").agg(first).collect())
    if not heads:
        return spark.createDataFrame([], _OUT)
    before = {part: heads[i - 1][0] for i, (part, _) in enumerate(heads)}
    table = spark.createDataFrame([(part, None if x.none else -int(x.neg), x.tie, before[part]) for part, x in heads], "part int, head long, tie long, before int")
    table = F.broadcast(table)  # a row for each range
    lent = docs.join(table, ["part", "tie"]).where(F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("before").alias("part"), F.lit(True).alias("borrowed"), "doc_id", "tie", "text")
    both = docs.select("part", F.lit(False).alias("borrowed"), "doc_id", "tie", "text").union(lent)
    dealt = both.repartitionById(ranges.count, "part").sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return dealt.select("part", "borrowed", "doc_id", "text").mapInArrow(trimmed(_compare(k, w)), _OUT)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_winnow(text: str, k: int = GRAM, w: int = WINDOW) -> list[int]:
    """Positions chosen by the plain definition, for tests."""
    points = _points(text)
    if not len(points):
        return []
    n = max(1, len(points) - k + 1)
    values = _CODE[points & 0xFFF] + points.astype(np.uint64)
    powers = [pow(int(_BASE), i, 1 << 64) for i in range(k)][::-1][-min(k, len(points)) :]
    sums = [sum(int(v) * p for v, p in zip(values[i : i + k], powers)) % (1 << 64) for i in range(n)]
    hashes = [int(mix64(np.array([x], np.uint64))[0]) >> (64 - _HASH_BITS) for x in sums]
    out = []
    for i in range(max(1, n - w + 1)):
        window = range(i, min(i + w, n))
        low = min(hashes[j] for j in window)
        at = max(j for j in window if hashes[j] == low)
        if not out or out[-1] != at:
            out.append(at)
    return out
