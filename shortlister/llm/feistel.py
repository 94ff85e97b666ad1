"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows get global numbers 0 .. n-1 in order of (id, checksum, size), nulls first. A balanced Feistel network permutes
0 .. 4^b - 1, the smallest such domain with at least n values; a result of n or more is permuted again until it is
smaller, which keeps the map a permutation of 0 .. n-1. Position p lands in shard p mod s, slot p div s. Both follow
from the row number, n, s and the seed alone, and ``row_at`` inverts them, so a reader can find any row without an
index. Shard sizes differ by one at most (law ``rows``).

Defined cases: a null text has no bytes and the checksum of the empty text. Rows that agree in id, checksum and size
are interchangeable: they get neighbouring numbers in any order, so the set of returned rows is the same each time.
Other columns may have any names; those called row_number, shard or slot are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, ship, shuffle_width, stash

ROUNDS = 6
SEED = 20240611


def _keys(seed: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, b: int, keys: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << b) - 1)
    left, right = x >> np.uint64(b), x & low
    for key in keys:
        left, right = right, left ^ (mix64(right + key) & low)
    return (left << np.uint64(b)) | right


def _network_back(x: np.ndarray, b: int, keys: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << b) - 1)
    left, right = x >> np.uint64(b), x & low
    for key in keys[::-1]:
        left, right = right ^ (mix64(left + key) & low), left
    return (left << np.uint64(b)) | right


def _walk(numbers, n: int, seed: int, step) -> np.ndarray:
    x = np.array(numbers, dtype=np.uint64)
    b, keys = _bits(n), _keys(seed)
    x = step(x, b, keys)
    while len(out := np.flatnonzero(x >= np.uint64(n))):
        x[out] = step(x[out], b, keys)
    return x.astype(np.int64)


def permute(numbers, n: int, seed: int = SEED) -> np.ndarray:
    """Positions of row numbers below n."""
    return _walk(numbers, n, seed, _network)


def row_at(positions, n: int, seed: int = SEED) -> np.ndarray:
    """The row numbers at positions: the inverse of ``permute``."""
    return _walk(positions, n, seed, _network_back)


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``row`` (a struct of all columns) with a gapless ``row_number`` from 0 in the given order, and the rows' count.

    The rows are dealt by ranges and sorted within them; only the ranges' row counts pass through the driver.
    """
    spark = rows.sparkSession
    by = [F.col(f"row.`{c}`") for c in order]
    tied = rows.select(F.struct(*(f"`{c}`" for c in rows.columns)).alias("row")).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = tied.repartitionByRange(max(1, shuffle_width(spark)), *by, "tie").sortWithinPartitions(*by, "tie").select("row", F.monotonically_increasing_id().alias("at"))
    kept = stash(dealt)
    part = F.shiftrightunsigned(F.col("at"), 33).cast("int")
    counts = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p] = total
        total += n
    table = spark.createDataFrame([(p, s) for p, s in starts.items()] or [(0, 0)], "part int, start long")
    out = kept.withColumn("part", part).join(F.broadcast(table), "part")  # a row for each range
    return out.select("row", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("row_number")), total


def feistel_shards(rows: DataFrame, *order: str, shards: int = 24, seed: int = SEED) -> DataFrame:
    """``rows`` with row_number, shard and slot, in place of any columns of these names."""
    ship(rows.sparkSession)
    with_number, n = numbered(rows, *order)

    @F.pandas_udf("long")
    def position(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    new = ("row_number", "shard", "slot")
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in new]
    placed = with_number.withColumn("position", position("row_number"))
    return placed.select(*kept, "row_number", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = feistel_shards(rows, "doc_id", "text_crc32", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
