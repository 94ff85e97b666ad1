"""Exact top-k inner products by a score-at-a-time index in order of impact.

Candidates are dealt into blocks. A block's index has a posting segment for each dimension and quantised component
(its impact, in steps of STEP or, for longer components, of the power of two that gives LEVELS levels): the block's rows
whose component falls there. A query scores a segment at the product of its own component and the segment's impact, and
takes the segments in descending order of that product's size, adding to accumulators. What a row can still gain or lose
is bounded by the quantisation error (by the lengths of query and error) and, for the dimensions that are not finished,
by their next segment; processing stops only when these bounds prove that few rows can be in the top k, or at the end,
and the possible ones are rescored exactly with whole vectors. Each block gives every query its k best; the k best of
all blocks are exact. Queries are met in lots: no task ever holds more than one block and one lot, and every lot meets
every block, as exact scores of all pairs need.

Scores are exact integers: sums below 2 ** 53 are taken in double precision, which is exact there, longer ones in whole
numbers of any length, with the rounding of the accumulators in the bounds. ``score`` is a long; a score beyond it is
given as the nearest long, while ranks follow the exact scores.

Defined cases: components are floor(256 x) of x as double. A vector that is null or empty, or has a null or non-finite
component, takes no part. Vectors of another length than the most usual one are compared only with their like. Ties go to
the smaller id. A query with fewer than k candidates returns all; without any, nothing. A row without id takes no part.
Rows that repeat an id are candidates each, but not for a query of that id; as queries, they give one list: the k best
scores of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, shuffle_width, slices, stash, trimmed

STEP, LEVELS = 16, 64
#: Times k: so few possible rows end the processing of segments.
FEW = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 256
_OUT = "query_id long, vec_id long, score long, exact string"
_EXACT, _LONG = 2.0**53, 1 << 63


def whole(x: np.ndarray) -> list[list[int]]:
    """floor(256 x) of each row's components, exactly."""
    return [[int(np.floor(256 * c)) if abs(c) < 2.0**60 else 256 * int(c) for c in row] for row in x.tolist()]


def sort_key(score: int) -> str:
    """Text that sorts as the integers do."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(_COMPLEMENT)}"


_COMPLEMENT = str.maketrans("0123456789", "9876543210")


class Block:
    """The posting segments of some vectors (rows sorted by id)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order]
        with np.errstate(over="ignore"):
            self.vectors = np.floor(256 * self.raw)
        self.longest = float(np.abs(self.vectors).max(initial=0))
        step = float(STEP)
        while np.isfinite(self.longest) and self.longest > step * LEVELS:
            step *= 2
        if not np.isfinite(self.longest * len(self.vectors[0]) if len(self.vectors) else 0.0):
            step = np.inf  # no double bounds these: every row is rescored
        level = np.floor((self.vectors + step / 2) / step) if np.isfinite(step) else np.zeros_like(self.vectors)
        # What rounding to levels leaves of each row, as a length: a query times it is at most the product of lengths.
        with np.errstate(over="ignore", invalid="ignore"):
            self.rest = np.sqrt(((self.vectors - level * (step if np.isfinite(step) else 0.0)) ** 2).sum(axis=1))
        segments: list[tuple[int, float, np.ndarray]] = []
        for d in range(vectors.shape[1]):
            by = np.argsort(level[:, d], kind="stable")
            values, at = np.unique(level[by, d], return_index=True)
            segments += [(d, float(v) * step, rows) for v, rows in zip(values, np.split(by, at[1:])) if v]
        self.dims = np.array([s[0] for s in segments], np.int64)
        self.impacts = np.array([s[1] for s in segments], np.float64)
        self.rows = [s[2] for s in segments]

    def top(self, query: np.ndarray, k: int, leave_out: int | None) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows but those of the query's own id."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._top(query, k, leave_out)

    def _top(self, query: np.ndarray, k: int, leave_out: int | None) -> tuple[np.ndarray, list[int]]:
        q = np.floor(256 * query)
        reach = float(np.abs(q).sum()) * max(1.0, self.longest)
        gain = q[self.dims] * self.impacts if len(self.dims) else np.zeros(0)
        order = np.argsort(-np.abs(gain), kind="stable")
        order = order[: np.count_nonzero(gain)]
        size, dims = np.abs(gain)[order], self.dims[order]
        # A row has one segment of each dimension: what a dimension can still bring is at most its next segment.
        by = np.argsort(dims, kind="stable")
        same = dims[by[1:]] == dims[by[:-1]]
        later = np.zeros(len(order))
        later[by[:-1][same]] = size[by[1:][same]]
        starts = by[np.r_[True, ~same]] if len(by) else by
        left = size[starts].sum() - np.cumsum(size - later)
        # Beyond 2 ** 53 the accumulators and bounds round, each step by a part in 2 ** 53 of what it can reach at most.
        rounding = 0.0 if reach < _EXACT else reach * (len(order) + len(q) + 8) * 2.0**-50
        slack = float(np.sqrt(q @ q)) * self.rest * (1 + 1e-12) + rounding
        own = slice(np.searchsorted(self.ids, leave_out), np.searchsorted(self.ids, leave_out, "right")) if leave_out is not None else slice(0, 0)
        acc = np.zeros(len(self.ids))
        possible, at, n = None, 0, len(order)
        steps = gain[order].tolist()
        for to in sorted({n // 2, 3 * n // 4, 7 * n // 8, n}):
            for s, g in zip(order[at:to].tolist(), steps[at:to]):
                acc[self.rows[s]] += g
            at = to
            possible = self._possible(acc, k, slack + (left[to - 1] if to else left.sum() if n else 0.0), own)
            if len(possible) <= FEW * k:
                break
        if reach < _EXACT:
            found = self.vectors[possible] @ q
            best = np.lexsort((self.ids[possible], -found))[:k]
            return self.ids[possible[best]], found[best].astype(np.int64).tolist()
        asked = whole(query.reshape(1, -1))[0]
        scored = sorted((-sum(x * y for x, y in zip(asked, row)), i) for row, i in zip(whole(self.raw[possible]), self.ids[possible].tolist()))[:k]
        return np.array([i for _, i in scored], np.int64), [-s for s, _ in scored]

    @staticmethod
    def _possible(acc: np.ndarray, k: int, reach: np.ndarray, own: slice) -> np.ndarray:
        """Rows whose upper bound is not below the k-th best lower bound: any other row is proven to be out."""
        low, high = acc - reach, acc + reach
        if not (np.isfinite(low).all() and np.isfinite(high).all()):
            low, high = np.full(len(acc), -np.inf), np.full(len(acc), np.inf)  # nothing is proven
        low[own] = high[own] = -np.inf
        others = len(acc) - (own.stop - own.start)
        floor = np.partition(low, len(low) - k)[len(low) - k] if others > k else -np.inf
        found = high >= floor - 1e-6
        found[own] = False
        return np.flatnonzero(found)


def _gathered(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each block, a bounded number of vectors each."""
    return rows.groupBy("dims", *by).agg(F.collect_list(F.struct("id", "v")).alias("rows"))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in slices(batches, 1):
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != held:
                    block, held = Block(*_matrix(batch.column(3)[i].values)), key
                q_ids, q_vectors = _matrix(batch.column(4)[i].values)
                out = [(q, *block.top(v, k, q)) for q, v in zip(q_ids.tolist(), q_vectors)]
                scores = [s for x in out for s in x[2]]
                columns = [np.repeat([x[0] for x in out], [len(x[1]) for x in out]), np.concatenate([x[1] for x in out]), [max(-_LONG, min(_LONG - 1, s)) for s in scores]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([sort_key(s) for s in scores], pa.string())], names=["query_id", "vec_id", "score", "exact"])

    return run


def _matrix(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = rows.field(0).to_numpy(), rows.field(1)
    return ids, vectors.flatten().to_numpy().reshape(len(ids), -1)


def finite_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array of double), dims; only vectors that take part."""
    x = F.col(vector_col)
    # NaN and both infinities fail the test against the largest finite double.
    good = (F.size(x) > 0) & F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) <= 1.7976931348623157e308, F.lit(False)))
    kept = embeddings.where(F.col(id_col).isNotNull() & x.isNotNull()).where(good)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: e.cast("double")).alias("v"), F.size(x).alias("dims"))


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Tables of id, v, dims (see ``finite_vectors``) to query_id, rank, vec_id, score; a row is no candidate of a query with its own id.

    Where there are few blocks, each goes to several tasks, which share the lots of queries; where there are many, to one.
    """
    spark = candidates.sparkSession
    ship(spark)
    candidates, queries = stash(candidates), stash(queries)
    blocks, lots = (max(1, -(-t.count() // rows)) for t, rows in ((candidates, block_rows), (queries, query_rows)))
    groups = min(lots, max(1, -(-3 * shuffle_width(spark) // blocks)))
    spread = F.xxhash64(F.monotonically_increasing_id())  # of rows in written files: the same again; equal rows part
    dealt = _gathered(candidates.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")), "block")
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumnRenamed("rows", "c")
    asked = _gathered(queries.withColumn("lot", F.pmod(spread, F.lit(lots)).cast("int")), "lot")
    asked = asked.select("dims", F.col("rows").alias("q"), (F.col("lot") % groups).alias("share"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    met = dealt.join(asked.hint("shuffle_merge"), ["dims", "block", "share"]).select("dims", "block", "share", "c", "q")
    found = stash(met.mapInArrow(trimmed(_search(k)), _OUT), rows=1)
    by = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = finite_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_top_k(vectors, vectors.where("id % 50 = 0"))


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM good q, good c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
