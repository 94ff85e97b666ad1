"""Scoring a catalogue against queries, deterministic ranking, recall and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot_of

#: Vectors of each side that one cell of a product holds, at most about.
BLOCK = 1024


def product(left: DataFrame, right: DataFrame, key_left: str, key_right: str, *on: str) -> DataFrame:
    """Every row of one table with every row of the other (that agrees in ``on``), met in cells of a block of each.

    A stated set of queries against a whole catalogue needs all of these pairs. Blocks are dealt by a hash of the keys;
    a cell is a join key, so that no task holds more than two blocks and nothing is broadcast.
    """
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = left.count(), right.count()
    rows = max(1, -(-n // BLOCK))
    columns = max(1, -(-m // BLOCK), min(m, -(-width // rows)))
    a = left.withColumn("_r", F.pmod(F.xxhash64(key_left), F.lit(rows)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = right.withColumn("_c", F.pmod(F.xxhash64(key_right), F.lit(columns)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return a.join(b.hint("shuffle_hash"), ["_r", "_c", *on]).drop("_r", "_c")


def slot_scores(queries: DataFrame, slots: DataFrame) -> DataFrame:
    """Every query's dot product with every slot vector: a stated set of queries against the whole catalogue."""
    dims = slots.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]
    met = product(queries, slots.withColumnRenamed("vec", "tool_vec").withColumn("_slot", F.struct("tool_idx", "slot")), "query_id", "_slot").drop("_slot")
    return met.withColumn("d", dot_of(F.col("vec"), F.col("tool_vec"), dims)).drop("vec", "tool_vec")


def pooled_scores(slots: DataFrame, *keys: str) -> DataFrame:
    """``s_multi``: the best slot (zero slots count as 0); ``s_single``: slot 0."""
    return slots.groupBy(*keys, "tool_idx").agg(F.max("d").alias("s_multi"), F.max(F.when(F.col("slot") == 0, F.col("d"))).alias("s_single"))


def with_rank(scores: DataFrame, score: str | Column, *keys: str, name: str = "rk") -> DataFrame:
    """1-based ranks in descending order; ties go to the smaller catalogue position."""
    col = F.col(score) if isinstance(score, str) else score
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(col.desc(), "tool_idx")))


def top_k(scores: DataFrame, score: str | Column, k: int, *keys: str) -> DataFrame:
    return with_rank(scores, score, *keys).where(F.col("rk") <= k)


def worst_gold(ranked: DataFrame, *keys: str) -> DataFrame:
    """``maxgold``: the worst rank among gold tools, -1 without any. All gold is within K exactly if 0 < maxgold <= K."""
    return ranked.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("is_gold"), F.col("rk"))), F.lit(-1)).alias("maxgold"))


def recall_all(gold: Column, candidates: Column) -> Column:
    """1 if every gold tool is a candidate, also without gold tools."""
    return (F.size(F.array_except(gold, candidates)) == 0).cast("int")


def folds(queries: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """Balanced folds in each split, in the order of md5 of seed and id."""
    order = F.md5(F.concat(F.lit(f"{seed}::"), F.col("query_id")))
    rows = queries.select("split", "query_id", order.alias("order")).withColumn("range", F.substring("order", 1, 3))  # even ranges, as md5 is
    before = Window.partitionBy("split").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("split", "range").count().select("split", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy("split", "range").orderBy("order", "query_id"))).join(starts, ["split", "range"])
    return placed.select("split", "query_id", ((F.col("start") + F.col("n") - 1) % n).cast("int").alias("fold"))
