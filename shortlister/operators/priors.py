"""Priors over the catalogue from services, clusters and their ranks, and what they look like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from .cells import LEFT, RIGHT, dimension, dots, leading, order_key, reduce_cells, spread

TEMPERATURE = 0.05


def softmax(score: Column, temperature: float, *keys: str) -> Column:
    """Of the rows of a key, shifted by their maximum."""
    w = Window.partitionBy(*keys)
    t = max(temperature, 1e-6)
    e = F.exp((score - F.max(score).over(w)) / t)
    return e / F.sum(e).over(w)


def group_max_prior(scores: DataFrame, group: str, score: str, temperature: float = TEMPERATURE) -> DataFrame:
    """query_id, group, p: softmax over groups of the best member's score."""
    best = scores.groupBy("query_id", group).agg(F.max(score).alias("best"))
    return best.withColumn("p", softmax(F.col("best"), temperature, "query_id")).drop("best")


def cluster_scores(slot_scores: DataFrame, mode: str, top_m: int = 3) -> DataFrame:
    """query_id, label, cs: best member vector of a cluster, or the mean of its best ``top_m``."""
    if mode == "max":
        return slot_scores.groupBy("query_id", "label").agg(F.max("d").alias("cs"))
    order = Window.partitionBy("query_id", "label").orderBy(F.desc("d"), "tool_idx", "slot")
    return slot_scores.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top_m).groupBy("query_id", "label").agg(F.avg("d").alias("cs"))


def shaped(cs: DataFrame, shape: str, param: float) -> DataFrame:
    """query_id, label, p from cluster scores: softmax, or a weight by rank (1-based, ties to the smaller label)."""
    if shape == "softmax":
        return cs.withColumn("p", softmax(F.col("cs"), param, "query_id"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cs"), "label"))
    ranked = cs.withColumn("r", r)
    if shape == "pow":
        w = 1 / F.pow("r", F.lit(float(param)))
    elif shape == "exp":
        w = F.exp(-(F.col("r") - 1) / max(param, 1e-6))
    elif shape == "mass":
        w = F.when(F.col("r") <= int(param), 1.0).otherwise(1e-6)
    else:
        raise ValueError(f"unknown shape {shape}")
    ranked = ranked.withColumn("w", w)
    return ranked.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).drop("w", "r")


def mean_vectors(slots: DataFrame, key: str) -> DataFrame:
    """key, vec: the normalised mean of each group's non-zero vectors."""
    real = slots.where(norm(F.col("vec")) > 1e-8)
    dims = real.select(key, F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    vec = dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"))
    length = F.greatest(F.sqrt(dot(F.col("m"), F.col("m"))), F.lit(1e-8))
    return vec.withColumn("n", length).select(key, F.transform("m", lambda x: x / F.col("n")).alias("vec"))


def prior_stats(p: DataFrame) -> DataFrame:
    """Over the queries of (query_id, label, p): k, uniform, mean maximum, its ratio to uniform, mean normalised entropy."""
    x = F.col("p")
    each = p.groupBy("query_id").agg(F.max(x).alias("mx"), (-F.sum(F.when(x > 1e-12, x * F.log(x)).otherwise(0.0)) / F.log(F.count("*").cast("double"))).alias("ent"), F.count("*").alias("k"))
    return each.agg(F.max("k").alias("k"), F.round(1 / F.max("k"), 5).alias("uniform"), F.round(F.avg("mx"), 4).alias("mean_max"), F.round(F.avg("mx") * F.max("k"), 3).alias("max_over_uniform"), F.round(F.avg("ent"), 4).alias("mean_norm_entropy"))


def nearest(reps: DataFrame, n: int) -> DataFrame:
    """tool_idx, other, similarity, rk: the closest tools of other services (columns tool_idx, service, vec)."""
    reps, dims = reps.select("tool_idx", "service", "vec"), dimension(reps)

    def best(q: dict, block: dict) -> Iterator[pa.RecordBatch]:
        (tool, service), (other, others) = ([x[c].to_numpy(zero_copy_only=False) for c in ("tool_idx", "service")] for x in (q, block))
        d, apart = dots(q["vec"], block["vec"], dims), (tool[:, None] != other) & (service[:, None] != others)
        i, j = np.nonzero(apart & leading(np.where(apart, order_key(d), -np.inf), n))
        yield pa.RecordBatch.from_pydict({"tool_idx": pa.array(tool[i]), "other": pa.array(other[j]), "similarity": pa.array(d[i, j], mask=d[i, j] == -np.inf)})

    near = reduce_cells(reps, reps, spread(reps, "tool_idx", LEFT), spread(reps, "tool_idx", RIGHT), best, "tool_idx int, other int, similarity double")
    order = Window.partitionBy("tool_idx").orderBy(F.desc("similarity"), "other")
    return near.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n).select("tool_idx", "other", "similarity", "rk")
