"""Forced-coefficient sweeps, paired tests and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import FLOOR, fused_add, fused_mult
from .fusion import gold_ranks


def mcnemar_p(improved: Column, worsened: Column) -> Column:
    """Exact two-sided binomial test of discordant pairs; 1 without any."""
    n, k = (improved + worsened).cast("double"), F.least(improved, worsened).cast("int")
    # Terms follow from each other: t(0) = 2^-n, t(i) = t(i-1) (n-i+1) / i.
    start = F.struct(F.pow(F.lit(0.5), n).alias("t"), F.pow(F.lit(0.5), n).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * (n - i + 1) / i
        return F.struct(t.alias("t"), (acc["sum"] + t).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda acc: acc["sum"])))


def sweep(base: DataFrame, method: str, values: tuple[float, ...], k: int) -> DataFrame:
    """One row for each (split, value) against the first value, which is 0: recall, discordant queries, rank movement.

    Scores are normalised over all queries of a split: a diagnosis, not a selection. base: split, query_id, tool_idx, s, p, is_gold.
    """
    spark = base.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pos int, value double"))  # a few rows
    z = base.groupBy("split").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std")).withColumn("std", F.when(F.col("std") > FLOOR, F.col("std")).otherwise(1.0))
    f = fused_add(F.col("s"), F.col("mean"), F.col("std"), F.col("p"), F.lit(1.0), F.col("value")) if method == "add" else fused_mult(F.col("s"), F.col("p"), F.col("value"))
    above = gold_ranks(base, z.join(grid), ["pos"], f)
    queries = base.select("split", "query_id").distinct().join(grid)
    worst = queries.join(above, ["split", "query_id", "pos"], "left").withColumn("maxgold", F.coalesce(F.col("above") + 1, F.lit(-1)))
    first = F.first("maxgold").over(Window.partitionBy("split", "query_id").orderBy("pos"))
    m, b = F.col("maxgold"), F.col("base")
    hit, hit0 = m <= k, b <= k
    out = worst.withColumn("base", first).groupBy("split", "pos", "value").agg(
        F.round(F.avg(hit.cast("double")), 4).alias("recall"), F.count_if(hit & ~hit0).alias("improved"), F.count_if(~hit & hit0).alias("worsened"), F.count_if(hit == hit0).alias("unchanged"),
        F.round(F.avg(m), 2).alias("maxgold_mean"), F.median(m).alias("maxgold_median"), F.round(F.avg(b - m), 2).alias("d_maxgold_mean"),
        F.count_if(m < b).alias("rank_improved"), F.count_if(m > b).alias("rank_worsened"), F.count_if(m == b).alias("rank_same"), F.count_if((m > k) & (m <= 2 * k)).alias("near_miss"),
    )
    return out.withColumn("net", F.col("improved") - F.col("worsened")).withColumn("mcnemar_p", F.round(mcnemar_p(F.col("improved"), F.col("worsened")), 4))


def verdict(rows: DataFrame, peak_margin: float = 0.05) -> DataFrame:
    """split, label, gain, at_value from sweep rows; the first of five rules that holds."""
    w = Window.partitionBy("split").orderBy("pos")
    treated = rows.withColumn("before", F.lag("recall").over(w)).where("pos > 0")
    base = rows.where("pos = 0").select("split", F.col("recall").alias("base"))
    at = F.struct(F.col("recall"), -F.col("pos"))
    probe = lambda c: F.max(F.when(F.col("pos") == 1, F.col(c)))
    agg = treated.groupBy("split").agg(
        F.max("recall").alias("best"), F.max_by("value", at).alias("at_value"), F.min("recall").alias("worst"), F.min(F.when(F.col("pos") > 1, F.col("recall") <= F.col("before") + 1e-9)).alias("down"),
        *(probe(c).alias(c) for c in ("improved", "worsened", "d_maxgold_mean", "rank_improved")),
    ).join(base, "split")
    gain = F.round(F.col("best") - F.col("base"), 4)
    label = (
        F.when(gain >= peak_margin, "peak")
        .when((F.col("improved") >= 2) & (F.col("worsened") >= 2), "cancel")
        .when((F.col("d_maxgold_mean") >= 1.0) | (F.col("rank_improved") >= 5), "blind_spot")
        .when(F.coalesce("down", F.lit(True)) & (F.col("worst") < F.col("base") - 1e-9), "harmful")
        .otherwise("absorbed")
    )
    return agg.select("split", label.alias("label"), gain.alias("gain"), "at_value")


def prior_shape(base: DataFrame) -> DataFrame:
    """Per split: how sharp the prior is over categories and how much it repeats the semantic order.

    base: split, query_id, tool_idx, category, s, p. Queries without mass, or without variance, are left out of the means they would spoil.
    """
    cat = base.groupBy("split", "query_id", "category").agg(F.max("p").alias("v"))
    total = F.sum("v").over(Window.partitionBy("query_id"))
    q = cat.withColumn("tot", total).withColumn("q", F.when(F.col("tot") > 1e-12, F.col("v") / F.col("tot")))
    sharp = q.groupBy("split", "query_id").agg(F.max("q").alias("mx"), F.when(F.max("tot") > 1e-12, -F.sum(F.when(F.col("q") > 1e-12, F.col("q") * F.log("q")).otherwise(0.0)) / F.log(F.count("*").cast("double"))).alias("ent"))
    each = base.groupBy("split", "query_id").agg(
        F.max("p").alias("pm"), F.max_by("p", F.struct("s", -F.col("tool_idx"))).alias("p1"), F.stddev_pop("p").alias("sp"), F.stddev_pop("s").alias("ss"), F.covar_pop("p", "s").alias("cov"),
    )
    both = each.join(sharp, ["split", "query_id"])
    agree = (F.col("pm") > 0) & (F.col("p1") >= F.col("pm") - 1e-9)
    return both.groupBy("split").agg(
        F.round(F.avg("mx"), 6).alias("mean_max_category_prob"), F.round(F.avg("ent"), 4).alias("mean_norm_entropy"), F.round(F.avg(agree.cast("double")), 4).alias("top1_sem_in_prior_argmax_rate"),
        F.round(F.avg(F.when((F.col("sp") > 1e-12) & (F.col("ss") > 1e-12), F.col("cov") / (F.col("sp") * F.col("ss")))), 4).alias("mean_corr_prior_sem"),
    )
