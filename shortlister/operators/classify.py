"""Classifier reports: coverage, weights, calibration, average precision, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import running


def coverage(freq: DataFrame, test: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row on how training categories (category, n) cover test categories within a vocabulary."""
    known = vocab.join(freq, "category", "left").join(test.withColumn("t", F.lit(True)), "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seen = F.when(F.col("n") > 0, F.col("n"))
    ratio = F.when(F.max(seen).isNotNull(), F.round(F.max(seen) / F.min(seen), 1)).otherwise(0.0)
    return known.agg(
        F.count("*").alias("vocab_size"), F.count_if("t").alias("test_categories"), F.count_if(F.col("t") & (F.col("n") > 0)).alias("covered"), F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("t") & (F.col("n") == 0), F.col("category")))), ","), F.lit("")).alias("missing"),
        F.coalesce(F.max(seen), F.lit(0)).alias("train_max_freq"), F.coalesce(F.min(seen), F.lit(0)).alias("train_min_nonzero_freq"), ratio.alias("imbalance_ratio"),
    )


def positive_weight(y: Column) -> Column:
    """Negatives over positives of a group; 1 without positives."""
    pos = F.sum(y)
    return F.when(pos > 0, (F.count("*") - pos) / pos).otherwise(1.0)


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """ece of (p, y): equal bins, closed above, the first one below as well; edges are i / bins."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    b = F.size(F.filter(edges, lambda e: F.col("p") > e))
    per = rows.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def cross_entropy(logit: Column, y: Column, t: Column) -> Column:
    p = F.least(F.greatest(1 / (1 + F.exp(-logit / t)), F.lit(1e-6)), F.lit(1 - 1e-6))
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def fit_temperature(rows: DataFrame) -> DataFrame:
    """temperature of (logit, y): the best of 46 from 0.5 to 5, then of 41 around it, 0.2 to each side, not under 0.3."""
    spark = rows.sparkSession

    def best(grid: DataFrame) -> DataFrame:
        loss = rows.crossJoin(F.broadcast(grid)).groupBy("i", "t").agg(F.avg(cross_entropy(F.col("logit"), F.col("y"), F.col("t"))).alias("loss"))  # under 50 rows
        return loss.agg(F.min_by("t", F.struct(F.round("loss", 12), "i")).alias("t"))

    coarse = best(spark.range(46).select(F.col("id").alias("i"), (0.5 + F.col("id") * 4.5 / 45).alias("t")))
    low = F.greatest(F.lit(0.3), F.col("t") - 0.2)
    fine = coarse.select(low.alias("low"), (F.col("t") + 0.2).alias("high")).crossJoin(spark.range(41).select(F.col("id").alias("i"))).select("i", (F.col("low") + F.col("i") * (F.col("high") - F.col("low")) / 40).alias("t"))
    return best(fine).withColumnRenamed("t", "temperature")


def average_precision(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, ap: precision at the end of each group of equal scores times the recall it adds; only keys with positives."""
    ties = rows.groupBy(*keys, "score").agg(F.sum("y").alias("tp"), F.count("*").alias("n"))
    run = running(ties, list(keys), [F.desc("score")], tp_to=F.col("tp"), n_to=F.col("n")).withColumn("precision", F.col("tp_to") / F.col("n_to"))
    return run.groupBy(*keys).agg(F.sum("tp").alias("pos"), F.sum(F.col("precision") * F.col("tp")).alias("s")).where("pos > 0").select(*keys, (F.col("s") / F.col("pos")).alias("ap"))


def f1(rows: DataFrame, vocab_size: int) -> DataFrame:
    """micro and macro F1 of (category, y, pred); 0 where undefined; macro over the whole vocabulary."""
    per = rows.groupBy("category").agg(F.sum(F.col("y") * F.col("pred")).alias("tp"), F.sum((1 - F.col("y")) * F.col("pred")).alias("fp"), F.sum(F.col("y") * (1 - F.col("pred"))).alias("fn"))
    score = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    per = per.withColumn("f", score(F.col("tp"), F.col("fp"), F.col("fn")))
    return per.agg(score(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), (F.sum("f") / vocab_size).alias("macro_f1"))


def set_precision_recall(rows: DataFrame) -> DataFrame:
    """Of (picked, gold: arrays): mean precision over non-empty picks, mean recall over all, empty picks, mean size."""
    both, n = F.size(F.array_intersect("picked", "gold")), F.size("picked")
    return rows.agg(F.round(F.avg(F.when(n > 0, both / n)), 4).alias("precision"), F.round(F.avg(both / F.greatest(F.lit(1), F.size("gold"))), 4).alias("recall"), F.count_if(n == 0).alias("empty"), F.round(F.avg(n), 4).alias("mean_picked"))
