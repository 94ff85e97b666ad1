"""Mixing sources to target weights along a curriculum.

Each source has a base weight and a linear schedule: at time t of training, 0 to 1, its weight is the base times
1 + g (2 t - 1), with a slope g from -1 to 1. The schedule integrates to the base weight, so slopes move a source
earlier or later without changing how much of it is taken. The cumulative demand of a source, target * S(t) with
S(t) = (1 - g) t + g t^2, is inverted to give the training position of each of its words; a document's copy stands
where its middle word does. ``curriculum`` range-sorts the copies by position.

Targets are shares of all words by weight, limited to ``limit`` times the source's size; what is above goes to the
others by weight until no target is above its limit. A source is passed through in a fixed pseudo-random order, whole
passes first, then as far as the target asks; the document at that point gives only its first words.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a source without words
has target 0; without any words every target is 0. Repeated rows each count; rows that agree in all columns are
interchangeable. Other columns may have any names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, stash

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
LIMIT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], limit: float = LIMIT) -> list[float]:
    """Shares of all sizes by weight, none above limit times its size, the excess shared by weight among the rest."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, open_ = np.zeros(len(size)), np.ones(len(size), bool)
    left = size.sum()
    while open_.any() and left > 0:
        share = left * weight / weight[open_].sum()
        over = open_ & (share > limit * size)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = limit * size[over]
        open_ &= ~over
        left = size.sum() - out[~open_].sum()
    return out.tolist()


def default_weight(i: int) -> int:
    """Of the i-th source in order of code points: 1, 2, 3, repeating."""
    return i % 3 + 1


def default_slope(i: int) -> float:
    """Every other source fades out while the rest fade in."""
    return 0.5 if i % 2 else -0.5


def curriculum_plan(documents: DataFrame, weight=default_weight, slope=default_slope, limit: float = LIMIT) -> DataFrame:
    """(doc_id, text, source) to doc_id, source, size, source_size, target, taken, positions.

    ``positions`` has an entry, 0 to 1, for each copy that the mix takes; copies but the last are whole, and the last
    has the rest of ``taken``. One row per source passes through the driver: the mixture itself.
    """
    spark = documents.sparkSession
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _row_key(documents).alias("key"))
    sized = stash(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sources.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    wanted = targets([r.n for r in sources], [weight(i) for i in range(len(sources))], limit)
    rows = [(r.source, int(r.n), t, slope(i)) for i, (r, t) in enumerate(zip(sources, wanted))]
    table = spark.createDataFrame(rows, "source string, source_size long, target double, slope double").withColumnRenamed("source", "_source")

    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    spread = F.xxhash64(F.monotonically_increasing_id())
    dealt = sized.withColumn("_tie", spread).repartitionByRange(max(1, shuffle_width(spark)), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    kept = stash(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned(F.col("_at"), 33).cast("int"))
    sums = kept.groupBy("_part", "source").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_part").alias("_p"), F.col("source").alias("_s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("_part", "source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.join(starts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).join(table, F.col("source").eqNullSafe(F.col("_source")))
    at, size = F.col("_start") + F.col("_before"), F.col("size")
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("_from", at).withColumn("_passes", passes)
    rest = F.greatest(F.lit(0), F.least(size, goal - F.col("_passes") * F.col("source_size") - F.col("_from")))
    placed = placed.withColumn("_rest", rest).withColumn("taken", (F.col("_passes") * size + F.col("_rest")).cast("long"))
    copies = F.when(size > 0, F.col("_passes") + (F.col("_rest") > 0).cast("int")).otherwise(0).cast("int")

    def position(e: Column) -> Column:
        length = F.when(e < F.col("_passes"), size).otherwise(F.col("_rest"))
        u = F.least(F.lit(1.0), (e * F.col("source_size") + F.col("_from") + length / 2) / F.col("target"))
        g = F.col("slope")
        return 2 * u / ((1 - g) + F.sqrt((1 - g) * (1 - g) + 4 * g * u))

    epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", F.transform(epochs, position).alias("positions"), "key")


def curriculum(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``documents``, a row for each copy, in order of training position.

    The copy that the target cuts short has the text up to the end of its last word, white space as it was.
    """
    names = [f"`{c}`" for c in documents.columns]
    plan = curriculum_plan(documents, **how)
    entries = plan.groupBy("key").agg(F.collect_list(F.struct(F.col("doc_id").alias("plan_id"), "size", "taken", "positions")).alias("entries"))
    rows = documents.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id"), _row_key(documents).alias("row_key"))
    joined = rows.join(entries.hint("merge"), F.col("row_key") == F.col("key"))
    # Of equal rows each takes one of their entries in the plan; the join has brought them together already.
    nth = F.row_number().over(Window.partitionBy("row_key", "id").orderBy("row_key"))
    own = F.filter("entries", lambda e: e["plan_id"].eqNullSafe(F.col("id")))
    one = joined.withColumn("nth", nth).withColumn("entry", F.element_at(own, F.col("nth"))).select("row", "entry.*")
    each = one.select("row", "size", "taken", F.posexplode("positions").alias("copy", "position"))
    words = F.col("taken") - F.col("copy") * F.col("size")
    cut = words < F.col("size")
    text = first_words(F.col("row.text"), words)
    changed = F.col("row").withField("text", text)
    if "n_chars" in documents.columns:
        changed = changed.withField("n_chars", F.length(text).cast(documents.schema["n_chars"].dataType))
    each = each.select(F.when(cut, changed).otherwise(F.col("row")).alias("row"), "position")
    return each.repartitionByRange(max(1, shuffle_width(documents.sparkSession)), "position").sortWithinPartitions("position").select("row.*")


def _row_key(documents: DataFrame) -> Column:
    """A hash of all columns: rows that agree in it and the id are taken for equal."""
    plain = (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    parts = [F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.to_json(F.struct(f"`{f.name}`")) for f in sorted(documents.schema.fields, key=lambda f: f.name)]
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), *parts)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "positions")
