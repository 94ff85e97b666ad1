"""From scored records to summaries, tables, paired effects and conclusions; segment gates and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot_of
from ..tables import placed, stash
from .cells import count_before_sets, dimension
from .fusion import fold_table
from .ranking import with_rank, worst_gold

#: Fixed names and order of retrieval methods.
METHODS = ("dense_single", "dense_multi", "fusion_add_oracle", "fusion_add_real", "fusion_mult_oracle", "fusion_mult_real")
CONDITIONS = ("random_k", "oracle_tool", *(f"retrieved_{m}" for m in METHODS))
KEY = ("split", "model", "condition", "k")
METRICS = ("func_acc", "exact_match", "strict_success", "completeness", "recall_all", "parse_rate", "mean_prompt_tokens", "mean_n_calls", "mean_hallucinated_calls", "retrieval_miss", "generation_miss", "n")


def summarise(records: DataFrame, *keys: str) -> DataFrame:
    """Means and counts of each group of records."""
    mean = lambda c, d=4: F.round(F.avg(c), d)
    return records.groupBy(*keys).agg(
        *(mean(c).alias(c) for c in ("func_acc", "exact_match", "strict_success", "completeness", "recall_all")), mean((F.col("gen_status") == "ok").cast("double")).alias("parse_rate"),
        mean("prompt_tokens", 1).alias("mean_prompt_tokens"), mean("n_calls", 3).alias("mean_n_calls"), mean("hallucinated_calls", 3).alias("mean_hallucinated_calls"),
        F.count_if(F.col("miss_type") == "retrieval_miss").alias("retrieval_miss"), F.count_if(F.col("miss_type") == "generation_miss").alias("generation_miss"), F.count("*").alias("n"),
    )


def expected(spark: SparkSession, splits, models, ks) -> DataFrame:
    """Every combination that should exist; ``full`` once, as k 0."""
    rows = [(s, m, c, k, i) for s in splits for m in models for i, (c, k) in enumerate([("full", 0), *((c, k) for k in ks for c in CONDITIONS)])]
    return spark.createDataFrame(rows, "split string, model string, condition string, k int, pos int")


def summary_grid(grid: DataFrame, found: DataFrame, reasons: DataFrame) -> DataFrame:
    """``grid`` with metrics, or blanks and a reason: of the very combination, of its split and model, or the default."""
    exact = reasons.where("condition <> '*'").withColumnRenamed("reason", "r1")
    wild = reasons.where("condition = '*'").select("split", "model", F.col("reason").alias("r2"))
    out = grid.join(found, list(KEY), "left").join(exact, list(KEY), "left").join(wild, ["split", "model"], "left")
    reason = F.when(F.col("n").isNotNull(), "").otherwise(F.coalesce("r1", "r2", F.lit("no output")))
    return out.select(*KEY, *METRICS, reason.alias("reason"), "pos")


def best_retrieved(summary: DataFrame, k: int, *order: str) -> DataFrame:
    """The best retrieval condition of each split and model at k; the first listed one among equals."""
    rows = summary.where((F.col("k") == k) & F.col("condition").startswith("retrieved_") & F.col("func_acc").isNotNull())
    w = Window.partitionBy("split", "model").orderBy(*(F.desc(c) for c in order), "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paired(records: DataFrame, baseline: str) -> DataFrame:
    """Query by query, each retrieval condition against a baseline: mean differences, helped, hurt, unchanged (by strict success)."""
    base = records.where(F.col("condition") == baseline).select("split", "model", "query_id", F.col("func_acc").alias("bf"), F.col("strict_success").alias("bs")).dropDuplicates(["split", "model", "query_id"])
    both = records.where(F.col("condition").startswith("retrieved_")).join(base, ["split", "model", "query_id"])
    d = F.col("strict_success") - F.col("bs")
    return both.groupBy("split", "model", "condition").agg(
        F.round(F.avg(F.col("func_acc") - F.col("bf")), 4).alias("delta_func_acc"), F.round(F.avg(d), 4).alias("delta_strict_success"),
        F.count_if(d > 0).alias("helped_queries"), F.count_if(d < 0).alias("hurt_queries"), F.count_if(d == 0).alias("unchanged_queries"),
    )


def given_recall(records: DataFrame) -> DataFrame:
    """Accuracy where retrieval kept all gold and where it did not; null where there is none."""
    hit = lambda c, v: F.round(F.avg(F.when(F.col("recall_all") == v, F.col(c))), 4)
    return records.where(F.col("condition").startswith("retrieved_")).groupBy("split", "model", "condition").agg(
        F.round(F.avg("recall_all"), 4).alias("recall_all"), hit("func_acc", 1).alias("func_acc_given_hit"), hit("func_acc", 0).alias("func_acc_given_miss"), hit("strict_success", 1).alias("strict_given_hit"), hit("strict_success", 0).alias("strict_given_miss"),
    )


def low_similarity_miss(pairs: DataFrame, percent: int = 20) -> DataFrame:
    """Of (split, sim, missed) the share missed among pairs up to the similarity at the given percentile's place."""
    counts = pairs.groupBy("split").agg(F.count("*").alias("n")).select("split", F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100)).alias("at"))
    cut = placed(pairs, ["split"], [F.col("sim")]).join(counts, "split").where("place + 1 = at").select("split", F.col("sim").alias("cut"))
    return pairs.join(cut, "split").where("sim <= cut").groupBy("split").agg(F.round(F.avg(F.col("missed").cast("double")), 4).alias("low_sim_miss_rate"), F.count("*").alias("pairs"))


def gate(segments: DataFrame, mode: str, param: float) -> DataFrame:
    """``segments`` (query_id, seg, m, m_full) with ``kept``; if a gate keeps none, the first best one stays."""
    w = Window.partitionBy("query_id")
    best = F.row_number().over(w.orderBy(F.desc("m"), "seg"))
    keep = {"none": F.lit(True), "abs": F.col("m") >= param, "rel": F.col("m") >= F.col("m_full") - param, "rank": F.col("_b") <= max(1, int(param))}[mode]
    marked = segments.withColumn("_b", best).withColumn("_k", keep)
    return marked.withColumn("kept", F.col("_k") | (~F.max("_k").over(w) & (F.col("_b") == 1))).drop("_b", "_k")


#: Gates in the order that breaks ties: their kind and parameter.
GATES = (("none", 0.0), ("abs", 0.4), ("abs", 0.45), ("abs", 0.5), ("rel", 0.01), ("rel", 0.02), ("rel", 0.04), ("rel", 0.08), ("rank", 1.0), ("rank", 2.0), ("rank", 3.0))


def gated_sets(segments: DataFrame, gates: tuple = GATES) -> DataFrame:
    """query_id, pos (of the gate), kept (sorted segments), drop (the share that went): what each gate keeps of each query.

    segments: query_id, seg, m, m_full. If a gate keeps none, the first best one stays.
    """
    spark = segments.sparkSession
    grid = F.broadcast(spark.createDataFrame([(i, *g) for i, g in enumerate(gates)], "pos int, gate string, param double"))  # a dozen rows
    own = segments.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("back"), "seg", "m", "m_full"))).alias("by_m"))  # a query's segments, a few
    each = own.join(grid)
    keep = F.filter(
        "by_m",
        lambda x, i: F.when(F.col("gate") == "abs", x["m"] >= F.col("param")).when(F.col("gate") == "rel", x["m"] >= x["m_full"] - F.col("param")).when(F.col("gate") == "rank", i < F.greatest(F.lit(1), F.col("param").cast("int"))).otherwise(True),
    )
    kept = each.withColumn("k", keep).withColumn("k", F.when(F.size("k") > 0, F.col("k")).otherwise(F.slice("by_m", 1, 1)))
    return kept.select("query_id", "pos", "gate", "param", F.array_sort(F.transform("k", lambda x: x["seg"])).alias("kept"), (1 - F.size("k") / F.size("by_m")).alias("drop"))


def gate_ranks(scores: DataFrame, gold: DataFrame, sets: DataFrame) -> DataFrame:
    """query_id, kept, maxgold: the last gold tool's rank by the best score of the whole query and the kept segments.

    scores: query_id, seg (0 is the whole query), tool_idx, s; gold: query_id, tool_idx, is_gold. Gates that keep the
    same segments of a query share the work.
    """
    variants = sets.select("query_id", "kept").distinct()
    met = scores.join(variants, "query_id").where((F.col("seg") == 0) | F.array_contains("kept", F.col("seg")))
    best = met.groupBy("query_id", "kept", "tool_idx").agg(F.max("s").alias("u")).join(gold.select("query_id", "tool_idx", "is_gold"), ["query_id", "tool_idx"])
    return worst_gold(with_rank(best, "u", "query_id", "kept"), "query_id", "kept")


def gate_ranks_by_vectors(segments: DataFrame, vectors: DataFrame, slots: DataFrame, gold: DataFrame, sets: DataFrame) -> DataFrame:
    """``gate_ranks`` from vectors, in cells: no table of all scores.

    segments: query_id, seg, of, block (a number; queries of a block are scored together); vectors: of, vec; slots:
    tool_idx, slot, vec; gold: query_id, tool_idx.
    """
    variants = sets.select("query_id", "kept").distinct().withColumn("mask", F.expr("aggregate(kept, 1, (m, s) -> m | shiftleft(1, s))"))
    segments = segments.join(vectors, "of")
    own = gold.join(segments, "query_id").join(slots.withColumnRenamed("vec", "tool_vec"), "tool_idx").withColumn("d", dot_of(F.col("vec"), F.col("tool_vec"), dimension(slots)))
    s = own.groupBy("query_id", "tool_idx", "seg").agg(F.max("d").alias("s")).join(variants, "query_id").where((F.col("seg") == 0) | F.array_contains("kept", F.col("seg")))
    u = s.groupBy("query_id", "mask", "tool_idx").agg(F.max("s").alias("u")).groupBy("query_id", "mask").agg(F.min(F.struct("u", (-F.col("tool_idx")).alias("back"))).alias("w"))
    asked = u.groupBy("query_id").agg(F.collect_list(F.struct("mask", F.col("w.u").alias("last"), (-F.col("w.back")).alias("at"))).alias("asked"))
    rows = stash(segments.join(asked, "query_id").withColumn("asked", F.when(F.col("seg") == 0, F.col("asked"))))
    blocks = rows.agg(F.coalesce(F.max("block") + 1, F.lit(1))).first()[0]
    above = count_before_sets(rows, slots, F.col("block"), blocks)
    return variants.join(above, ["query_id", "mask"], "left").select("query_id", "kept", F.coalesce((F.col("above") + 1).cast("int"), F.lit(-1)).alias("maxgold"))


def gate_search(ranks: DataFrame, sets: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """For each (split, held fold) the gate with the best recall at k on the other folds; ties to the one that drops less, then to order."""
    each = sets.join(ranks, ["query_id", "kept"]).join(folds, "query_id")
    held = F.broadcast(fold_table(sets.sparkSession))  # a row for each fold
    per = each.join(held, F.col("fold") != F.col("held")).groupBy("split", "held", "pos", "gate", "param").agg(F.avg((F.col("maxgold") <= k).cast("double")).alias("recall"), F.avg("drop").alias("drop"))
    best = per.groupBy("split", "held").agg(F.max_by(F.struct("pos", "gate", "param", "recall"), F.struct("recall", F.round(-F.col("drop"), 12), -F.col("pos"))).alias("x"))
    return best.select("split", "held", "x.*")


def quota_top_k(scores: DataFrame, k: int) -> DataFrame:
    """query_id, tool_idx, place: round robin over the segments' rankings, the rest by the best of all scores.

    scores: query_id, seg (0 is the whole query), tool_idx, s. With one segment, plain top k of the better of both.
    """
    q = Window.partitionBy("query_id")
    n = scores.where("seg > 0").groupBy("query_id").agg(F.countDistinct("seg").alias("n"))
    union = scores.groupBy("query_id", "tool_idx").agg(F.max("s").alias("u")).withColumn("ur", F.row_number().over(q.orderBy(F.desc("u"), "tool_idx")))
    ranked = scores.where("seg > 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id", "seg").orderBy(F.desc("s"), "tool_idx"))).join(n, "query_id")
    first = ranked.where((F.col("n") > 1) & (F.col("r") <= F.greatest(F.lit(1), F.ceil(k / F.col("n"))))).groupBy("query_id", "tool_idx").agg(F.min(F.struct(F.lit(0).alias("phase"), F.col("r").alias("a"), F.col("seg").alias("b"))).alias("o"))
    rest = F.struct(F.lit(1).alias("phase"), F.col("ur").alias("a"), F.lit(0).alias("b"))
    placed = union.join(first, ["query_id", "tool_idx"], "left").withColumn("o", F.coalesce("o", rest)).withColumn("place", F.row_number().over(q.orderBy("o")))
    return placed.where(F.col("place") <= k).select("query_id", "tool_idx", "place")


def delta(column: str, a: Column, b: Column) -> Column:
    return F.round(a - b, 4).alias(column)


def text_lines(rows: DataFrame, order: list[str], widths: dict[str, int]) -> DataFrame:
    """line, text: a report as aligned lines, numbered from 1; a negative width is left-aligned, fractions have 4 places."""
    kinds = dict(rows.dtypes)

    def cell(name: str, width: int) -> Column:
        fraction = F.when(F.col(name).isNotNull(), F.format_string("%.4f", F.round(name, 4))) if kinds[name] == "double" else None
        value = F.col(name).cast("string") if fraction is None else fraction
        value = F.coalesce(value, F.lit("-"))
        return F.rpad(value, -width, " ") if width < 0 else F.lpad(value, width, " ")

    numbered = placed(rows, [], [F.col(c) for c in order])
    return numbered.select((F.col("place") + 1).cast("int").alias("line"), F.concat(*(cell(n, w) for n, w in widths.items())).alias("text"))
