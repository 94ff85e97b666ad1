"""Building the catalogue and query sets from raw instances: gold resolution, sampling, filling, training rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import make_id, norm_name
from ..tables import placed, ranged

CAP = 0.2


def drop_reason(query: Column, query_id: Column, relevant: Column, gold: Column) -> Column:
    """Why an instance goes, or null; the first reason counts."""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    return F.when(query.isNull() | (query == "") | query_id.isNull(), "no_query_or_id").when(empty(relevant), "no_relevant_apis").when(empty(gold), "gold_unresolved")


def resolve_gold(apis: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, gold (distinct ids in order of first mention), or an empty array if any pair is unresolved.

    apis: query_id, pos, category, tool, api; relevant: query_id, pos, tool, api. A pair is looked up as it is, then by
    normalised names; of equal keys the last api counts.
    """
    a = apis.where("category <> '' AND tool <> '' AND api <> ''").withColumn("id", make_id(F.col("category"), F.col("tool"), F.col("api")))
    exact = a.groupBy("query_id", "tool", "api").agg(F.max_by("id", "pos").alias("exact"))
    keys = (norm_name(F.col("tool")).alias("nt"), norm_name(F.col("api")).alias("na"))
    loose = a.groupBy("query_id", *keys).agg(F.max_by("id", "pos").alias("loose"))
    r = relevant.join(exact, ["query_id", "tool", "api"], "left").select("*", *keys).join(loose, ["query_id", "nt", "na"], "left")
    found = r.withColumn("id", F.coalesce("exact", "loose"))
    ids = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"]))
    out = found.groupBy("query_id").agg(ids.alias("gold"), F.bool_and(F.col("id").isNotNull()).alias("all"))
    return out.select("query_id", F.when(F.col("all"), F.col("gold")).otherwise(F.array().cast("array<string>")).alias("gold"))


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with ``first_pos``, where the key came first."""
    w = Window.partitionBy(key)
    return rows.withColumn("first_pos", F.min(order).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def md5_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string")))


def sample_split(queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n queries of each split in md5 order; splits I2 and I3 take only those with two or more gold tools."""
    ok = queries.where((F.col("split") == "I1") | (F.size(F.array_distinct("gold")) >= 2))
    return ok.withColumn("n", F.row_number().over(Window.partitionBy("split").orderBy(md5_order(seed, "query_id"), "query_id"))).where(F.col("n") <= n).drop("n")


def fill(universe: DataFrame, gold: DataFrame, pool_size: int, seed: int = 42) -> DataFrame:
    """id, phase, place: gold ids, then others up to ``pool_size``; with as much gold, gold alone.

    Of others, each gold category first gives its share of the free places, rounded half to even and at most CAP of
    them; what is missing comes from the rest in md5 order, without that limit. universe: id, category; gold: id.
    """
    counts = gold.join(universe, "id").groupBy("category").agg(F.count("*").alias("c"))
    target = F.greatest(F.lit(pool_size) - F.col("total"), F.lit(0))
    totals = gold.agg(F.count("*").alias("total"))
    quota = counts.crossJoin(F.broadcast(totals)).withColumn("target", target)  # one row
    cap = F.greatest(F.lit(1.0), F.ceil(F.col("target") * CAP).cast("double"))
    quota = quota.select("category", F.least(F.bround(F.col("target") * F.col("c") / F.col("total")), cap).cast("int").alias("quota"))
    free = universe.join(gold, "id", "left_anti").join(quota, "category", "left").withColumn("o", md5_order(seed, "id"))
    free = placed(free, ["category"], [F.col("o"), F.col("id")]).withColumn("r", F.col("place") + 1)
    first = F.col("r") <= F.coalesce("quota", F.lit(0))
    others = free.select("id", F.when(first, 1).otherwise(2).alias("phase"), F.when(first, F.concat_ws("\u0001", "category", F.lpad(F.col("r").cast("string"), 10, "0"))).otherwise(md5_order(seed + 1, "id")).alias("sort"))
    ranked = placed(gold.select("id", F.lit(0).alias("phase"), F.lit("").alias("sort")).unionByName(others), [], [F.col("phase"), F.col("sort"), F.col("id")])
    return ranked.where((F.col("phase") == 0) | (F.col("place") < pool_size)).select("id", "phase", F.col("place").cast("int").alias("place"))


def train_val(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """``part``: the first rows in md5 order (rounded, at least one) are val, the others train."""
    ranked = placed(rows.withColumn("_o", md5_order(seed, key)), [], [F.col("_o"), F.col(key)]).drop("_o")
    least = F.greatest(F.lit(1), F.bround(F.lit(rows.count()) * fraction))
    return ranked.select(*rows.columns, F.when(F.col("place") < least, "val").otherwise("train").alias("part"))


class _Batches:
    """Batches of consecutive items, each as long as the limits allow; where one begins decides where the next does."""

    def __init__(self, tokens: np.ndarray, max_items: int, max_tokens: int):
        self.tokens, n = tokens, len(tokens)
        self.sums = np.r_[0, np.cumsum(tokens)]
        at = np.arange(n)
        fits = np.searchsorted(self.sums, self.sums[:-1] + max_tokens, "right") - 1
        self.next = np.minimum(np.minimum(at + max_items, np.maximum(at + 1, fits)), n)

    def starts(self, first: int) -> list[int]:
        out = []
        while first < len(self.tokens):
            out.append(first)
            first = int(self.next[first])
        return out

    def last(self, first: int) -> tuple[int, int, int]:
        """How many batches begin from here on, and items and tokens of the last one."""
        starts = self.starts(first)
        return len(starts), len(self.tokens) - starts[-1], int(self.sums[-1] - self.sums[starts[-1]])


def _absorbed(n: int, total: int, head: list[int], max_items: int, max_tokens: int) -> tuple[int, int, int]:
    """How many items a batch of n items still takes, and its items and tokens then."""
    taken = 0
    for t in head if n else ():
        if n >= max_items or total + t > max_tokens:
            break
        n, total, taken = n + 1, total + t, taken + 1
    return taken, n, total


def token_batches(items: DataFrame, group: str, order: str, tokens: str, max_items: int = 8, max_tokens: int = 40_000) -> DataFrame:
    """group, order, batch: items in order; a new batch starts when one more would pass a limit.

    Items are dealt by ranges. A range's first group may go on from the range before; for each of the ``max_items``
    places where a first batch of its own can then begin, the range tells how many batches follow and how full the last
    one is. A few numbers of each range pass through the driver, which chains the ranges; then each range numbers its own.
    """
    spark = items.sparkSession
    rows = items.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("t"))
    kept = ranged(rows, [F.col("g"), F.col("o")])

    def runs(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        pdf = pdf.sort_values("_at")
        key = pdf["g"].astype(object).where(pdf["g"].notna(), None)
        cuts = (key != key.shift()).to_numpy(copy=True) & ~(key.isna() & key.shift().isna()).to_numpy()
        cuts[0] = True
        return [x for _, x in pdf.groupby(np.cumsum(cuts), sort=False)]

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = runs(pdf)
        first, last = (_Batches(x["t"].to_numpy(), max_items, max_tokens) for x in (parts[0], parts[-1]))
        ways = [first.last(e) for e in range(min(max_items, len(first.tokens)))]
        name = lambda x: None if pd.isna(x["g"].iloc[0]) else str(x["g"].iloc[0])
        row = {"_part": pdf["_part"].iloc[0], "first_group": name(parts[0]), "last_group": name(parts[-1]), "alone": len(parts) == 1, "items": len(first.tokens), "head": first.tokens[:max_items].tolist(), "ways": [list(w) for w in ways], "fresh": list(last.last(0))}
        return pd.DataFrame([row])

    summary = kept.groupBy("_part").applyInPandas(told, "_part long, first_group string, last_group string, alone boolean, items long, head array<long>, ways array<array<long>>, fresh array<long>").collect()  # a row for each range
    entries, group_before, batch, n, total = [], (), 0, 0, 0
    for r in sorted(summary, key=lambda r: r["_part"]):
        if group_before != (r.first_group,):
            batch, n, total = 0, 0, 0
        entries.append((r["_part"], batch, n, total))
        if r.alone:
            taken, n, total = _absorbed(n, total, r.head, max_items, max_tokens)
            if taken < r["items"]:
                batch += r.ways[taken][0] - (0 if entries[-1][2] else 1)
                n, total = r.ways[taken][1:]
        else:
            batch, n, total = r.fresh[0] - 1, r.fresh[1], r.fresh[2]
        group_before = (r.last_group,)

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, x in enumerate(runs(pdf)):
            own = _Batches(x["t"].to_numpy(), max_items, max_tokens)
            batch, n, total = (int(x[c].iloc[0]) for c in ("e_batch", "e_n", "e_total")) if i == 0 else (0, 0, 0)
            taken, _, _ = _absorbed(n, total, x["t"].head(max_items).tolist(), max_items, max_tokens)
            begins = np.zeros(len(x), np.int64)
            begins[own.starts(taken)] = 1
            out.append(x.assign(batch=batch + np.cumsum(begins) - (0 if n else 1)))
        return pd.concat(out)[["g", "o", "batch"]]

    table = spark.createDataFrame(entries or [(-1, 0, 0, 0)], "_part long, e_batch long, e_n long, e_total long")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = kept.join(F.broadcast(table), "_part").groupBy("_part").applyInPandas(numbered, f"g {kinds['g']}, o {kinds['o']}, batch int")  # a row for each range
    return done.select(F.col("g").alias(group), F.col("o").alias(order), "batch")
