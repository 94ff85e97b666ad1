"""Ranking, recall, folds, fusion and their diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import fusion as fu
from ..operators import priors as pr
from ..operators import ranking as rk
from ..tables import stash
from .fixture_sql import BASE, FX1, fusion

KS = (5, 10, 20, 50)
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _top(score: str):
    return f"""{FX1}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, tool_idx) AS rk FROM s)
SELECT split, query_id, CAST(rk AS INTEGER) AS rk, tool_idx, round({score}, 4) AS score FROM r WHERE rk<=10"""


def _topk(spark, sf_dir, score):
    return rk.top_k(fx.scores(spark, sf_dir), score, 10, "query_id").select("split", "query_id", "rk", "tool_idx", F.round(score, 4).alias("score"))


@query(_top("s_single"))
def dense_single_topk(spark, sf_dir):
    """I1, F1."""
    return _topk(spark, sf_dir, "s_single")


@query(_top("s_multi"))
def dense_multi_topk(spark, sf_dir):
    """I2, E1, F1."""
    return _topk(spark, sf_dir, "s_multi")


@query(f"""{FX1}, m AS (SELECT split, query_id, tool_idx, is_gold, unnest(['dense_multi','dense_single']) AS method, unnest([s_multi, s_single]) AS sc FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY sc DESC, tool_idx) AS rk FROM m),
g AS (SELECT split, query_id, method, max(CASE WHEN is_gold THEN rk END) AS mg FROM r GROUP BY ALL)
SELECT split, method, k, round(avg(CASE WHEN mg<=k THEN 1.0 ELSE 0.0 END), 4) AS recall, count(*) AS n FROM g, (SELECT unnest([5,10,20,50]) AS k) GROUP BY ALL""")
def recall_sweep(spark, sf_dir):
    """One ranking for every K."""
    s = fx.scores(spark, sf_dir)
    long = s.select("split", "query_id", "tool_idx", "is_gold", F.explode(F.create_map(F.lit("dense_multi"), F.col("s_multi"), F.lit("dense_single"), F.col("s_single"))).alias("method", "sc"))
    worst = rk.worst_gold(rk.with_rank(long, "sc", "query_id", "method"), "split", "query_id", "method")
    each = worst.withColumn("k", F.explode(F.array(*map(F.lit, KS))))
    return each.groupBy("split", "method", "k").agg(F.round(F.avg((F.col("maxgold") <= F.col("k")).cast("double")), 4).alias("recall"), F.count("*").alias("n"))


@query(f"""{FX1} SELECT split, query_id, tool_idx, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s_multi DESC, tool_idx) AS INTEGER) AS rk FROM s""")
def full_rank(spark, sf_dir):
    """F2."""
    return rk.with_rank(fx.scores(spark, sf_dir), "s_multi", "query_id").select("split", "query_id", "tool_idx", "rk")


_MG = f"""{FX1}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s_multi DESC, tool_idx) AS rm, row_number() OVER (PARTITION BY query_id ORDER BY s_single DESC, tool_idx) AS rs FROM s),
g AS (SELECT split, query_id, CAST(coalesce(max(CASE WHEN is_gold THEN rm END), -1) AS INTEGER) AS mm, CAST(coalesce(max(CASE WHEN is_gold THEN rs END), -1) AS INTEGER) AS ms FROM r GROUP BY ALL)"""


def _both_worst(spark, sf_dir):
    s = rk.with_rank(rk.with_rank(fx.scores(spark, sf_dir), "s_multi", "query_id", name="rm"), "s_single", "query_id", name="rs")
    gold = lambda c: F.coalesce(F.max(F.when(F.col("is_gold"), F.col(c))), F.lit(-1))
    return s.groupBy("split", "query_id").agg(gold("rm").alias("mm"), gold("rs").alias("ms"))


@query(f"{_MG} SELECT split, query_id, mm AS maxgold_multi, ms AS maxgold_single FROM g")
def maxgold_rank(spark, sf_dir):
    """E21."""
    return _both_worst(spark, sf_dir).withColumnsRenamed({"mm": "maxgold_multi", "ms": "maxgold_single"})


@query(f"""{_MG} SELECT split, round(avg(mm), 4) AS mean_rank, CAST(median(mm) AS DOUBLE) AS median_rank, round(avg(mm)-avg(ms), 4) AS delta_mean,
count(*) FILTER (mm<ms) AS improved, count(*) FILTER (mm>ms) AS worsened, count(*) FILTER (mm=ms) AS same, count(*) FILTER (mm>10 AND mm<=20) AS near_miss FROM g GROUP BY split""")
def near_miss_stats(spark, sf_dir):
    """E22, against the single-vector ranking."""
    m, s = F.col("mm"), F.col("ms")
    return _both_worst(spark, sf_dir).groupBy("split").agg(
        F.round(F.avg(m), 4).alias("mean_rank"), F.median(m).alias("median_rank"), F.round(F.avg(m) - F.avg(s), 4).alias("delta_mean"),
        F.count_if(m < s).alias("improved"), F.count_if(m > s).alias("worsened"), F.count_if(m == s).alias("same"), F.count_if((m > 10) & (m <= 20)).alias("near_miss"),
    )


@query(f"{BASE} SELECT split, query_id, CAST(fold AS INTEGER) AS fold FROM folds")
def fold_assignment(spark, sf_dir):
    """F10."""
    return rk.folds(fx.queries(spark, sf_dir))


@query(f"{fusion('p_oracle')} SELECT split, CAST(held AS INTEGER) AS held, round(mean, 6) AS mean, round(std, 6) AS std FROM z")
def zscore_by_fold(spark, sf_dir):
    """E5, D-6."""
    z = fu.zscore_stats(_base(spark, sf_dir, "p_oracle"))
    return z.select("split", "held", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _base(spark, sf_dir, prior, score="s_multi"):
    return fx.base(spark, sf_dir).withColumns({"s": F.col(score), "p": F.col(prior)})


def _head(spark, sf_dir, prior):
    """What can come to the first ``fu.SELECT_K`` places, and the z statistics of all scores."""
    return fx.head(spark, sf_dir).withColumns({"s": F.col("s_multi"), "p": F.col(prior)}), stash(fu.zscore_of(fx.moments(spark, sf_dir)))


def _search(spark, sf_dir, method, prior="p_real"):
    b, z = _head(spark, sf_dir, prior)
    return fu.grid_search(b, method, z)


@query(f"{fusion('p_real')} SELECT split, CAST(held AS INTEGER) AS held, alpha, beta, round(recall, 4) AS recall FROM ba")
def grid_search_add(spark, sf_dir):
    """E6, D-8."""
    return _search(spark, sf_dir, "add").select("split", "held", "alpha", "beta", F.round("recall", 4).alias("recall"))


@query(f"{fusion('p_real')} SELECT split, CAST(held AS INTEGER) AS held, lam, round(recall, 4) AS recall FROM bm")
def grid_search_mult(spark, sf_dir):
    """E6, D-8."""
    return _search(spark, sf_dir, "mult").select("split", "held", "lam", F.round("recall", 4).alias("recall"))


@query(f"""{fusion('p_real')} SELECT 'add' AS method, split, alpha, beta, CAST(NULL AS DOUBLE) AS lam, count(*) AS folds, beta=0.1 AS at_floor FROM ba GROUP BY ALL
UNION ALL SELECT 'mult', split, NULL, NULL, lam, count(*), lam=0.1 FROM bm GROUP BY ALL""")
def coeff_distribution(spark, sf_dir):
    """E23."""
    none = F.lit(None).cast("double")
    b, z = _head(spark, sf_dir, "p_real")
    a = fu.grid_search(b, "add", z).groupBy("split", "alpha", "beta").agg(F.count("*").alias("folds")).select(F.lit("add").alias("method"), "split", "alpha", "beta", none.alias("lam"), "folds", (F.col("beta") == min(fu.BETAS)).alias("at_floor"))
    m = fu.grid_search(b, "mult", z).groupBy("split", "lam").agg(F.count("*").alias("folds")).select(F.lit("mult").alias("method"), "split", none.alias("alpha"), none.alias("beta"), "lam", "folds", (F.col("lam") == min(fu.LAMBDAS)).alias("at_floor"))
    return a.unionByName(m)


def _packed_fused(spark, sf_dir, method, prior):
    """Ranked candidates, gold and recall of each query."""
    packed = fx.packed(spark, sf_dir)
    stats, of = fu.packed_stats(packed), _PACKED[prior]
    return fu.fused_first(packed, method, of[0], stats, fu.search_packed(packed, method, of[0], stats, of[1]), of[1])


#: Priors of packed queries: their names, and the queries that have none.
_PACKED = {"p_oracle": ("p_own", None), "p_real": ("p_near", fx.without_prior)}


def _cand_sql(prior, use):
    return f"""{fusion(prior)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, tool_idx) AS rk FROM {use})
SELECT split, query_id, CAST(fold AS INTEGER) AS fold, string_agg(id, ',' ORDER BY rk) FILTER (rk<=10) AS candidate_tools, string_agg(id, ',' ORDER BY id) FILTER (is_gold) AS gold_tools,
CAST(max(CASE WHEN is_gold THEN rk END)<=10 AS INTEGER) AS recall_all FROM r GROUP BY ALL"""


@query(_cand_sql("p_oracle", "usea"))
def fusion_add_oracle(spark, sf_dir):
    """I3, D-5, D-7, B19."""
    return _packed_fused(spark, sf_dir, "add", "p_oracle")


@query(_cand_sql("p_oracle", "usem"))
def fusion_mult_oracle(spark, sf_dir):
    """I3, B20."""
    return _packed_fused(spark, sf_dir, "mult", "p_oracle")


@query(_cand_sql("p_real", "usea"))
def fusion_add_real(spark, sf_dir):
    """I4, I5, D-4."""
    return _packed_fused(spark, sf_dir, "add", "p_real")


@query(_cand_sql("p_real", "usem"))
def fusion_mult_real(spark, sf_dir):
    """I4."""
    return _packed_fused(spark, sf_dir, "mult", "p_real")


def _recall(fused, k=10):
    worst = rk.worst_gold(rk.with_rank(fused, "f", "query_id"), "split", "query_id")
    return worst.groupBy("split").agg(F.avg((F.col("maxgold") <= k).cast("double")).alias("recall"))


def _recall_sql(use, k=10):
    return f"SELECT split, avg(CASE WHEN mg<={k} THEN 1.0 ELSE 0.0 END) AS recall FROM (SELECT split, query_id, max(CASE WHEN is_gold THEN rk END) AS mg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, tool_idx) AS rk FROM {use}) GROUP BY ALL) GROUP BY split"


@query(f"""{fusion('p_oracle')},
reuse AS (SELECT b.split, b.query_id, b.tool_idx, is_gold, ba.alpha*(s_multi-round(mean,6))/round(std,6) + ba.beta*p_real AS f FROM b JOIN z ON z.split=b.split AND z.held=fold JOIN ba ON ba.split=b.split AND ba.held=fold),
far AS (SELECT b.split, query_id, tool_idx, is_gold, z.held, pos, alpha, beta, alpha*(s_multi-mean)/std + beta*p_real AS f FROM b JOIN z ON z.split=b.split AND fold<>held, ga),
har AS (SELECT split, query_id, held, pos, alpha, beta, max(CASE WHEN is_gold THEN rk END) AS mg FROM (SELECT *, row_number() OVER (PARTITION BY split, query_id, held, pos ORDER BY f DESC, tool_idx) AS rk FROM far) GROUP BY ALL),
bar AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, held ORDER BY recall DESC, beta, pos) AS n FROM (SELECT split, held, pos, alpha, beta, avg(CASE WHEN mg<=10 THEN 1.0 ELSE 0.0 END) AS recall FROM har GROUP BY ALL)) WHERE n=1),
refit AS (SELECT b.split, b.query_id, b.tool_idx, is_gold, bar.alpha*(s_multi-round(mean,6))/round(std,6) + bar.beta*p_real AS f FROM b JOIN z ON z.split=b.split AND z.held=fold JOIN bar ON bar.split=b.split AND bar.held=fold),
o AS ({_recall_sql('usea')}), u AS ({_recall_sql('reuse')}), t AS ({_recall_sql('refit')})
SELECT o.split, round(o.recall, 4) AS oracle_recall, round(u.recall, 4) AS reuse_recall, round(t.recall, 4) AS refit_recall, round(o.recall-u.recall, 4) AS gap_reuse, round(o.recall-t.recall, 4) AS gap_refit FROM o JOIN u USING (split) JOIN t USING (split)""")
def fusion_reuse_gap(spark, sf_dir):
    """I4: coefficients fitted with the oracle prior reused on the classifier's, or fitted again."""
    packed = fx.packed(spark, sf_dir)
    stats, (own, none), (near, missing) = fu.packed_stats(packed), _PACKED["p_oracle"], _PACKED["p_real"]
    chosen, again = fu.search_packed(packed, "add", own, stats, none), fu.search_packed(packed, "add", near, stats, missing)
    rows = fu.fused_recall(packed, "add", [(own, chosen, none), (near, chosen, missing), (near, again, missing)], stats)
    o, u, t = (F.col(f"r{i}") for i in range(3))
    r = lambda c: F.round(c, 4)
    return rows.select("split", r(o).alias("oracle_recall"), r(u).alias("reuse_recall"), r(t).alias("refit_recall"), r(o - u).alias("gap_reuse"), r(o - t).alias("gap_refit"))


def _ablation_part(score, prior):
    base = "multi" if score == "s_multi" else "single"
    name = prior.removeprefix("p_")
    none = f"SELECT split, query_id, tool_idx, is_gold, {score} AS f FROM b"
    return [f"SELECT '{base}' AS base, '{p}' AS prior, '{m}' AS method, x.* FROM ({fusion(prior, score)} {_recall_sql(u)}) x" for p, m, u in ((name, "add", "usea"), (name, "mult", "usem"), *([("none", "none", f"({none})")] if prior == "p_oracle" else []))]


@query("SELECT base, prior, method, split, round(recall, 4) AS recall FROM (" + " UNION ALL ".join(x for s in ("s_multi", "s_single") for p in ("p_oracle", "p_real") for x in _ablation_part(s, p)) + ")")
def prior_ablation(spark, sf_dir):
    """Base scorer x prior x fusion. A variant is a split of its own, so that one search serves all of a method."""
    b, out = fx.base(spark, sf_dir), []
    rows = F.array(*(F.struct(F.lit(base).alias("base"), F.lit(p.removeprefix("p_")).alias("prior"), F.col(s).alias("s"), F.col(p).alias("p")) for base, s in (("multi", "s_multi"), ("single", "s_single")) for p in ("p_oracle", "p_real")))
    each = b.withColumn("x", F.explode(rows)).select("tool_idx", "fold", "is_gold", "x.s", "x.p", *(F.concat_ws("|", "x.base", "x.prior", c).alias(c) for c in ("split", "query_id")))
    each = stash(each)
    for method in ("add", "mult"):
        z = fu.zscore_stats(each)
        out.append(_recall(fu.fuse(each, method, z, fu.grid_search(each, method, z))).withColumn("method", F.lit(method)))
    out.append(_recall(each.where(F.col("split").contains("|oracle|")).withColumn("f", F.col("s"))).withColumn("method", F.lit("none")))
    part = F.split("split", r"\|")
    prior = F.when(F.col("method") == "none", "none").otherwise(part[1])
    return reduce(DataFrame.unionByName, out).select(part[0].alias("base"), prior.alias("prior"), "method", part[2].alias("split"), F.round("recall", 4).alias("recall"))


#: Shapes of a prior by rank: weight 1 / r ** p for these powers. The fixed grids get the weight 0 as well.
SHAPES = (0.5, 1.0, 2.0)


def _shaped_base(spark, sf_dir):
    """``fx.base`` with ps: for each shape the prior of the tool's cluster, by the rank of the cluster's best three vectors."""
    live = fx.dots(spark, sf_dir).where(~((F.col("slot") == 2) & (F.col("tool_idx") % 7 == 0)))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cs"), "label"))
    ranked = pr.cluster_scores(live, "topm").withColumn("r", r)
    weights = F.array(*(1 / F.pow("r", F.lit(p)) for p in SHAPES))
    each = ranked.select("query_id", F.concat(F.lit("cat"), F.col("label").cast("string")).alias("category"), weights.alias("w"))
    total = each.groupBy("query_id").agg(F.array(*(F.sum(F.get("w", F.lit(i))) for i in range(len(SHAPES)))).alias("t"))
    shaped = each.join(total, "query_id").select("query_id", "category", F.zip_with("w", "t", lambda a, b: a / b).alias("ps"))
    none = F.array(*(F.lit(0.0) for _ in SHAPES))
    return stash(fx.base(spark, sf_dir).withColumn("s", F.col("s_multi")).join(shaped, ["query_id", "category"], "left").withColumn("ps", F.coalesce("ps", none)))


_JOINT = f"""{BASE}, held AS (SELECT unnest(range(5)) AS held), z AS (SELECT split, held, avg(s_multi) AS mean, CASE WHEN stddev_pop(s_multi)>1e-8 THEN stddev_pop(s_multi) ELSE 1.0 END AS std FROM b, held WHERE fold<>held GROUP BY ALL),
tm AS (SELECT query_id, label, avg(d) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY d DESC, tool_idx, slot) AS n FROM dots WHERE NOT (slot=2 AND tool_idx%7=0)) WHERE n<=3 GROUP BY ALL),
tr AS (SELECT query_id, 'cat' || label AS category, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, label) AS r FROM tm),
sp AS (SELECT i-1 AS shape, {list(SHAPES)}[i]::DOUBLE AS power FROM range(1, {len(SHAPES) + 1}) t(i)),
ps AS MATERIALIZED (SELECT query_id, category, shape, (1/pow(r, power))/sum(1/pow(r, power)) OVER (PARTITION BY query_id, shape) AS p FROM tr, sp),
gd AS (SELECT 'add' AS method, shape, (row_number() OVER (ORDER BY shape, i, j))-1 AS pos, [0.3,0.5,0.7][i]::DOUBLE AS alpha, [0.0,0.1,0.3,0.5,0.7][j]::DOUBLE AS beta, 0.0::DOUBLE AS lam, [0.0,0.1,0.3,0.5,0.7][j]::DOUBLE AS weight FROM sp, range(1,4) a(i), range(1,6) c(j)
 UNION ALL SELECT 'mult', shape, (row_number() OVER (ORDER BY shape, k))-1, 0.0, 0.0, [0.0,0.1,0.25,0.5,1.0][k]::DOUBLE, [0.0,0.1,0.25,0.5,1.0][k]::DOUBLE FROM sp, range(1,6) d(k)),
bs AS MATERIALIZED (SELECT b.split, b.query_id, b.tool_idx, b.is_gold, b.fold, b.s_multi, sp.shape, coalesce(ps.p, 0.0) AS p FROM b CROSS JOIN sp LEFT JOIN ps ON ps.query_id=b.query_id AND ps.category=b.category AND ps.shape=sp.shape),
tf AS (SELECT bs.split, query_id, tool_idx, is_gold, z.held, method, pos, CASE WHEN method='add' THEN alpha*(s_multi-mean)/std + beta*p ELSE s_multi*pow(greatest(p, 0.05), lam) END AS f FROM bs JOIN z ON z.split=bs.split AND fold<>held JOIN gd ON gd.shape=bs.shape),
tk AS (SELECT *, row_number() OVER (PARTITION BY query_id, held, method, pos ORDER BY f DESC, tool_idx) AS rk FROM tf),
th AS (SELECT split, query_id, held, method, pos, max(CASE WHEN is_gold THEN rk END) AS mg FROM tk GROUP BY ALL),
tc AS (SELECT split, held, method, pos, avg(CASE WHEN mg<=10 THEN 1.0 ELSE 0.0 END) AS recall FROM th GROUP BY ALL),
ch AS MATERIALIZED (SELECT * FROM (SELECT tc.*, shape, alpha, beta, lam, row_number() OVER (PARTITION BY split, held, tc.method ORDER BY recall DESC, weight, pos) AS n FROM tc JOIN gd USING (method, pos)) WHERE n=1)"""


def _joint(spark, sf_dir):
    b = _shaped_base(spark, sf_dir)
    z = fu.zscore_stats(b)
    return b, z, {m: fu.grid_search(b, m, z, len(SHAPES), zero=True) for m in ("add", "mult")}


@query(f"{_JOINT} SELECT method, split, CAST(held AS INTEGER) AS held, {list(SHAPES)}[CAST(shape AS INTEGER)+1]::DOUBLE AS power, alpha, beta, lam, round(recall, 4) AS recall FROM ch")
def joint_shape_search(spark, sf_dir):
    """Shape of the prior and coefficients together, on the other folds, with the weight 0 in the grid."""
    _, _, chosen = _joint(spark, sf_dir)
    power = F.get(F.array(*map(F.lit, SHAPES)), F.col("shape"))
    return reduce(DataFrame.unionByName, (c.select(F.lit(m).alias("method"), "split", "held", power.alias("power"), "alpha", "beta", "lam", F.round("recall", 4).alias("recall")) for m, c in chosen.items()))


@query(f"""{_JOINT}, uf AS (SELECT ch.method, bs.split, query_id, tool_idx, is_gold, CASE WHEN method='add' THEN alpha*(s_multi-round(mean, 6))/round(std, 6) + beta*p ELSE s_multi*pow(greatest(p, 0.05), lam) END AS f FROM bs JOIN z ON z.split=bs.split AND z.held=fold JOIN ch ON ch.split=bs.split AND ch.held=fold AND ch.shape=bs.shape),
um AS (SELECT method, split, query_id, max(CASE WHEN is_gold THEN rk END) AS mg FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY f DESC, tool_idx) AS rk FROM uf) GROUP BY ALL)
SELECT method, split, k, round(avg(CASE WHEN mg<=k THEN 1.0 ELSE 0.0 END), 4) AS recall, round(avg(mg), 2) AS maxgold_mean FROM um, (SELECT unnest([5,10,20,50]) AS k) GROUP BY ALL""")
def joint_shape_heldout(spark, sf_dir):
    """What the choices of ``joint_shape_search`` give on the folds that they have not seen."""
    b, z, chosen = _joint(spark, sf_dir)
    parts = []
    for m, c in chosen.items():
        ranked = rk.with_rank(fu.fuse(b, m, z, c, shapes=len(SHAPES)), "f", "query_id")
        worst = rk.worst_gold(ranked, "split", "query_id").withColumn("k", F.explode(F.array(*map(F.lit, KS))))
        parts.append(worst.groupBy("split", "k").agg(F.round(F.avg((F.col("maxgold") <= F.col("k")).cast("double")), 4).alias("recall"), F.round(F.avg("maxgold"), 2).alias("maxgold_mean")).withColumn("method", F.lit(m)))
    return reduce(DataFrame.unionByName, parts)
