"""Queries that need a few rows of each query write no table of all products, and give the rows of their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_entry import SF, TABLES

from shortlister import catalogue
from shortlister import fixtures as fx
from shortlister.functions.vectors import dot_of
from shortlister.operators import cells

REDUCED = (
    "grid_search_add",
    "grid_search_mult",
    "coeff_distribution",
    "fusion_add_real",
    "fusion_add_oracle",
    "fusion_mult_oracle",
    "fusion_mult_real",
    "fusion_reuse_gap",
    "cluster_max_prior",
    "cluster_oracle_prior",
    "gate_search",
    "gate_search_heldout",
    "exclusion_rule",
    "gate_m5",
    "arg_accuracy",
    "call_to_tool",
    "call_validity",
    "completeness",
    "conclusions_a",
    "fig1_series",
    "gate_m6",
    "condition_runs",
    "confusion_topn",
    "contrastive_ab",
)


def _plain(rows):
    return sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", REDUCED)
def test_no_table_of_all_products(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("all products are written")

    for table in ("dots", "scores", "base"):
        monkeypatch.setattr(fx, table, refuse)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalogue.oracle_sql()[name]})").fetchall()
    assert _plain(tuple(r[c] for c in cols) for r in df.collect()) == _plain(want)


def test_heads_hold_what_can_be_first(spark):
    heads = {(r.query_id, r.tool_idx): r for r in fx.heads(spark, SF).collect()}
    own = Window.partitionBy("query_id", "category")
    rows = fx.scores(spark, SF).join(fx.tools(spark, SF), "tool_idx").withColumn("place", F.row_number().over(own.orderBy(F.desc("s_multi"), "tool_idx"))).collect()
    for r in rows:
        found = heads.get((r.query_id, r.tool_idx))
        assert found is not None or not (r.is_gold or r.place <= fx.HEAD_K)
        if found:
            assert (found.s_multi, found.s_single, found.is_gold) == (r.s_multi, r.s_single, r.is_gold)


def test_products_equal_those_of_the_expression(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(40, 9)), rng.normal(size=(600, 9))
    mine = cells.dots(pa.array(a.tolist()), pa.array(b.tolist()), 9)
    rows = spark.createDataFrame([(i, j, a[i].tolist(), b[j].tolist()) for i in (0, 33, 39) for j in range(600)], "i int, j int, a array<double>, b array<double>")
    for r in rows.select("i", "j", dot_of(F.col("a"), F.col("b"), 9).alias("d")).collect():
        assert mine[r.i, r.j] == r.d
    odd = cells.dots(pa.array([[1.0, 2.0], None]), pa.array([[1.0, 1.0], [1.0], [None, 1.0]], pa.list_(pa.float64())), 2)
    assert odd.tolist() == [[3.0, -np.inf, -np.inf], [-np.inf] * 3]


def test_equal_scores_are_all_kept():
    key = np.array([[3.0, 1.0, 2.0, 2.0, 2.0, 0.0]])
    assert cells.leading(key, 2).tolist() == [[True, False, True, True, True, False]]
    assert cells.leading(key, 2, 1.0).tolist() == [[True, True, True, True, True, False]]
    assert cells.leading(key, 2, np.inf).all()


def test_nearest_tools_leave_their_cells_few(spark, monkeypatch):
    """Pairs are reduced within a cell, with several blocks on each side: no operator of Spark meets them all."""
    from shortlister.operators import priors
    from shortlister.operators.priors import nearest

    monkeypatch.setattr(priors, "LEFT", 4)
    monkeypatch.setattr(priors, "RIGHT", 9)

    rows = [(i, i // 2, [float(i % 5), float(i % 3)]) for i in range(30)]
    near = nearest(spark.createDataFrame(rows, "tool_idx int, service int, vec array<double>"), 2)
    assert "MapInArrow" in near._jdf.queryExecution().toString()
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    want = {(a[0], b[0], n + 1) for a in rows for n, b in enumerate(sorted((b for b in rows if b[1] != a[1]), key=lambda b: (-score(a, b), b[0]))[:2])}
    assert {(r.tool_idx, r.other, r.rk) for r in near.collect()} == want


def _whole_cell(monkeypatch):
    """Cells of this process: the function of a cell gets all of both sides."""
    met = {}
    monkeypatch.setattr(cells, "dimension", lambda _: 5)
    monkeypatch.setattr(cells, "spread", lambda *_: None)
    monkeypatch.setattr(cells, "reduce_cells", lambda left, right, a, b, f, schema: met.update(f=f) or _Rows())
    return met


class _Rows:
    def __getattr__(self, _):
        return lambda *a, **b: self


def _sides(rng, odd=False):
    q = rng.normal(size=(150, 5))
    v = np.repeat(rng.normal(size=(40, 5)), 3, axis=0) * (1 + 1e-16 * rng.integers(0, 9, size=(120, 1)))  # many that rounding alone tells apart
    if odd:
        v[3, 2] = np.inf
    vectors = v.tolist()
    vectors[7] = None
    queries = {"split": pa.array(["I1"] * 150), "query_id": pa.array([f"q{i}" for i in range(150)]), "q_ord": pa.array(range(150)), "vec": pa.array(q.tolist())}
    slots = {"tool_idx": pa.array([i // 3 for i in range(120)], pa.int32()), "slot": pa.array([i % 3 for i in range(120)], pa.int32()), "label": pa.array([i // 3 % 2 for i in range(120)], pa.int32()), "vec": pa.array(vectors)}
    return queries, slots, cells.dots(queries["vec"], slots["vec"], 5)


@pytest.mark.parametrize("odd", [False, True])
def test_cells_hold_the_sums_of_the_expression_whatever_blas_gives(monkeypatch, odd):
    rng = np.random.default_rng(3)
    queries, slots, d = _sides(rng, odd)
    met, near, plain = _whole_cell(monkeypatch), cells.near_dots, cells.dots

    def off(q, v):
        out, slack = near(q, v)
        return out + slack * rng.uniform(-0.9, 0.9, out.shape), slack

    monkeypatch.setattr(cells, "near_dots", off)
    if not odd:  # finite vectors need no sums of all pairs
        monkeypatch.setattr(cells, "dots", lambda *_: pytest.fail("all pairs are summed in order"))
    key = cells.order_key(d)
    multi, order = key.reshape(150, 40, 3).max(axis=2), lambda x: np.lexsort((np.arange(len(x)), -x))
    cells.cell_heads(None, None, 4, 5, 6, 0.0)
    rows = [r for b in met["f"](queries, slots) for r in b.to_pylist()]
    heads = {(r["query_id"], r["tool_idx"]): r for r in rows if r["kind"] == 0}
    found = {(r["query_id"], r["tool_idx"], r["slot"]): r["s_multi"] for r in rows if r["kind"] == 1}
    for i in range(150):
        want = {int(t) for c in (0, 1) for t in [t for t in order(multi[i]) if t % 2 == c][:4]} | {int(t) for t in order(key[i, ::3])[:5]}
        assert all((f"q{i}", t) in heads for t in want)
        for s in order(key[i])[:6]:
            assert found[f"q{i}", s // 3, s % 3] == (d[i, s] if d[i, s] != -np.inf else None) or np.isnan(d[i, s])
    for (q, t), r in heads.items():
        have = [x for x in d[int(q[1:]), 3 * t : 3 * t + 3] if x != -np.inf]
        assert r["s_multi"] == max(have) or np.isnan(have).any()

    last = np.sort(np.where(np.isfinite(multi), multi, 0.0), axis=1)[:, 20]
    cells.count_before(type("Q", (), {})(), None, [None])
    asked = queries | {"last": pa.array([[x] for x in last]), "at": pa.array([[7]] * 150)}
    above = {r["query_id"]: r["above"] for b in met["f"](asked, slots) for r in b.to_pylist()}
    assert above == {f"q{i}": int(sum(multi[i] > last[i]) + sum(multi[i, :7] == last[i])) for i in range(150)}

    cells.most_similar(_Rows(), _Rows())
    m = [x for b in met["f"](queries, slots) for x in b.column("m").to_pylist()]
    top = plain(queries["vec"], slots["vec"], 5).max(axis=0)
    assert all(x == y or (x is None and y == -np.inf) or np.isnan(y) for x, y in zip(m, top))


def test_blocks_travel_as_bytes(spark):
    """A cell gets all columns of its two blocks, however many streams they came in; only bytes are dealt to the cells."""
    rows = [(i, f"k{i}", [float(i), None] if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "n int, key string, vec array<double>").repartition(3)

    def f(a, b):
        yield pa.RecordBatch.from_pydict({"left": a["n"].take(pa.array([0] * len(b["n"]))), "n": b["n"], "key": b["key"], "vec": b["vec"], "size": pa.array([len(a["n"])] * len(b["n"]))})

    met = cells.reduce_cells(df, df, cells.spread(df, "n", 20), cells.spread(df, "key", 30), f, "left int, n int, key string, vec array<double>, size long")
    assert met._jdf.queryExecution().toString().count("MapInArrow") >= 3
    found = met.collect()
    assert sorted((r.n, r.key, r.vec) for r in found) == sorted(r for r in rows for _ in range(3))
    assert {n: sum(r.size for r in found if r.n == n) for n in range(50)} == {n: 50 for n in range(50)}


@pytest.mark.parametrize("odd", [False, True])
def test_gates_count_by_the_sums_of_the_expression(monkeypatch, odd):
    rng = np.random.default_rng(3)
    queries, slots, d = _sides(rng, odd)
    met, near = _whole_cell(monkeypatch), cells.near_dots
    multi = cells.order_key(d).reshape(150, 40, 3).max(axis=2)

    def off(q, v):
        out, slack = near(q, v)
        return out + slack * rng.uniform(-0.9, 0.9, out.shape), slack

    monkeypatch.setattr(cells, "near_dots", off)
    if not odd:  # finite vectors need no sums of all pairs
        monkeypatch.setattr(cells, "dots", lambda *_: pytest.fail("all pairs are summed in order"))
    cells.count_before_sets(None, None, None, 1)
    ids, want, asked = [], {}, []
    for i in range(0, 150, 2):
        ids += [(f"q{i}", s, f"q{i + s}") for s in (0, 1)]
        tries = []
        for mask in (1, 3):
            u = multi[i] if mask == 1 else multi[i : i + 2].max(axis=0)
            t = int(np.argsort(np.where(np.isfinite(u), -u, 9e9), kind="stable")[20])
            tries.append({"mask": mask, "last": float(u[t]), "at": t})
            want[f"q{i}", mask] = int(sum(u > u[t]) + sum(u[:t] == u[t]))
        asked += [tries, None]
    name, seg, of = zip(*ids)
    block = {"query_id": pa.array(name), "seg": pa.array(seg), "of": pa.array(of), "vec": queries["vec"], "asked": pa.array(asked)}
    assert {(r["query_id"], r["mask"]): r["above"] for b in met["f"](block, slots) for r in b.to_pylist()} == want


def test_cluster_priors_take_a_value_for_each_query_and_category(spark):
    """What is the same for all tools of a category is not made for each pair of query and tool."""
    for name in ("cluster_max_prior", "cluster_oracle_prior"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "round(" not in plan and "array_contains" not in plan


@pytest.mark.parametrize("name", ["conclusions_a", "fig1_series", "gate_m6"])
def test_only_the_first_event_of_a_combination_is_parsed(spark, monkeypatch, name):
    from shortlister.plans import analysis

    met, parsed = [], analysis.oc.parsed
    monkeypatch.setattr(analysis.oc, "parsed", lambda rows: met.append(rows.count()) or parsed(rows))
    catalogue.queries()[name](spark, SF)
    e = fx.asked(spark, SF).where("event_id is not null")
    k = F.expr("case when user_id % 5 = 0 then 0 when (event_id div 2) % 2 = 0 then 5 else 10 end")
    assert met == [e.select("q_ord", F.col("event_id") % 2, F.col("user_id") % 5, k).distinct().count()] and met[0] < e.count()
