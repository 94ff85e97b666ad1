"""Fusions search and rank in numpy what each query's cells give, and events are told apart without patterns where they can be."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_entry import SF

from shortlister import catalogue, tables
from shortlister import fixtures as fx
from shortlister.functions import calls as fc
from shortlister.operators import cells
from shortlister.operators import fusion as fu
from shortlister.plans import ranking


@pytest.mark.parametrize("name", ["fusion_add_oracle", "fusion_add_real", "fusion_mult_oracle", "fusion_reuse_gap"])
def test_fusions_make_no_row_for_each_tool(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("a row for each tool")

    for f in ("grid_search", "fuse", "gold_ranks"):
        monkeypatch.setattr(fu, f, refuse)
    monkeypatch.setattr(fx, "head", refuse)
    assert catalogue.queries()[name](spark, SF).count()


@pytest.mark.parametrize("method", ["add", "mult"])
@pytest.mark.parametrize("prior", ["p_oracle", "p_real"])
def test_packed_searches_choose_what_the_rows_do(spark, method, prior):
    name, missing = ranking._PACKED[prior]
    packed = fx.packed(spark, SF)
    stats = fu.packed_stats(packed)
    rows, z = ranking._head(spark, SF, prior)
    assert {(r.split, r.held): (r.mean, r.std) for r in z.collect()} == {k: pytest.approx(v, rel=1e-12) for k, v in stats.items()}
    chosen = fu.search_packed(packed, method, name, stats, missing)
    assert chosen == {(r.split, r.held): (r.alpha, r.beta, r.lam) for r in fu.grid_search(rows, method, z).collect()}


def test_places_of_equal_and_missing_scores():
    tools, value, of = np.array([5, 1, 2, 9, 0, 3]), np.array([1.0, 1.0, np.nan, -np.inf, -np.inf, 2.0]), np.zeros(6, int)
    order = cells.descending(tools, value, of)
    assert tools[order].tolist() == [2, 3, 1, 5, 0, 9]
    assert cells.places(order, of).tolist() == [4, 3, 1, 6, 5, 2]


def test_gold_of_a_query_without_scores_stands_by_place():
    tools = [{"tool_idx": t, "label": 1, "known": True, "s_multi": None, "s_single": None, "is_gold": t == g, "p_own": 1.0, "p_near": 0.0} for t in range(12) for g in (2,)]
    none = [x | {"is_gold": x["tool_idx"] == 11} for x in tools]
    kind = pa.list_(pa.struct([("tool_idx", pa.int32()), ("label", pa.int32()), ("known", pa.bool_()), ("s_multi", pa.float64()), ("s_single", pa.float64()), ("is_gold", pa.bool_()), ("p_own", pa.float64()), ("p_near", pa.float64())]))
    x = fu.Packed(pa.RecordBatch.from_pydict({"split": pa.array(["I1"] * 2), "query_id": pa.array(["a", "b"]), "q_ord": pa.array([0, 1]), "fold": pa.array([0, 0], pa.int32()), "tools": pa.array([tools, none], kind)}))
    for method in ("add", "mult"):
        assert x.hits(x.fused(method, x.prior("p_own", None), [(0.0, 1.0, 0.5, 0.3, 0.1)] * 2), 10).tolist() == [True, False]


@pytest.mark.parametrize("name", ["gate_m5", "exclusion_rule"])
def test_candidates_of_calls_make_no_row_for_each_tool(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("a row for each tool")

    monkeypatch.setattr(fx, "heads", refuse)
    monkeypatch.setattr(fx, "tools", refuse)
    tables._kept.clear()
    assert catalogue.queries()[name](spark, SF).count()


def test_a_block_is_a_call_if_a_parser_gives_one(spark):
    texts = ["", "{", "}", '{"name": broken', '{"name": broken}', '{"name": "f"}', '{"name": "f"} and more', ' {"n\\u0061me": "f"}', '{"name": null}', '{"name": 3}', '{"names": "f"}', "[1]", "<function=f></function>", "<function=f>", "</function><function=f>", "<function=>x</function>", "<function=f >a<function=g>b</function>", '{"name": "<function=f></function>"', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    assert "Contains" in rows.select(fc.is_call(t))._jdf.queryExecution().analyzed().toString().title()
    for r in rows.select("t", F.coalesce(fc.is_call(t), F.lit(False)).alias("is"), F.coalesce(fc.xml_call(t), fc.json_call(t)).isNotNull().alias("gives")).collect():
        assert r["is"] == r["gives"], r
