"""Plain-Python counterparts of column expressions, and invariants of rankings, fusion and rank shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shortlister import fixtures as fx
from shortlister.functions import calls as fc
from shortlister.functions import text as tx
from shortlister.operators import analysis as an
from shortlister.operators import calls as oc
from shortlister.operators import classify as cl
from shortlister.operators import effects as ef
from shortlister.operators import fusion as fu
from shortlister.operators import prep
from shortlister.operators import priors as pr
from shortlister.operators import ranking as rk
from shortlister.sources import io

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_segments(spark):
    s = lambda t, **k: one(spark, tx.merged_segments(F.lit(t), **k))
    assert s("Find a hotel in Paris. Then book a table for two!") == ["Find a hotel in Paris.", "Then book a table for two!"]
    assert s("The price is 3.5 dollars per unit. ok?") == ["The price is 3.5 dollars per unit. ok?"]
    assert s("東京の天気を調べてください今日。次に大阪の天気も調べてください。") == ["東京の天気を調べてください今日。", "次に大阪の天気も調べてください。"]
    assert s("") == [""] and s("  ") == ["  "] and s("ok.") == ["ok."]
    assert len(s("find the cheapest flight and then reserve a hotel room", conjunctions=True)) == 2


@pytest.mark.parametrize(
    ("text", "status", "names"),
    [
        ("<tool_call>\n<function=a>\n<parameter=q>\n 1 \n</parameter>\n</function>\n</tool_call>", "ok", ["a"]),
        ('<tool_call>{"name": "b", "arguments": {"q": 1}}</tool_call>', "ok", ["b"]),
        ('<tool_call>{"name": "b"}</tool_call><tool_call>{bad</tool_call>', "malformed", ["b"]),
        ("<function=c><parameter=k>v</parameter></function><function=d></function>", "ok", ["c"]),
        ("no idea", "no_call", []),
        ("<tool_call>[1]</tool_call>", "malformed", []),
    ],
)
def test_parsing(spark, text, status, names):
    r = oc.parsed(spark.createDataFrame([(text,)], "gen string")).first()
    assert r.gen_status == status and [c.name for c in r.calls] == names


def test_argument_forms(spark):
    args = lambda t: one(spark, fc.json_call(F.lit(t))["args"])
    assert args('{"name": "a", "arguments": {"x": 1, "y": "z"}}') == {"x": "1", "y": "z"}
    assert args('{"name": "a", "arguments": "{\\"x\\": 2}"}') == {"x": "2"}
    assert args('{"name": "a", "arguments": "free"}') == {"_value": "free"} and args('{"name": "a"}') == {}
    assert one(spark, fc.xml_call(F.lit("<function=f><parameter=k>1</parameter><parameter=k>2</parameter></function>"))["args"]) == {"k": "2"}


@pytest.mark.parametrize(("value", "kind", "ok"), [("5", "integer", True), ("5.0", "integer", False), (" -1_000 ", "integer", True), ("1e3", "number", True), ("nan", "number", True), ("x", "number", False), ("True", "boolean", True), ("[1]", "array", True), ("{}", "array", False), ('{"a": 1}', "object", True), ("x", "odd", True)])
def test_coercible(spark, value, kind, ok):
    assert one(spark, fc.coercible(F.lit(value), F.lit(kind))) is ok


@pytest.mark.parametrize(("i", "w"), [(0, 0), (5, 5), (8, 0), (3, 1), (30, 12)])
def test_mcnemar(spark, i, w):
    n, k = i + w, min(i, w)
    want = 1.0 if not n else min(1.0, 2 * sum(math.comb(n, j) for j in range(k + 1)) / 2**n)
    assert one(spark, ef.mcnemar_p(F.lit(i), F.lit(w))) == pytest.approx(want)


def test_quota_round_robin(spark):
    r = random.Random(1)
    rows = [(q, seg, t, r.randint(0, 5) / 5) for q in "abc" for seg in range({"a": 2, "b": 3, "c": 4}[q]) for t in range(12)]
    got = {}
    for x in an.quota_top_k(spark.createDataFrame(rows, "query_id string, seg int, tool_idx int, s double"), 7).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append(x.tool_idx)
    for q in "abc":
        by = {}
        for _, seg, t, s in (x for x in rows if x[0] == q):
            by.setdefault(seg, {})[t] = s
        order = lambda d: sorted(d, key=lambda t: (-d[t], t))
        union = order({t: max(d[t] for d in by.values()) for t in range(12)})
        picked = []
        if len(by) > 2:
            lists = [order(by[s]) for s in sorted(by) if s]
            picked = list(dict.fromkeys(x[i] for i in range(math.ceil(7 / len(lists))) for x in lists))[:7]
        assert got[q] == (picked + [t for t in union if t not in picked])[:7]


def test_average_precision(spark):
    rows = [("c", s, y) for s, y in ((0.9, 1.0), (0.8, 0.0), (0.8, 1.0), (0.1, 0.0))] + [("none", 0.5, 0.0)]
    out = cl.average_precision(spark.createDataFrame(rows, "category string, score double, y double"), "category").collect()
    assert [(r.category, round(r.ap, 6)) for r in out] == [("c", round(0.5 + 0.5 * 2 / 3, 6))]


def test_token_batches(spark):
    r = random.Random(2)
    items = [(i, r.randint(1, 30)) for i in range(60)]
    want, n, total, batch = {}, 0, 0, 0
    for i, t in items:
        if n and (n >= 4 or total + t > 50):
            batch, n, total = batch + 1, 0, 0
        want[i], n, total = batch, n + 1, total + t
    df = spark.createDataFrame([("g", *x) for x in items], "g string, i int, t int")
    assert {x.i: x.batch for x in prep.token_batches(df, "g", "i", "t", 4, 50).collect()} == want


def test_ranks_recall_and_beta_zero(spark):
    base = fx.base(spark, SF).withColumns({"s": F.col("s_multi"), "p": F.lit(0.0)}).cache()
    z = fu.zscore_stats(base)
    fused = rk.with_rank(fu.fuse(base, "add", z, fu.grid_search(base, "add", z)), "f", "query_id")
    plain = rk.with_rank(base, "s", "query_id")
    order = lambda d: {(r.query_id, r.tool_idx): r.rk for r in d.select("query_id", "tool_idx", "rk").collect()}
    assert order(fused) == order(plain)
    worst = rk.worst_gold(plain, "query_id").collect()
    assert all(w.maxgold >= 1 for w in worst)
    base.unpersist()


def test_rank_shapes_ignore_affine_changes(spark):
    r = random.Random(3)
    cs = spark.createDataFrame([(q, k, r.gauss(0, 1)) for q in "ab" for k in range(6)], "query_id string, label int, cs double")
    for shape, param in (("pow", 1.5), ("exp", 2.0), ("mass", 2)):
        get = lambda d: {(x.query_id, x.label): round(x.p, 9) for x in pr.shaped(d, shape, param).collect()}  # noqa: B023, E731
        assert get(cs) == get(cs.withColumn("cs", 0.001 * F.col("cs") + 0.9))


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"query_id": 1, "query": "q", "api_list": [{"category_name": "c", "required_parameters": [{"name": "n", "type": "t"}]}], "relevant APIs": [["t", "a"]]}]')
    r = io.read_json_array(spark, str(tmp_path / "a.json")).first()
    assert r.query_id == "1" and r["relevant APIs"] == [["t", "a"]] and r.api_list[0].required_parameters[0].name == "n"
    out = tmp_path / "res"
    out.mkdir()
    (out / "retrieval_I1_dense_multi_10.jsonl").write_text('{"query_id": "x"}\n\n{"query_id": "é"}\n')
    (out / "other.jsonl").write_text('{"query_id": "y"}\n')
    rows = io.read_results(spark, str(out), "query_id string", io.RETRIEVAL_NAME, "split", "method", "k").collect()
    assert sorted(map(tuple, rows)) == [("x", "I1", "dense_multi", "10"), ("é", "I1", "dense_multi", "10")]
    assert io.first_existing(spark, [str(tmp_path / "none"), str(out)]) == str(out)
    with pytest.raises(FileNotFoundError):
        io.first_existing(spark, [str(tmp_path / "none")])
    (tmp_path / "c.yaml").write_text("paths:\n  root: data\n  sub: ${root}/x\nseed: 1\n")
    assert io.load_config(str(tmp_path / "c.yaml"))["paths"]["sub"] == str(tmp_path / "data/x")
