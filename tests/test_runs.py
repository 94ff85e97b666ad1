"""Numbering by ranges, batches, searches against plain versions, sources and sinks, caches, runs."""

import ast
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shortlister import models, tables
from shortlister.operators import analysis as an
from shortlister.operators import fusion as fu
from shortlister.operators import prep
from shortlister.operators.runner import candidate_schemas, run_conditions
from shortlister.plans.running import scripted
from shortlister.sources import io
from shortlister.streaming.records import score_arrivals


@pytest.mark.parametrize(("seed", "items", "tokens"), [(1, 4, 50), (2, 8, 1000), (3, 1, 5), (4, 30, 90)])
def test_token_batches_over_ranges(spark, seed, items, tokens):
    r = random.Random(seed)
    rows = [(g, i, r.randint(0, 30)) for g, n in (("a", 300), ("b", 1), ("c", 7), (None, 40)) for i in range(n)]
    want = {}
    for g in ("a", "b", "c", None):
        n, total, batch = 0, 0, 0
        for _, i, t in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            if n and (n >= items or total + t > tokens):
                batch, n, total = batch + 1, 0, 0
            want[g, i], n, total = batch, n + 1, total + t
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, t int")
    assert {(x.g, x.i): x.batch for x in prep.token_batches(df, "g", "i", "t", items, tokens).collect()} == want
    assert prep.token_batches(df.limit(0), "g", "i", "t").collect() == []


def test_places_and_running_sums(spark):
    r = random.Random(5)
    rows = [(r.choice(["x", "y", None]), r.randint(0, 20), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, s int, i int")
    for g in ("x", "y", None):
        own = sorted((s, i) for h, s, i in rows if h == g)
        found = tables.placed(df, ["g"], [F.col("s"), F.col("i")]).where(F.col("g").eqNullSafe(g)).orderBy("place").collect()
        assert [(x.s, x.i, x.place) for x in found] == [(*x, k) for k, x in enumerate(own)]
        sums = tables.running(df, ["g"], [F.col("s"), F.col("i")], total=F.col("s")).where(F.col("g").eqNullSafe(g)).orderBy("s", "i").collect()
        assert [x.total for x in sums] == np.cumsum([s for s, _ in own]).tolist()
    assert sorted(x.place for x in tables.placed(df, [], [F.col("s")]).collect()) == list(range(400))


def test_a_table_is_written_again_when_its_input_changes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t"))

    for rows in (3, 3):
        assert tables.once(spark, "test", [str(tmp_path / "t")], build).count() == rows
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t"))
    assert tables.once(spark, "test", [str(tmp_path / "t")], build).count() == 5 and len(made) == 2


@pytest.mark.parametrize("method", ["add", "mult"])
def test_grid_search_is_that_of_whole_rankings(spark, method):
    r = random.Random(7)
    rows = [("S", f"q{q}", t, q % 5, r.randint(0, 4) / 4, [r.randint(0, 2) / 2, r.randint(0, 2) / 2], t in r.sample(range(12), 2) if q else False) for q in range(15) for t in range(12)]
    base = spark.createDataFrame(rows, "split string, query_id string, tool_idx int, fold int, s double, ps array<double>, is_gold boolean")
    z = {x.held: (x["mean"], x["std"]) for x in fu.zscore_stats(base).collect()}
    got = {x.held: (x.shape, x.pos, round(x.recall, 9)) for x in fu.grid_search(base, method, fu.zscore_stats(base), 2, zero=True, k=3).collect()}
    grid = fu.grid(spark, method, 2, True).collect()
    for held in range(5):
        train = [x for x in rows if x[3] != held]
        scores = [x[4] for x in train]
        assert z[held] == pytest.approx((np.mean(scores), np.std(scores)))
        best = None
        for g in grid:
            hits = []
            for q in sorted({x[1] for x in train}):
                f = lambda x: g.alpha * (x[4] - z[held][0]) / z[held][1] + g.beta * x[5][g["shape"]] if method == "add" else x[4] * max(x[5][g["shape"]], 0.05) ** g.lam  # noqa: B023, E731
                ranked = sorted((x for x in train if x[1] == q), key=lambda x: (-f(x), x[2]))
                hits.append(all(not x[6] for x in ranked[3:]))
            key = (round(np.mean(hits), 9), -g.weight, -g.pos)
            best = max(best, (key, g)) if best else (key, g)
        assert got[held] == (best[1]["shape"], best[1].pos, best[0][0])


def test_gates_keep_one_segment_at_least(spark):
    segments = spark.createDataFrame([("a", 1, 0.1, 0.5), ("a", 2, 0.3, 0.5), ("b", 1, 0.6, 0.6), ("b", 2, 0.59, 0.6)], "query_id string, seg int, m double, m_full double")
    kept = {(x.query_id, x.gate, x.param): (x.kept, round(x["drop"], 3)) for x in an.gated_sets(segments).collect()}
    assert kept["a", "abs", 0.4] == ([2], 0.5) and kept["b", "abs", 0.5] == ([1, 2], 0.0) and kept["a", "none", 0.0] == ([1, 2], 0.0)
    assert kept["b", "rel", 0.02] == ([1, 2], 0.0) and kept["a", "rel", 0.01] == ([2], 0.5) and kept["b", "rank", 1.0] == ([1], 0.5)


LITERALS = ["[1, 'a', None]", "['None of it', True]", '["x", 1]', "[(1, 2)]", "{'a': 1}", "[broken", "['it''s']", "", None, " ['a']", "['\\n']", "[True, False]", "['a\"b']"]


def test_lenient_json(spark):
    got = {r.i: r.j for r in spark.createDataFrame(list(enumerate(LITERALS)), "i int, t string").select("i", io.lenient_json(F.col("t")).alias("j")).collect()}
    for i, t in enumerate(LITERALS):
        try:
            v = ast.literal_eval((t or "").strip())
        except (ValueError, SyntaxError):
            v = None
        want = json.loads(json.dumps(v)) if isinstance(v, list) else None
        assert (None if got[i] is None else json.loads(got[i])) == want, t


def test_mirror_counts_a_repeated_id_once(spark, tmp_path):
    api = [{"category_name": "c", "tool_name": "t", "api_name": "a"}]
    rows = [("1", "q1", json.dumps(api), "[['t', 'a']]"), ("1", "again", "[]", "[]"), ("2", "q2", str(api), None)]
    spark.createDataFrame(rows, "query_id string, query string, api_list string, relevant_apis string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    (tmp_path / "m" / "data").mkdir(parents=True)
    next((tmp_path / "raw").glob("*.parquet")).rename(tmp_path / "m" / "data" / "g1-0.parquet")
    got = {r.query_id: r for r in io.read_mirror(spark, str(tmp_path / "m"), "g1").collect()}
    assert got.keys() == {"1", "2"} and got["1"].query == "q1" and got["1"]["relevant APIs"] == [["t", "a"]] and got["2"].api_list[0].api_name == "a"


def test_sinks_keep_what_is_there_unless_forced(spark, tmp_path):
    one, two = spark.createDataFrame([(1, "é")], "i int, t string"), spark.createDataFrame([(2, "b"), (3, None)], "i int, t string")
    for write, read in ((io.write_jsonl, lambda p: spark.read.schema("i int, t string").json(p)), (io.write_csv, lambda p: spark.read.schema("i int, t string").csv(p, header=True)), (lambda d, p, **k: io.write_table(d, p, "i", **k), spark.read.parquet)):
        path = str(tmp_path / f"out{id(write)}")
        write(one, path)
        write(two, path)
        assert [(r.i, r.t) for r in read(path).collect()] == [(1, "é")]
        write(two, path, force=True)
        assert sorted(r.i for r in read(path).collect()) == [2, 3]
    found, why = io.read_optional(spark, str(tmp_path / "no.jsonl"), "i int")
    assert found is None and "no.jsonl" in why
    (tmp_path / "yes.jsonl").write_text('{"i": 5}\n')
    assert io.read_optional(spark, str(tmp_path / "yes.jsonl"), "i int")[0].first().i == 5


def test_vectors_to_files_and_back(spark, tmp_path):
    m = np.arange(60, dtype=np.float32).reshape(20, 3)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "i int, vec array<double>").repartition(5)
    io.write_npy(df, str(tmp_path / "v"), "i")
    assert {r.i: r.vec for r in io.read_npy(spark, str(tmp_path / "v")).collect()} == {i: v.tolist() for i, v in enumerate(m)}


def test_cached_vectors_embed_each_text_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embedder():
        def embed(texts):
            for t in texts:
                (calls / f"{abs(hash(t))}-{random.random()}").write_text(t)
            return [[float(len(t))] for t in texts]

        return embed

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("bb", 3), (None, 4)], "t string, i int")
    for _ in range(2):
        got = {r.i: r.vec for r in models.cached_vectors(rows, "t", embedder, str(tmp_path / "cache")).collect()}
        assert got == {1: [10.0], 2: [10.0], 3: [11.0], 4: None}
    assert sorted(p.read_text() for p in calls.iterdir()) == ["passage: a", "passage: bb"]


def test_models_are_saved_and_loaded(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.linalg import Vectors

    train = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2), 1.0])) for i in range(20)], ["label", "features"])
    fitted = {"one": LogisticRegression(maxIter=3).fit(train)}
    models.save_models(fitted, str(tmp_path / "m"))
    assert models.load_models(str(tmp_path / "m"), ["one"], LogisticRegressionModel)["one"].coefficients == fitted["one"].coefficients


def test_prompt_batches():
    assert [(s.start, s.stop) for s in models.batches_of([5, 5, 5, 20, 1, 1, 1], 2, 12)] == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(models.batches_of([], 2, 12)) == []


def test_schemas_keep_the_order_and_drop_unknown_ids(spark):
    candidates = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("q", 0, "lost"), ("r", 0, "lost")], "query_id string, pos int, id string")
    known = spark.createDataFrame([("a", "A", "{1}"), ("b", "B", "{2}")], "id string, name string, schema string")
    got = {r.query_id: ([c.id for c in r.candidates], r.schemas) for r in candidate_schemas(candidates, known, "query_id").collect()}
    assert got == {"q": (["a", "b"], ["{1}", "{2}"]), "r": ([], [])}


def test_runs_append_only_what_is_missing(spark, tmp_path):
    q = spark.createDataFrame([("I1", "q1", "x", ["a"]), ("I1", "q2", "y", ["b"])], "split string, query_id string, query string, gold array<string>")
    known = spark.createDataFrame([(i, i.upper(), json.dumps({"name": i.upper()})) for i in "ab"], "id string, name string, schema string")
    rows = [("I1", "oracle_tool", 2, x, i, t) for x in ("q1", "q2") for i, t in enumerate("ab")]
    schema = "split string, condition string, k int, query_id string, pos int, id string"
    target = str(tmp_path / "t")
    run = lambda c, **k: run_conditions(q, spark.createDataFrame(c, schema), known, {"weak": scripted(False)}, target, (2,), **k).collect()
    missing = run(rows)
    assert ("full", "no candidates") in {(r.condition, r.reason) for r in missing} and len(missing) == 8
    got = lambda: {(r.condition, r.query_id): r.func_acc for r in spark.read.parquet(target).collect()}
    assert got() == {("oracle_tool", "q1"): 0.0, ("oracle_tool", "q2"): 1.0}
    run(rows + [("I1", "full", 0, "q1", 0, "a")])
    assert spark.read.parquet(target).count() == 3 and got()["full", "q1"] == 1.0
    run(rows, force=True)
    assert spark.read.parquet(target).count() == 3


def test_arrivals_are_scored_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = {"gen": '<tool_call>{"name": "a", "arguments": {"q": "1"}}</tool_call>', "candidates": [{"id": "a", "name": "a"}], "gold": ["a"], "split": "I1"}
    schema = "gen string, candidates array<struct<id:string,name:string>>, gold array<string>, split string"
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(record) + "\n")
        score_arrivals(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), "split").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 2 and all(r.exact_match == 1.0 for r in out)


def test_report_lines(spark):
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "n string, k int, v double")
    assert [r.text for r in an.text_lines(rows, ["n"], {"n": -3, "k": 3, "v": 8}).orderBy("line").collect()] == ["a    1  0.5000", "b    2       -"]
