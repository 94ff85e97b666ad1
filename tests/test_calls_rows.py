"""Argument accuracy in one pass over the rows, and where rows of one key have to meet."""

from pyspark.sql import functions as F

from shortlister.operators.calls import argument_accuracy

SCHEMA = "id long, calls array<struct<name:string,args:map<string,string>>>, wanted array<struct<name:string,args:map<string,string>>>"


def _rows(spark):
    want = lambda *names: [(n, {"q": " A  b"}) for n in names]
    return spark.createDataFrame([
        (1, [("f", {"q": "x"}), ("f", {"q": "a b"})], want("f")),  # the first call counts
        (2, [("f", {"q": "A B"})], want("f", "g")),
        (3, [], want("f")),
        (4, [("f", {})], want("f")),
        (5, [("f", {"q": "a b"})], [("f", {})]),  # nothing required
        (6, [("f", {"q": "a b"})], []),
        (7, [("f", {"q": "a b"})], want("g")),
        (7, [("g", {"q": "a b"})], want("f")),
    ], SCHEMA)


def test_rows_of_one_key_meet_and_no_others(spark):
    rows = _rows(spark)
    repeated = rows.groupBy("id").count().where("count > 1").select("id")
    out = argument_accuracy(rows, ["q"], repeated, "id")
    assert {r.id: r.arg_acc for r in out.collect()} == {1: 0.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0, 7: 1.0}


def test_no_exchange_without_repeated_keys(spark):
    rows = _rows(spark).where("id < 7")
    out = argument_accuracy(rows, ["q"], rows.select("id").where(F.lit(False)), "id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.arg_acc for r in out.collect()} == {1: 0.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0}
