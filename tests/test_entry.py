"""The driver contract, with and without the corpus operators."""

import duckdb
import pytest

import __spark_entry__ as entry
from shortlister import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("dense_multi_topk", "recall_sweep", "fold_assignment", "sweep_verdict", "scenario_prior", "segment_quota", "call_validity", "strict_success", "junk_flags", "pool_build", "segment_merge", "ece", "category_choice", "gate_m6", "name_fields")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.queries()) > 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({catalogue.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert plain([tuple(r[c] for c in cols) for r in df.collect()]) == plain(want)
