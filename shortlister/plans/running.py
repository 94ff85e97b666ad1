"""Runs of conditions with scripted generators, closed-list prompts, and reports as text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import models
from ..functions.calls import sanitize
from ..operators import analysis as an
from ..operators import ranking as rk
from ..operators.runner import run_conditions
from ..tables import scratch
from .fixture_sql import FX1

QUERIES, ORACLES = {}, {}
KS = (2, 5)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scripted(first: bool):
    """A generator that calls the first or the last tool of its prompt; without tools it only talks."""

    def make():
        def answer(text: str) -> str:
            lines = text.split("<|tools|>\n", 1)[1].split("<|end|>", 1)[0].splitlines()
            if not lines:
                return "There is nothing to call."
            name = json.loads(lines[0 if first else -1])["name"]
            return '<tool_call>{"name": "%s", "arguments": {"q": "x"}}</tool_call>' % name

        return lambda prompts: [answer(p) for p in prompts]

    return make


def _tools(spark, sf_dir):
    t = fx.tools(spark, sf_dir).select("tool_idx", "id", sanitize(F.col("id")).alias("name"))
    return t.withColumn("schema", F.to_json(F.struct("name", F.lit("object").alias("type"))))


def _candidates(spark, sf_dir):
    """Conditions: gold and others up to K, both rankings up to K; the split I3 has no ranking by single vectors."""
    s = fx.heads(spark, sf_dir).join(fx.tools(spark, sf_dir).select("tool_idx", "id"), "tool_idx")
    s = rk.with_rank(rk.with_rank(s, "s_multi", "query_id", name="rm"), "s_single", "query_id", name="rs")
    s = rk.with_rank(s, F.col("is_gold").cast("int") * 10 + F.col("s_multi"), "query_id", name="ro")
    parts = []
    for condition, place in (("oracle_tool", "ro"), ("retrieved_dense_multi", "rm"), ("retrieved_dense_single", "rs")):
        for k in KS:
            rows = s.where(F.col(place) <= k)
            rows = rows.where("split <> 'I3'") if condition == "retrieved_dense_single" else rows
            parts.append(rows.select("split", F.lit(condition).alias("condition"), F.lit(k).alias("k"), "query_id", F.col(place).alias("pos"), "id"))
    # One candidate that the catalogue lacks: it gets no schema.
    parts.append(fx.queries(spark, sf_dir).select("split", F.lit("oracle_tool").alias("condition"), F.lit(KS[0]).alias("k"), "query_id", F.lit(0).alias("pos"), F.lit("unknown__tool").alias("id")))
    return reduce(DataFrame.unionByName, parts)


_RUN = f"""{FX1}, c0 AS (SELECT s.*, id, row_number() OVER (PARTITION BY query_id ORDER BY s_multi DESC, s.tool_idx) AS rm, row_number() OVER (PARTITION BY query_id ORDER BY s_single DESC, s.tool_idx) AS rs,
 row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN is_gold THEN 10 ELSE 0 END+s_multi DESC, s.tool_idx) AS ro FROM s JOIN tool USING (tool_idx)),
c1 AS (SELECT split, query_id, id, is_gold, condition, k, place FROM (SELECT split, query_id, id, is_gold, unnest(['oracle_tool','retrieved_dense_multi','retrieved_dense_single']) AS condition, unnest([ro, rm, rs]) AS place FROM c0), (SELECT unnest([2,5]) AS k) WHERE place<=k AND NOT (split='I3' AND condition='retrieved_dense_single')),
g1 AS (SELECT split, query_id, count(*) AS ng FROM s WHERE is_gold GROUP BY ALL),
r1 AS (SELECT c1.split, c1.query_id, condition, k, model, arg_min(is_gold, CASE WHEN model='strong' THEN place ELSE -place END) AS hit, max(ng) AS ng, count(*) FILTER (is_gold) AS inside FROM c1, (SELECT unnest(['strong','weak']) AS model), g1 WHERE g1.query_id=c1.query_id GROUP BY ALL),
r2 AS (SELECT split, model, condition, k, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS func_acc, round(avg(CASE WHEN hit AND ng=1 THEN 1.0 ELSE 0.0 END), 4) AS completeness, count(*) FILTER (NOT (hit AND ng=1) AND inside<ng) AS retrieval_miss FROM r1 GROUP BY ALL),
gr AS (SELECT split, model, condition, k FROM (SELECT unnest(['I1','I2','I3']) AS split), (SELECT unnest(['strong','weak']) AS model), (SELECT 'full' AS condition, 0 AS k UNION ALL SELECT unnest({list(an.CONDITIONS)}), 2 UNION ALL SELECT unnest({list(an.CONDITIONS)}), 5))"""


@query(f"{_RUN} SELECT gr.split, gr.model, gr.condition, gr.k, coalesce(n, 0) AS n, func_acc, completeness, coalesce(retrieval_miss, 0) AS retrieval_miss, CASE WHEN n IS NULL THEN 'no candidates' ELSE '' END AS reason, 0 AS added_again FROM gr LEFT JOIN r2 ON r2.split=gr.split AND r2.model=gr.model AND r2.condition=gr.condition AND r2.k=gr.k")
def condition_runs(spark, sf_dir):
    """A run with scripted generators, then again, which finds nothing left to add."""
    target = scratch(spark, "runs")
    q = fx.queries(spark, sf_dir).select("split", "query_id", F.concat(F.lit("request "), "query_id").alias("query"))
    gold = fx.heads(spark, sf_dir).where("is_gold").join(fx.tools(spark, sf_dir).select("tool_idx", "id"), "tool_idx").groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("gold"))
    given = q.join(gold, "query_id"), _candidates(spark, sf_dir), _tools(spark, sf_dir), {"strong": scripted(True), "weak": scripted(False)}, target, KS
    run_conditions(*given)
    n = spark.read.parquet(target).count()
    missing = run_conditions(*given)
    records = spark.read.parquet(target).select(*(F.col(c) for c in ("split", "model", "condition")), F.col("k").cast("int").alias("k"), "func_acc", "completeness", "miss_type")
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    found = records.groupBy(*an.KEY).agg(F.count("*").alias("n"), mean("func_acc"), mean("completeness"), F.count_if(F.col("miss_type") == "retrieval_miss").alias("retrieval_miss"))
    grid = an.expected(spark, fx.SPLITS, ("strong", "weak"), KS).drop("pos")
    again = records.count() - n
    out = grid.join(found, list(an.KEY), "left").join(missing, list(an.KEY), "left")
    return out.select(*an.KEY, F.coalesce("n", F.lit(0)).alias("n"), "func_acc", "completeness", F.coalesce("retrieval_miss", F.lit(0)).alias("retrieval_miss"), F.coalesce("reason", F.lit("")).alias("reason"), F.lit(again).cast("int").alias("added_again"))


@query("""WITH c AS (SELECT string_agg(lang, ', ' ORDER BY lang) AS names FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT item_id, length(names) AS names_length, length(text) AS request_length, CASE WHEN contains(names, 'en') THEN 'en' ELSE '' END AS picked FROM benchmark, c""")
def closed_list_choice(spark, sf_dir):
    """Prompts over a closed list of names, a scripted answer to each, and what is picked from it."""
    names = [r.lang for r in fx.table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang").distinct().orderBy("lang").collect()]  # a closed list
    listed = F.array(*map(F.lit, names)).cast("array<string>")
    asked = fx.table(spark, sf_dir, "benchmark").select("item_id", "text", models.category_prompt(F.col("text"), listed, 2).alias("prompt"))
    answered = models.generate(asked, "prompt", lambda: lambda prompts: [" EN. , nowhere\nfr" if ", en" in f", {p.split('Names: ', 1)[1]}" else "none" for p in prompts])
    tokens = F.transform(F.split(F.split_part(F.trim("gen"), F.lit("\n"), F.lit(1)), ","), lambda t: F.lower(F.regexp_replace(t, """^[ ."']+|[ ."']+$""", "")))
    picked = F.filter(listed, lambda n: F.array_contains(tokens, F.lower(n)))
    shown = F.regexp_extract("prompt", r"(?s)Names: (.*?)\nRequest: ", 1)
    request = F.regexp_extract("prompt", r"(?s)\nRequest: (.*)\nWhich 1 to 2 of the names", 1)
    return answered.select("item_id", F.length(shown).cast("long").alias("names_length"), F.length(request).cast("long").alias("request_length"), F.array_join(picked, ",").alias("picked"))


@query(f"""{FX1}, r AS (SELECT split, query_id, is_gold, row_number() OVER (PARTITION BY query_id ORDER BY s_multi DESC, tool_idx) AS rk FROM s), m AS (SELECT split, query_id, max(rk) FILTER (is_gold) AS mg FROM r GROUP BY ALL),
a AS (SELECT split, k, avg(CASE WHEN mg<=k THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM m, (SELECT unnest([5,10,20,50]) AS k) GROUP BY split, k)
SELECT CAST(row_number() OVER (ORDER BY split, k) AS INTEGER) AS line, rpad(split, 6, ' ') || lpad(CAST(k AS VARCHAR), 4, ' ') || lpad(printf('%.4f', round(recall, 4)), 10, ' ') || lpad(CAST(n AS VARCHAR), 8, ' ') AS text FROM a""")
def report_text(spark, sf_dir):
    """The recall report as aligned lines of text."""
    worst = rk.worst_gold(rk.with_rank(fx.scores(spark, sf_dir), "s_multi", "query_id"), "split", "query_id").withColumn("k", F.explode(F.array(*map(F.lit, (5, 10, 20, 50)))))
    rows = worst.groupBy("split", "k").agg(F.avg((F.col("maxgold") <= F.col("k")).cast("double")).alias("recall"), F.count("*").alias("n"))
    return an.text_lines(rows, ["split", "k"], {"split": -6, "k": 4, "recall": 10, "n": 8})
