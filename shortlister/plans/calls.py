"""Parsing and scoring of generated calls, and the tables and conclusions drawn from the scored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import calls as fc
from ..operators import calls as oc
from ..tables import stash
from .fixture_sql import CALLS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parsed(spark, sf_dir):
    return oc.parsed(fx.generated(spark, sf_dir))


def _calls(spark, sf_dir):
    return _parsed(spark, sf_dir).select("event_id", "split", "query_id", "candidates", "gold", F.posexplode("calls").alias("pos", "call")).select("*", F.col("call.name").alias("name"), F.col("call.args").alias("args"))


def _scored(spark, sf_dir):
    return oc.score(_parsed(spark, sf_dir))


@query(f"{CALLS} SELECT event_id, CAST(pos-1 AS INTEGER) AS pos, block FROM bl")
def parse_blocks(spark, sf_dir):
    """C1."""
    return fx.generated(spark, sf_dir).select("event_id", F.posexplode(fc.blocks(F.col("gen"))).alias("pos", "block"))


@query(f"{CALLS} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pos)-1 AS INTEGER) AS pos, name, array_to_string(list_transform(list_sort(map_keys(args)), lambda k: k || '=' || args[k]), ';') AS args FROM ca")
def parse_calls(spark, sf_dir):
    """C2, C3."""
    return _calls(spark, sf_dir).select("event_id", "pos", "name", fc.args_text(F.col("args")).alias("args"))


@query(f"{CALLS} SELECT event_id, gen_status, CAST(n_calls AS INTEGER) AS n_calls, CASE WHEN gen_status<>'ok' THEN substr(gen, 1, 1500) END AS gen_excerpt FROM st JOIN b0 USING (event_id)")
def gen_status(spark, sf_dir):
    """C4, B27."""
    return _parsed(spark, sf_dir).select("event_id", "gen_status", F.size("calls").alias("n_calls"), F.when(F.col("gen_status") != "ok", F.substring("gen", 1, 1500)).alias("gen_excerpt"))


@query(f"{CALLS} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pos)-1 AS INTEGER) AS pos, name, tool_id, tool_id IS NULL AS hallucinated FROM ct")
def call_to_tool(spark, sf_dir):
    """The name among the sanitised candidates, or made up."""
    c = _calls(spark, sf_dir)
    c = c.withColumn("hits", F.filter("candidates", lambda x: x["name"] == F.col("name")))
    return c.select("event_id", "pos", "name", F.try_element_at(F.transform("hits", lambda x: x["id"]), F.lit(-1)).alias("tool_id"), (F.size("hits") == 0).alias("hallucinated"))


_RATES = """SELECT CASE WHEN event_id%2=0 THEN 'weak' ELSE 'strong' END AS model, count(*) AS n, round(count(*) FILTER (gen_status='ok')/count(*), 4) AS parse_rate,
 round(CASE WHEN count(*) FILTER (gen_status<>'no_call')>0 THEN count(*) FILTER (gen_status='ok')/count(*) FILTER (gen_status<>'no_call') ELSE 0 END, 4) AS structural, round(count(*) FILTER (gen_status='no_call')/count(*), 4) AS no_call_rate FROM st GROUP BY ALL"""


def _rates(spark, sf_dir):
    s = F.col("gen_status")
    model = F.when(F.col("event_id") % 2 == 0, "weak").otherwise("strong")
    ok, marked = F.count_if(s == "ok"), F.count_if(s != "no_call")
    return oc.statuses(fx.generated(spark, sf_dir)).groupBy(model.alias("model")).agg(F.count("*").alias("n"), F.round(ok / F.count("*"), 4).alias("parse_rate"), F.round(F.when(marked > 0, ok / marked).otherwise(0.0), 4).alias("structural"), F.round(F.count_if(s == "no_call") / F.count("*"), 4).alias("no_call_rate"))


@query(f"{CALLS} {_RATES}")
def parse_rates(spark, sf_dir):
    """E19."""
    return _rates(spark, sf_dir)


@query(f"{CALLS}, ra AS ({_RATES}) SELECT model, structural, CASE WHEN structural>=0.9 THEN 'keep' WHEN model='weak' THEN 'exclude' ELSE 'stop' END AS action, model='weak' AND structural<0.9 AS hypothesis_unverifiable FROM ra")
def exclusion_rule(spark, sf_dir):
    """I26."""
    r = _rates(spark, sf_dir)
    low = F.col("structural") < 0.9
    return r.select("model", "structural", F.when(~low, "keep").when(F.col("model") == "weak", "exclude").otherwise("stop").alias("action"), ((F.col("model") == "weak") & low).alias("hypothesis_unverifiable"))


@query(f"{CALLS} SELECT event_id, round(func_acc, 4) AS func_acc FROM rec")
def score_func(spark, sf_dir):
    """E34."""
    return _scored(spark, sf_dir).select("event_id", F.round("func_acc", 4).alias("func_acc"))


@query(f"{CALLS} SELECT event_id, exact_match, n_calls, hallucinated_calls FROM rec")
def score_exact(spark, sf_dir):
    """E35."""
    return _scored(spark, sf_dir).select("event_id", "exact_match", "n_calls", "hallucinated_calls")


@query(f"{CALLS} SELECT event_id, completeness, recall_all FROM rec")
def completeness(spark, sf_dir):
    """E36, E3."""
    return _scored(spark, sf_dir).select("event_id", "completeness", "recall_all")


@query(f"{CALLS} SELECT split, coalesce(miss_type, 'none') AS miss_type, count(*) AS n FROM rec GROUP BY ALL")
def miss_types(spark, sf_dir):
    """E36."""
    return _scored(spark, sf_dir).groupBy("split", F.coalesce("miss_type", F.lit("none")).alias("miss_type")).agg(F.count("*").alias("n"))


@query(f"{CALLS} SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY pos)-1 AS INTEGER) AS pos, array_to_string(missing, ',') AS missing_required, array_to_string(unknown, ',') AS unknown_params, array_to_string(bad, ',') AS bad_types, valid FROM ct")
def call_validity(spark, sf_dir):
    """E37, B21."""
    v = oc.valid_call(F.col("args"))
    return _calls(spark, sf_dir).select("event_id", "pos", F.array_join(v["missing"], ",").alias("missing_required"), F.array_join(F.array_sort(v["unknown"]), ",").alias("unknown_params"), F.array_join(v["bad"], ",").alias("bad_types"), v["valid"].alias("valid"))


@query(f"{CALLS} SELECT event_id, round(args_valid, 4) AS args_valid, strict_success FROM rec")
def strict_success(spark, sf_dir):
    """E38."""
    return _scored(spark, sf_dir).select("event_id", F.round("args_valid", 4).alias("args_valid"), "strict_success")


@query(f"""{CALLS}, f AS (SELECT event_id, name, arg_min(args, pos) AS given FROM ca GROUP BY ALL), w AS (SELECT event_id, user_id, regexp_replace(unnest(gold), '[^A-Za-z0-9_-]', '_', 'g') AS name FROM g),
x AS (SELECT w.event_id, CASE WHEN given IS NULL THEN 0.0 WHEN lower(trim(given['q']))=CAST(user_id AS VARCHAR) THEN 1.0 ELSE 0.0 END AS s FROM w LEFT JOIN f USING (event_id, name))
SELECT event_id, round(avg(s), 4) AS arg_acc FROM x GROUP BY event_id""")
def arg_accuracy(spark, sf_dir):
    """Wanted are a call of each gold tool with q = the user."""
    args = F.create_map(F.lit("q"), F.col("user_id").cast("string"))
    wanted = F.transform("gold", lambda x: F.struct(fc.sanitize(x).alias("name"), F.col("_args").alias("args")))
    rows = _parsed(spark, sf_dir).withColumn("_args", args).select("event_id", "calls", wanted.alias("wanted"))
    repeated = stash(fx.table(spark, sf_dir, "events").groupBy("event_id").count().where("count > 1").select("event_id"))
    return oc.argument_accuracy(rows, ["q"], repeated, "event_id").select("event_id", F.round("arg_acc", 4).alias("arg_acc"))
