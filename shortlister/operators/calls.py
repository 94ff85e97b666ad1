"""Parsing generated calls and scoring them against gold tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls as fc

#: The parameters of every tool in the fixtures.
PARAMETERS = {"q": ("string", True), "limit": ("integer", False)}


def parsed(generated: DataFrame) -> DataFrame:
    """``generated`` (with text ``gen``) plus ``calls`` array of (name, args), ``n_blocks`` and ``gen_status``.

    ok: all blocks parse; malformed: a block does not, though the others count; no_call: no block and no function.
    """
    # One row each, so that what the columns below name is computed once.
    with_blocks = generated.withColumn("_b", F.explode(F.array(fc.blocks(F.col("gen")))))
    calls = F.transform("_b", lambda b: F.coalesce(fc.xml_call(b), fc.json_call(b)))
    out = with_blocks.withColumn("_c", F.explode(F.array(calls))).withColumn("n_blocks", F.size("_b")).withColumn("calls", F.filter("_c", lambda c: c.isNotNull()))
    status = F.when(F.col("n_blocks") == 0, "no_call").when(F.size("calls") < F.col("n_blocks"), "malformed").otherwise("ok")
    return out.withColumn("gen_status", status).drop("_b", "_c")


def statuses(generated: DataFrame) -> DataFrame:
    """``generated`` with the ``gen_status`` of ``parsed``, without the calls."""
    n = generated.withColumn("_b", F.explode(F.array(fc.blocks(F.col("gen"))))).withColumn("_n", F.size("_b")).withColumn("_c", F.size(F.filter("_b", fc.is_call)))
    return n.withColumn("gen_status", F.when(F.col("_n") == 0, "no_call").when(F.col("_c") < F.col("_n"), "malformed").otherwise("ok")).drop("_b", "_n", "_c")


def valid_call(args, parameters: dict = PARAMETERS) -> dict:
    """Columns missing, unknown, bad and valid of a call's arguments."""
    keys = F.map_keys(args)
    required = F.array(*[F.lit(p) for p, (_, r) in parameters.items() if r]).cast("array<string>")
    known = F.array(*map(F.lit, parameters))
    missing, unknown = F.array_except(required, keys), F.array_except(keys, known)
    kind = F.create_map(*[F.lit(x) for p, (t, _) in parameters.items() for x in (p, t)])
    bad = F.filter(F.array_intersect(keys, known), lambda k: ~fc.coercible(F.coalesce(F.element_at(args, k), F.lit("")), F.element_at(kind, k)))
    return {"missing": missing, "unknown": unknown, "bad": bad, "valid": (F.size(missing) == 0) & (F.size(unknown) == 0) & (F.size(bad) == 0)}


def score(records: DataFrame) -> DataFrame:
    """Metrics of each record with calls, candidates (array of (id, name)), gold (array of id), split."""
    cand_names = F.transform("candidates", lambda c: c["name"])
    cand_ids = F.transform("candidates", lambda c: c["id"])
    # Of candidates with the same sanitised name the last one counts.
    at = lambda name: F.size(F.col("candidates")) - F.array_position(F.reverse(cand_names), name)
    known = F.filter("calls", lambda c: F.array_contains(cand_names, c["name"]))
    called = F.transform(known, lambda c: F.struct(F.element_at(cand_ids, (at(c["name"]) + 1).cast("int")).alias("id"), c["args"].alias("args")))
    r = records.withColumn("called", F.explode(F.array(called))).withColumn("ids", F.transform("called", lambda c: c["id"]))
    n, gold = F.size("ids"), F.col("gold")
    right = F.size(F.filter("ids", lambda i: F.array_contains(gold, i)))
    func = F.when(F.col("split") == "I1", (right > 0).cast("double")).when(n == 0, 0.0).otherwise(right / n)
    outside = lambda a, b: F.size(F.array_except(a, b)) > 0
    done = ~outside(gold, F.col("ids"))
    miss = F.when(done, None).when(outside(gold, cand_ids), "retrieval_miss").otherwise("generation_miss")
    r = r.withColumns({
        "func_acc": func, "completeness": done.cast("double"), "miss_type": miss, "recall_all": (~outside(gold, cand_ids)).cast("int"), "n_calls": F.size("calls"), "hallucinated_calls": F.size("calls") - n,
        "exact_match": ((n > 0) & ~outside(F.col("ids"), gold) & done & (F.size("calls") == n)).cast("double"),
    })
    gold_valid = F.transform(F.filter("called", lambda c: F.array_contains(gold, c["id"])), lambda c: valid_call(c["args"])["valid"].cast("double"))
    r = r.withColumn("_v", F.explode(F.array(gold_valid)))
    mean = F.when(F.size("_v") > 0, F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / F.size("_v"))
    r = r.withColumn("args_valid", mean).withColumn("strict_success", F.coalesce(((F.col("exact_match") == 1) & (F.col("args_valid") == 1)).cast("double"), F.lit(0.0)))
    excerpt = F.when(F.col("gen_status") != "ok", F.substring("gen", 1, 1500))
    return r.withColumn("gen_excerpt", excerpt).drop("_v", "called")


def argument_accuracy(rows: DataFrame, required: list[str], repeated: DataFrame, *keys: str) -> DataFrame:
    """Mean share of the required arguments that the first call of each wanted function has right.

    rows: keys, calls and wanted (arrays of (name, args)); rows of the same keys count as one, their calls by their places.
    ``repeated`` has the keys of more than one row: no other rows have to meet. Functions without required arguments with a value are left out; none left gives 0. Keys that want nothing have no row.
    """
    value = lambda args, k: fc.normalise(F.try_element_at(args, F.lit(k)))
    called = F.transform("calls", lambda c, i: F.struct(i.alias("pos"), c["name"].alias("name"), F.array(*(value(c["args"], k) for k in required)).alias("given")))
    wanted = F.transform("wanted", lambda w: F.struct(w["name"].alias("name"), F.array(*(F.struct(F.map_contains_key(w["args"], k).alias("need"), value(w["args"], k).alias("value")) for k in required)).alias("want")))
    # One row each, so that what the columns below name is computed once.
    each = rows.select(*keys, F.explode(F.array(called)).alias("called"), "wanted").select(*keys, "called", F.explode(F.array(wanted)).alias("wanted"))
    if not repeated.isEmpty():
        met = each.join(repeated, list(keys), "left_semi").groupBy(*keys).agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("called", "wanted")))
        each = each.join(repeated, list(keys), "left_anti").unionByName(met)
    each = each.where(F.size("wanted") > 0)

    def share(w: Column) -> Column:
        def of(first: Column) -> Column:
            pairs = F.zip_with(w["want"], F.coalesce(first["given"], F.array().cast("array<string>")), lambda x, g: (x["need"] & (x["value"] == g)))
            need = F.size(F.filter(w["want"], lambda x: x["need"]))
            return F.when(need > 0, F.size(F.filter(pairs, lambda x: x)) / need)

        return fc.let(F.array_min(F.filter("called", lambda c: c["name"] == w["name"])), of)

    got = F.filter(F.transform("wanted", share), lambda x: x.isNotNull())
    mean = fc.let(got, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)).otherwise(0.0))
    return each.select(*keys, mean.alias("arg_acc"))
