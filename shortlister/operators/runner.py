"""Running generators over the grid of splits, models, conditions and K: candidates, prompts, texts, scored records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import Generator, generate, prompt
from .analysis import KEY, expected
from .calls import parsed, score

_RECORD = ("func_acc", "completeness", "miss_type", "recall_all", "n_calls", "hallucinated_calls", "exact_match", "args_valid", "strict_success", "gen_status", "gen_excerpt")


def candidate_schemas(candidates: DataFrame, tools: DataFrame, *keys: str) -> DataFrame:
    """keys, candidates (array of (id, name)), schemas: those of the candidates that the catalogue knows, in order.

    candidates: keys, pos, id; tools: id, name, schema (JSON text). An id that the catalogue lacks is left out.
    """
    known = candidates.join(tools.select("id", "name", "schema"), "id")
    listed = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "schema"))).alias("c"))
    rows = candidates.select(*keys).distinct().join(listed, list(keys), "left").withColumn("c", F.coalesce("c", F.array().cast(listed.schema["c"].dataType)))
    return rows.select(*keys, F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"))).alias("candidates"), F.transform("c", lambda x: x["schema"]).alias("schemas"))


def _present(spark: SparkSession, target: str) -> DataFrame:
    """The combinations that ``target`` holds, from the names of its partitions."""
    none = spark.createDataFrame([], "split string, model string, condition string, k int")
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(where) or not spark.read.parquet(target).columns:
        return none
    return spark.read.parquet(target).select(*KEY).distinct().select("split", "model", "condition", F.col("k").cast("int").alias("k"))


def run_conditions(queries: DataFrame, candidates: DataFrame, tools: DataFrame, models: dict[str, Callable[[], Generator]], target: str, ks: tuple[int, ...], system: str | None = None, force: bool = False) -> DataFrame:
    """Write the records that ``target`` lacks and return the combinations without output, with a reason each.

    queries: split, query_id, query, gold (array of ids); candidates: split, condition, k, query_id, pos, id (``full`` has
    k 0); tools: id, name, schema. ``target`` is a Parquet table by split, model, condition and k. A combination is run
    if it is expected, has candidates and, unless ``force``, no records there; ``force`` runs and replaces all.
    """
    spark = queries.sparkSession
    splits = sorted(r.split for r in queries.select("split").distinct().collect())  # a few names
    grid = expected(spark, splits, sorted(models), ks).drop("pos")
    has = candidates.select("split", "condition", "k").distinct()
    missing = grid.join(has, ["split", "condition", "k"], "left_anti").withColumn("reason", F.lit("no candidates"))
    todo = grid.join(has, ["split", "condition", "k"])
    if not force:
        todo = todo.join(_present(spark, target), list(KEY), "left_anti")
    todo = [tuple(r) for r in todo.select(*KEY).collect()]  # rows of the grid
    if todo:
        wanted = F.broadcast(spark.createDataFrame(todo, "split string, model string, condition string, k int"))  # rows of the grid
        lists = candidate_schemas(candidates, tools, "split", "condition", "k", "query_id")
        rows = queries.join(lists, ["split", "query_id"]).withColumn("prompt", prompt(F.col("query"), F.col("schemas"), system)).drop("schemas")
        each = rows.join(wanted, ["split", "condition", "k"]).withColumn("prompt_tokens", F.length("prompt"))
        done = None
        for name, model in sorted(models.items()):  # a generator for each model
            out = generate(each.where(F.col("model") == name), "prompt", model)
            done = out if done is None else done.unionByName(out)
        records = score(parsed(done)).withColumn("n_candidates", F.size("candidates")).select(*KEY, "query_id", "n_candidates", "prompt_tokens", *_RECORD)
        mode = "overwrite" if force else "append"
        records.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(target)
    return missing.select(*KEY, "reason")
