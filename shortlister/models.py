"""Pluggable batch models: anything that embeds or generates texts, run in Arrow batches, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def hashed_embeddings(df: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """key, vec: a stand-in for a model, by built-in functions: words counted by hash, normalised."""
    words = df.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).where("w <> ''")
    place = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")
    counts = words.groupBy(key, place.alias("i")).agg(F.count("*").cast("double").alias("n"))
    sums = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return sums.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).alias("vec"))


def embed_distinct(df: DataFrame, text: str, model: Callable[[], Embedder], prefix: str = PASSAGE_PREFIX, batch: int = 64) -> DataFrame:
    """``df`` with ``vec``; each distinct text is embedded once. ``model`` makes the embedder, once in each worker's task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = model()
        for pdf in batches:
            texts = pdf["t"].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embed([prefix + t for t in texts[i : i + batch]])]
            yield pd.DataFrame({"t": texts, "vec": vectors})

    unique = df.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct()
    vectors = unique.mapInPandas(run, "t string, vec array<float>").withColumnRenamed("t", "_text")
    return df.join(vectors, F.col(text) == F.col("_text"), "left").drop("_text")


def cached_vectors(df: DataFrame, text: str, model: Callable[[], Embedder], cache: str, prefix: str = PASSAGE_PREFIX) -> DataFrame:
    """``df`` with ``vec`` from a table of vectors by text; only texts that it lacks are embedded, and added to it.

    The cache is a Parquet table at a path that driver and executors share: key (sha-256 of prefix and text), vec.
    """
    spark = df.sparkSession
    key = F.sha2(F.concat(F.lit(prefix), F.col(text)), 256)
    # No table at the path yet: none is known. Any other failure to read it is an error.
    fs = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.parquet(cache) if fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs) else spark.createDataFrame([], "key string, vec array<float>")
    missing = df.select(text, key.alias("key")).where("key IS NOT NULL").dropDuplicates(["key"]).join(known, "key", "left_anti")
    embed_distinct(missing, text, model, prefix).select("key", "vec").write.mode("append").parquet(cache)
    return df.withColumn("_key", key).join(spark.read.parquet(cache).withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def save_models(models: dict, folder: str) -> None:
    """Fitted Spark models by name, each in a folder of its own."""
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load_models(folder: str, names: list[str], kind) -> dict:
    """Models of a class, by name."""
    return {name: kind.load(f"{folder}/{name}") for name in names}


def batches_of(sizes: list[int], max_items: int, max_tokens: int) -> Iterator[slice]:
    """Runs of prompts with limits on their number and tokens; a longer one is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= max_items or total + n > max_tokens):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def generate(df: DataFrame, prompt: str, model: Callable[[], Generator], max_items: int = 8, max_tokens: int = 40_000, tokens: Callable[[str], int] = len) -> DataFrame:
    """``df`` with ``gen``, by batches of prompts within both limits; ``tokens`` measures a prompt."""
    schema = StructType([*df.schema.fields, StructField("gen", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = model()
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            out = [g for part in batches_of([tokens(p) for p in prompts], max_items, max_tokens) for g in make(prompts[part])]
            yield pdf.assign(gen=out)

    return df.mapInPandas(run, schema)


def prompt(query: Column, tool_schemas: Column, system: str | None = None) -> Column:
    """A plain chat prompt: an optional system turn, the tools as JSON lines, the user's turn."""
    head = f"<|system|>\n{system}<|end|>\n" if system else ""
    return F.concat(F.lit(head + "<|tools|>\n"), F.array_join(tool_schemas, "\n"), F.lit("<|end|>\n<|user|>\n"), query, F.lit("<|end|>\n<|assistant|>\n"))


def category_prompt(query: Column, categories: Column, most: int) -> Column:
    """A prompt that asks for up to ``most`` names of a closed list, on one line with commas between them."""
    system = "Pick names from the list below and nothing else. Answer with the names alone, as they are written, on one line, commas between them."
    head = F.lit(f"<|system|>\n{system}<|end|>\n<|user|>\nNames: ")
    return F.concat(head, F.array_join(categories, ", "), F.lit("\nRequest: "), query, F.lit(f"\nWhich 1 to {most} of the names does the request need?<|end|>\n<|assistant|>\n"))
