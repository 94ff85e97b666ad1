"""Reading raw instances, records and results, and writing them; paths are whatever Spark can open."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from io import BytesIO
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import stash

#: Fixed patterns of result file names.
RETRIEVAL_NAME = r"retrieval_(I\d)_(.+)_(\d+)\.jsonl"
DOWNSTREAM_NAME = r"downstream_(I\d)_(weak|strong)_(.+)_K(\d+)\.jsonl"
API = "struct<category_name:string,tool_name:string,api_name:string,api_description:string,description:string,tool_description:string,required_parameters:array<struct<name:string,type:string,description:string>>,optional_parameters:array<struct<name:string,type:string,description:string>>>"
RAW = f"query_id string, query string, api_list array<{API}>, `relevant APIs` array<array<string>>"


def read_json_array(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """A file that holds one JSON array of instances."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_mirror(spark: SparkSession, folder: str, subset: str) -> DataFrame:
    """A subset of a local mirror of a published data set: Parquet files ``<subset>-*.parquet`` under ``folder``.

    Lists that the mirror keeps as text are read leniently; rows that repeat a query id count once, the first by file and
    place. Returns query_id, query, api_list and relevant apis as in RAW.
    """
    rows = spark.read.option("pathGlobFilter", f"{subset}-*.parquet").option("recursiveFileLookup", True).parquet(folder)
    kinds = dict(rows.dtypes)
    relevant = next(c for c in ("relevant_apis", "relevant APIs") if c in kinds)

    def listed(name: str, schema: str) -> Column:
        value = F.col(f"`{name}`")
        return F.from_json(lenient_json(value), schema) if kinds[name] == "string" else F.from_json(F.to_json(value), schema)

    first = rows.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id())).groupBy(F.col("query_id").cast("string").alias("query_id")).agg(F.min_by(F.struct("query", "api_list", f"`{relevant}`"), "_at").alias("r")).select("query_id", "r.*")
    return first.select("query_id", "query", listed("api_list", f"array<{API}>").alias("api_list"), listed(relevant, "array<array<string>>").alias("relevant APIs"))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """i, vec: the rows of matrices in .npy files (a file, or a folder of them, numbered on in order of their names)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                matrix = np.load(BytesIO(content), allow_pickle=False)
                for at in range(0, len(matrix), 1024):
                    part = matrix[at : at + 1024].astype(np.float64)
                    yield pd.DataFrame({"path": name, "at": np.arange(at, at + len(part)), "vec": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    found = stash(files.select("path", "content").mapInPandas(rows, "path string, at long, vec array<double>"))
    sizes = found.groupBy("path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return found.join(sizes.select("path", before.alias("before")), "path").select((F.col("before") + F.col("at")).alias("i"), "vec")


def write_npy(vectors: DataFrame, path: str, order: str, column: str = "vec") -> None:
    """Float32 matrices in order, a file for each range of rows; ``read_npy`` numbers them on."""
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [np.stack(pdf[column].to_numpy()).astype(np.float32) for pdf in batches if len(pdf)]
        if parts:
            target = path if "://" in path or path.startswith("file:") else f"file://{Path(path).resolve()}"
            fs, folder = pafs.FileSystem.from_uri(target)
            fs.create_dir(folder, recursive=True)
            task = TaskContext.get()
            name, draft = f"{folder}/part-{task.partitionId():06d}.npy", f"{folder}/_{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as out:
                buffer = BytesIO()
                np.save(buffer, np.concatenate(parts))
                out.write(buffer.getvalue())
            fs.move(draft, name)
            yield pd.DataFrame({"file": [name], "rows": [sum(map(len, parts))]})

    vectors.select(order, column).repartitionByRange(width, order).sortWithinPartitions(order).mapInPandas(save, "file string, rows long").collect()  # a row for each file


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object on each line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first path that exists, or an error that names all."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in candidates:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError("none of these exists: " + ", ".join(candidates))


def read_optional(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame | None, str]:
    """A JSONL source, or None and the reason."""
    try:
        first_existing(spark, [path])
    except FileNotFoundError as e:
        return None, str(e)
    return read_jsonl(spark, path, schema), ""


def lenient_json(text: Column) -> Column:
    """A JSON array as it is, another literal list as JSON, anything else null.

    A literal list of single-quoted strings, numbers, True, False and None becomes JSON by built-in functions where that
    is safe: no double quotes or backslashes, and none of these words within a string. Only what is left goes to Python.
    """

    @F.pandas_udf("string")
    def literal(texts: pd.Series) -> pd.Series:
        def read(t):
            try:
                v = ast.literal_eval(t)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return None
            return json.dumps(v, ensure_ascii=False) if isinstance(v, list) else None

        return texts.map(read, na_action="ignore")

    def is_array(t: Column) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("ARRAY"), F.lit(False))

    translated = F.replace(text, F.lit("'"), F.lit('"'))
    for word, value in (("None", "null"), ("True", "true"), ("False", "false")):
        translated = F.regexp_replace(translated, rf"\b{word}\b", value)
    safe = text.startswith("[") & ~text.rlike(r'["\\]') & ~text.rlike(r"'[^']*\b(None|True|False)\b[^']*'")
    simple = F.when(safe & is_array(translated), translated)
    left = ~is_array(text) & simple.isNull() & F.trim(text).startswith("[")
    return F.when(is_array(text), text).otherwise(F.coalesce(simple, literal(F.when(left, text))))


def name_parts(path: Column, pattern: str, *names: str) -> list[Column]:
    """Fields of a file name; empty where it does not match."""
    return [F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def read_results(spark: SparkSession, folder: str, schema: str, pattern: str, *names: str) -> DataFrame:
    """All JSONL files of a folder whose names match, with the fields of the names as columns."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(folder).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where(F.col("_file").rlike(f"^{pattern}$")).select(*schema_names(schema), *name_parts(F.col("_file"), pattern, *names))


def schema_names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()


def write_jsonl(df: DataFrame, path: str, force: bool = False) -> None:
    """Lines of JSON; what is already there stays unless forced."""
    df.write.mode("overwrite" if force else "ignore").json(path)


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode("overwrite" if force else "ignore").csv(path, header=True)


def write_table(df: DataFrame, path: str, *partition_by: str, force: bool = False) -> None:
    """Parquet, partitioned by what result file names would tell."""
    df.write.mode("overwrite" if force else "ignore").partitionBy(*partition_by).parquet(path)


def load_config(path: str) -> dict:
    """A YAML file; ``${name}`` in ``paths`` refers to other paths, to any depth; an unknown name is an error."""
    import yaml

    cfg = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    paths = {k: str(v) for k, v in (cfg.get("paths") or {}).items()}
    for _ in range(len(paths) + 1):
        paths = {k: re.sub(r"\$\{(\w+)\}", lambda m: paths.get(m[1], m[0]), v) for k, v in paths.items()}
    if bad := sorted(k for k, v in paths.items() if "${" in v):
        raise ValueError(f"unresolved paths: {', '.join(bad)}")
    base = Path(path).resolve().parent
    cfg["paths"] = {k: v if "://" in v else str((base / Path(v).expanduser()).resolve()) for k, v in paths.items()}
    return cfg
