"""Tables in the folder that driver and executors share, written once and read many times."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_fallback_dir: str | None = None
#: Folders written to by this process, and the application they belong to.
_written: dict[str, str] = {}
#: Tables of ``once`` by application, name and state of the inputs.
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder on a ``local`` master, whose executors are this machine; an error
    on any other one.
    """
    global _fallback_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if _fallback_dir is None:
        _fallback_dir = "file://" + tempfile.mkdtemp(prefix="shortlister-")
    return _fallback_dir


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name in the shared folder; ``sweep`` and the end of the process remove what is written there."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    _written[path] = spark.sparkContext.applicationId
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def written() -> set[str]:
    """The folders written so far and not removed."""
    return set(_written)


def sweep(spark: SparkSession, since: set[str], keep: str | None = None) -> None:
    """Remove the folders written after ``written()`` gave ``since``, but one; nothing may read them any more."""
    for path in [p for p in _written if p not in since and p != keep]:
        _remove(spark, path)
        del _written[path]
    for key in [k for k, p in _kept.items() if p not in _written]:
        del _kept[key]


@atexit.register
def _sweep_all() -> None:
    spark = SparkSession.getActiveSession() if _written else None
    if spark is None:
        return
    try:
        own = spark.sparkContext.applicationId
        for path in [p for p, app in _written.items() if app == own]:
            _remove(spark, path)
    except Exception:  # the application has ended: its folders are the cluster's to clean
        pass


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = path or scratch(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number, bytes and latest change of the files under a path."""
    fs, where = _file_system(spark, path)
    files, n, size, latest = fs.listFiles(where, True), 0, 0, 0
    while files.hasNext():
        f = files.next()
        n, size, latest = n + 1, size + f.getLen(), max(latest, f.getModificationTime())
    return n, size, latest


def once(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written the first time; again only when the files of the inputs have changed."""
    key = (spark.sparkContext.applicationId, name, *((p, state_of(spark, p)) for p in inputs))
    if key not in _kept:
        path = scratch(spark, "once")
        stash(build(), path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def ranged(rows: DataFrame, by: list) -> DataFrame:
    """``rows``, written in order of the columns ``by``: _part, the range that a row lies in, and _at, which rises through it.

    Rows that agree in them are dealt by a hash, so that no range has to hold many equal ones.
    """
    tied = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    # As many ranges as shuffles have partitions; adaptive execution joins small ones that lie side by side.
    dealt = tied.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    return stash(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_at", 33))


def _starts(kept: DataFrame, group: list[str], sums: dict) -> DataFrame:
    """What the ranges before hold of each group, for each range and group."""
    per = kept.groupBy(*group, "_part").agg(F.min("_at").alias("_least"), *(F.sum(e).alias(n) for n, e in sums.items()))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and group
    return per.select(*(F.col(c).alias(f"_s_{c}") for c in group), F.col("_part").alias("_s_part"), "_least", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))


def _with_starts(kept: DataFrame, group: list[str], starts: DataFrame) -> DataFrame:
    same = F.col("_part") == F.col("_s_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return kept.join(starts, same)


def placed(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """``rows`` with ``place``: the number from 0 in its group, in order; no task meets a whole group.

    How many rows of a group the ranges before hold comes from a count for each range and group. Rows that agree in group
    and order get their numbers in any order. ``order``: columns.
    """
    kept = ranged(rows, [*(F.col(c) for c in group), *order])
    joined = _with_starts(kept, group, _starts(kept, group, {"n": F.lit(1)}))
    return joined.select(*rows.columns, (F.col("_s_n") + F.col("_at") - F.col("_least")).alias("place"))


def running(rows: DataFrame, group: list[str], order: list, **sums) -> DataFrame:
    """``rows`` with sums over the rows of their group up to them, in order; no task meets a whole group."""
    kept = ranged(rows, [*(F.col(c) for c in group), *order])
    joined = _with_starts(kept, group, _starts(kept, group, sums))
    own = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*rows.columns, *((F.col(f"_s_{n}") + F.sum(e).over(own)).alias(n) for n, e in sums.items()))
