"""Shared folder, word splitting and small expressions that several operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
GAP = r"[\x20\x09-\x0D]+"

_own: list[str] = []
#: Paths written inside each of the ``scratch`` blocks that are open in this thread, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, which ``spark.checkpoint.dir`` names.

    Where none is named, a session on this machine alone gets a temporary one; a cluster's executors
    could not see that, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Lineage ends here: a lost executor re-reads the files instead of repeating the work before.
    """
    return _write(df, label, compression, (_written.get() or (None,))[-1])


def _write(df: DataFrame, label: str, compression: str, listed: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if listed is not None:
        listed.append(path)
    with shuffles_removed(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_removing: dict = {"lock": Lock(), "open": 0, "before": None}


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write go when it ends; else they stay until the driver's heap happens to be collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _removing["lock"]:  # writes of several threads share the session's setting
        if not _removing["open"]:
            _removing["before"] = spark.conf.get(name, "false")
            spark.conf.set(name, "true")
        _removing["open"] += 1
    try:
        yield
    finally:
        with _removing["lock"]:
            _removing["open"] -= 1
            if not _removing["open"]:
                spark.conf.set(name, _removing["before"])


def remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes inside are deleted at the end; what is needed later is written as a result."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        remove(spark, paths)


def result(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """``materialize`` for a table that outlives the ``scratch`` block that it is made in.

    It belongs to the block around that one, if there is any, or to ``paths``, for the caller to remove.
    """
    around = _written.get()[:-1]
    return _write(df, label, "zstd", paths if paths is not None else around[-1] if around else None)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose tables go when it returns, but for its result, which is written as one."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        with scratch(docs.sparkSession):
            return result(operator(docs, *args, **kwargs), operator.__name__)

    return run


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Words of a text: maximal runs of characters other than the six ASCII blanks."""
    return F.filter(F.split(text_or_empty(text), GAP), lambda w: w != "")


def text_key(text: Column | str) -> list[Column]:
    """128 bits that stand for a text in joins: columns t0 and t1."""
    text = text_or_empty(text)
    return [F.xxhash64(text).alias("t0"), F.xxhash64(text, F.lit("t1")).alias("t1")]


def one_of_each(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose (doc_id, t0, t1) is in ``gone``, and one of the rows that repeat both doc_id and text."""
    names = docs.columns
    # positional names keep the columns that are carried along apart from ours
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text_col), *[F.col(c).alias(f"c{k}") for k, c in enumerate(names)])
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t0"] == b["t0"]) & (a["t1"] == b["t1"])
    left = rows.join(gone, same(rows, gone), "left_anti")
    copies = left.groupBy("doc_id", "t0", "t1").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = materialize(copies, "repeated-rows")
    if not copies.isEmpty():
        # partial results leave one row of each a task, so copies do not gather; the least row, so that each evaluation has the same
        whole = F.struct(*[f"c{k}" for k in range(len(names))])
        repeated = left.join(copies, same(left, copies), "left_semi").groupBy("doc_id", "t0", "t1").agg(F.min_by(whole, F.to_json(whole)).alias("w")).select("w.*")
        left = left.join(copies, same(left, copies), "left_anti").select(*[f"c{k}" for k in range(len(names))]).unionByName(repeated)
    return left.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def best_of_each(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank`` from 1.

    Tasks' rows are cut among 64 groups of tasks first, so that a key's last step does not grow with the number of tasks.
    """
    some = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    for by in ([*keys, "_part"], keys):
        some = some.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return some.drop("_part")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
