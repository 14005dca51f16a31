"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words in the contracts: space and U+0009 to U+000D.
WORD_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, the context's checkpoint folder; without one, a temporary folder in local mode, and an error elsewhere:
    on a cluster each executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tagloom-checkpoints")
    return path.rstrip("/")


#: Helper tables that are still there, with the session that wrote each.
_helpers: dict[str, SparkSession] = {}


def helper_path(spark: SparkSession, name: str) -> str:
    """A new path for a helper table, which is deleted by discard() or when Python ends."""
    path = f"{shared_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex}"
    _helpers[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = helper_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tl_path = path
    return out


def _delete(path: str) -> None:
    spark = _helpers.pop(path, None)
    if spark is not None:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes helper tables that written() returned and that nothing reads any more."""
    for t in tables:
        _delete(t.tl_path)


def helpers() -> set[str]:
    """The paths of the helper tables that are there."""
    return set(_helpers)


def discard_new(before: set[str], *kept: DataFrame) -> None:
    """Deletes the helper tables made since helpers() gave before, but for kept ones; for callers that run one query at a time."""
    for path in helpers() - before - {t.tl_path for t in kept}:
        _delete(path)


@atexit.register
def _discard_all() -> None:
    for path in list(_helpers):
        with contextlib.suppress(Exception):  # the JVM may be gone before Python ends
            _delete(path)


def plain_scan(df: DataFrame) -> bool:
    """Whether df is a plain scan, whose rows come in the same parts and order each time that they are read."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return all(re.match(r"[\s:+-]*(Project|Filter|Relation|LocalRelation|LogicalRDD)\b", x) for x in plan.splitlines() if x.strip())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """Marks df for broadcast after a count has shown that it has at most most_rows rows; else the planner joins by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Keys that spread() may find heavy: the bound of what it broadcasts.
MOST_HEAVY = 20_000


def spread(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row a key and in tl_n how many of the total rows have it; columns of both.

    A key with more than 2 / MOST_HEAVY of all rows is heavy. By counting there are at most MOST_HEAVY / 2 of these, so their
    facts are broadcast and their rows stay where they are; the rows of all other keys are dealt out by key.
    """
    least = max(2 * total // MOST_HEAVY, 64)
    heavy = facts.where(F.col("tl_n") > least).drop("tl_n")
    marked = rows.join(F.broadcast(heavy.withColumn("tl_heavy", F.lit(True))), key, "left")
    there = marked.where("tl_heavy").drop("tl_heavy")
    rest = marked.where("tl_heavy IS NULL").select(*rows.columns)
    return there.unionByName(rest.join(facts.where(F.col("tl_n") <= least).drop("tl_n"), key, how).select(*there.columns))


def ship(module_name: str) -> None:
    """Sends the functions of a module to Python workers by value, so that executors need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as the one column tl_row, so that no name of theirs clashes with what is put beside them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tl_row"))


def row(name: str) -> Column:
    return F.col(f"tl_row.`{name}`")


def unpacked(rows: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    return rows.select(*[replaced.get(c, row(c)).alias(c) for c in columns])


#: Rows of an Arrow batch: texts may be long, and JVM and worker each hold a batch.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows where they are larger; a plan reads this when it runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def relieve() -> None:
    """Gives a worker's free memory back to the system: workers live on idle after their task."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(rows):
    """rows, a function from batches to batches, with relief at its end."""

    def task(batches):
        try:
            yield from rows(batches)
        finally:
            relieve()

    return task


ship(__name__)
