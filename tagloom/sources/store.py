"""Derived relations that are stored once and read from then on, as a library stores its counts, weights and hashes."""

from __future__ import annotations

import atexit
import contextlib
import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str | None:
    """The folder of stored relations: spark.checkpoint.dir, a temporary folder in local mode where that is unset, else none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/tagloom-store"
    if spark.sparkContext.master.startswith("local"):
        return "file://" + os.path.join(tempfile.gettempdir(), "tagloom-store")
    return None


def _listing(spark: SparkSession, path: str) -> list[str]:
    """Name, size and time of each file of a table; the driver reads nothing else of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return sorted(out)


def stored(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """build() as a table that is written where it isn't there yet for the present files of its inputs (paths).

    A table counts once its writer has committed it, so a job that broke off is repeated. Without a shared folder nothing is
    stored.
    """
    base = base_dir(spark)
    if base is None:
        return build()
    state = "\n".join(x for path in inputs for x in _listing(spark, path))
    path = f"{base}/{name}-{hashlib.sha256(state.encode()).hexdigest()[:24]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Scratch folders that are still there, with the session that asked for each.
_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str | None:
    """A new folder beside the stored relations, deleted by discard() or when Python ends; none without a shared folder."""
    base = base_dir(spark)
    if base is None:
        return None
    path = f"{base}/scratch/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def held(df: DataFrame, name: str) -> DataFrame:
    """df worked out once: written to a scratch folder and read from there; as it is without a shared folder."""
    path = scratch(df.sparkSession, name)
    if path is None:
        return df
    df.write.parquet(path)
    sweep(df.sparkSession)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(path: str) -> None:
    spark = _scratch.pop(path, None)
    if spark is not None:
        delete(spark, path)


@atexit.register
def _discard_all() -> None:
    for path in list(_scratch):
        with contextlib.suppress(Exception):  # the JVM may be gone before Python ends
            discard(path)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files of a table, by name."""
    names = (x.rsplit(" ", 2)[0] for x in _listing(spark, path))
    return [x for x in names if not x.rsplit("/", 1)[-1].startswith(("_", "."))]


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now; else they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
