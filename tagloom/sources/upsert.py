"""Sinks without a table format: the new state of a table as a DataFrame, and its atomic publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key the row of the largest order; rows of new win ties."""
    both = old.withColumn("tl_new", F.lit(0)).unionByName(new.withColumn("tl_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("tl_new")))
    return both.withColumn("tl_rank", rank).where("tl_rank = 1").drop("tl_rank", "tl_new")


def upsert_if_changed(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """old with col replaced where new has another value that isn't null, and new's further rows.

    Of several rows of new with one key the largest value counts.
    """
    a, b = old.withColumnRenamed(key, "tl_a"), new.groupBy(F.col(key).alias("tl_b")).agg(F.max(col).alias("tl_value"))
    joined = a.join(b, F.col("tl_a") == F.col("tl_b"), "full_outer")
    changed = F.col("tl_value").isNotNull() & ~F.col(col).eqNullSafe(F.col("tl_value"))
    rest = [c for c in old.columns if c not in (key, col)]
    return joined.select(F.coalesce("tl_a", "tl_b").alias(key), F.when(changed, F.col("tl_value")).otherwise(F.col(col)).alias(col), *rest)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of new's keys, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def publish(df: DataFrame, path: str, version: int) -> str:
    """Writes a version beside the older ones; readers follow the returned path, so none sees half a table."""
    target = f"{path}/v{version}"
    df.write.mode("errorifexists").parquet(target)
    return target
