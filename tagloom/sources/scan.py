"""Reads in steps: pages by key, rows in a given order, and batches fetched ahead of their use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .metadata import array_relation

#: Rows of a page.
PAGE = 5_000


def after(df: DataFrame, key: str, cursor=None, limit: int = PAGE) -> DataFrame:
    """The first rows by a unique key beyond the cursor; each task keeps its own first ones, so a page is no full sort."""
    rows = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rows.where(F.col(key).isNotNull()).orderBy(key).limit(limit)


def pages(df: DataFrame, key: str, limit: int = PAGE) -> Iterator[list[Row]]:
    """All rows by a unique key, a page at a time, for a consumer outside of Spark; rows without a key are in none."""
    cursor = None
    while page := after(df, key, cursor, limit).collect():  # one page
        yield page
        if len(page) < limit:
            return
        cursor = page[-1][key]


def in_order(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of df for each of the values, in their order in the column ord; repeated values repeat, unknown ones are left out.

    A driver's list is small beside df, so it is broadcast.
    """
    if not values:
        return df.withColumn("ord", F.lit(0).cast("long")).limit(0)
    asked = array_relation(df.sparkSession, [key], values).select("ord", F.col(key).cast(df.schema[key].dataType).alias(key))
    return df.join(F.broadcast(asked), key).select(*df.columns, "ord").orderBy("ord")


def ahead(fetch: Callable, batches: Iterable) -> Iterator:
    """fetch(batch) of each batch in order, the next one being fetched while the last is worked on; its error comes at its turn."""
    rest = iter(batches)
    with ThreadPoolExecutor(1) as pool:
        due = [pool.submit(fetch, b) for b in _first(rest)]
        while due:
            result = due.pop().result()
            due = [pool.submit(fetch, b) for b in _first(rest)]
            yield result


def _first(rest: Iterator) -> list:
    for x in rest:
        return [x]
    return []
