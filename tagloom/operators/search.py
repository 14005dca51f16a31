"""Boolean tag search over items: names, wildcards, computed tags, notes; paging, neighbours and seeded rotation."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import WILDCARD_CAP, Query, meta_tag, wildcard_like, without_meta

PAGE_SIZE, MOST_PAGE_SIZE, MOST_PAGE = 48, 100, 10_000
CARD = ("id", "hash", "width", "height", "blurhash", "mime_type")


def tag_counts(tag: DataFrame, item_tag: DataFrame) -> DataFrame:
    """tag with post_count, the items that carry each; counts that tag has already are taken as they are."""
    if "post_count" in tag.columns:
        return tag
    counts = item_tag.groupBy("tag_id").agg(F.count("*").alias("post_count"))
    return tag.join(counts, F.col("id") == F.col("tag_id"), "left").drop("tag_id").fillna({"post_count": 0})


def ids_named(tag: DataFrame, names: list[str]) -> DataFrame:
    """tag_id of every category of the names, whatever their case."""
    return tag.where(F.lower("name").isin(*[n.lower() for n in names])).select(F.col("id").alias("tag_id"))


def resolve_wildcard(counted: DataFrame, pattern: str, cap: int = WILDCARD_CAP) -> DataFrame:
    """The cap tags of most items that a pattern matches, ties by id."""
    return counted.where(F.col("name").ilike(wildcard_like(pattern))).orderBy(F.desc("post_count"), "id").limit(cap)


def wildcard_truncated(counted: DataFrame, pattern: str, cap: int = WILDCARD_CAP) -> DataFrame:
    """One row (truncated): whether a pattern matches more tags than resolve_wildcard gives."""
    found = counted.where(F.col("name").ilike(wildcard_like(pattern))).limit(cap + 1)
    return found.agg((F.count("*") > cap).alias("truncated"))


def items_with(item_tag: DataFrame, tag_ids: DataFrame) -> DataFrame:
    return item_tag.join(tag_ids, "tag_id", "left_semi").select(F.col("item_id").alias("id"))


def with_favourites(item: DataFrame, favourite: DataFrame | None) -> DataFrame:
    """item with is_favourite, order of rows aside."""
    if favourite is None:
        return item.withColumn("is_favourite", F.lit(False))
    marks = favourite.select(F.col("item_id").alias("f_id"), F.lit(True).alias("is_favourite")).dropDuplicates(["f_id"])
    return item.join(marks, F.col("id") == F.col("f_id"), "left").drop("f_id").fillna({"is_favourite": False})


def search(item: DataFrame, tag: DataFrame, item_tag: DataFrame, query: Query, *, favourite: DataFrame | None = None, note_ids: DataFrame | None = None, null_mode: str = "sql") -> DataFrame:
    """The items that match all of the query; none for an empty or refused one.

    Each name or pattern is a semi or anti join on the tags' ids. An unknown name to include matches nothing, an unknown one to
    exclude is ignored. Without tags to include, items without any tag can match too.
    """
    if query.error or (query.empty and note_ids is None):
        return item.limit(0)
    out = item
    if query.meta or query.not_meta:
        if "favorite" in (*query.meta, *query.not_meta):
            out = with_favourites(out, favourite)
        for name in query.meta:
            out = out.where(meta_tag(name))
        for name in query.not_meta:
            out = out.where(without_meta(name, null_mode))
    counted = tag_counts(tag, item_tag) if query.like or query.not_like else None
    for name in query.include:
        out = out.join(items_with(item_tag, ids_named(tag, [name])), "id", "left_semi")
    for pattern in query.like:
        out = out.join(items_with(item_tag, resolve_wildcard(counted, pattern).select(F.col("id").alias("tag_id"))), "id", "left_semi")
    if query.exclude:
        out = out.join(items_with(item_tag, ids_named(tag, query.exclude)), "id", "left_anti")
    for pattern in query.not_like:
        out = out.join(items_with(item_tag, resolve_wildcard(counted, pattern).select(F.col("id").alias("tag_id"))), "id", "left_anti")
    if note_ids is not None:
        out = out.join(note_ids, "id", "left_semi")
    return out.select(*item.columns)


def newest(items: DataFrame, page: int = 1, limit: int = PAGE_SIZE, oldest: bool = False) -> DataFrame:
    """A page by import time, then id; beyond the last allowed page it is empty."""
    if page > MOST_PAGE:
        return items.limit(0)
    limit = min(max(limit, 1), MOST_PAGE_SIZE)
    order = [F.asc("imported_at"), F.asc("id")] if oldest else [F.desc("imported_at"), F.desc("id")]
    return items.orderBy(*order).offset((max(page, 1) - 1) * limit).limit(limit)


def neighbours(items: DataFrame, anchor: DataFrame) -> DataFrame:
    """(previous_id, next_id) of an anchor (imported_at, id) in newest order; the anchor itself need not be among items."""
    at = anchor.select(F.col("imported_at").alias("a_at"), F.col("id").alias("a_id"))
    key = F.struct("imported_at", "id")
    mark = F.struct(F.col("a_at").alias("imported_at"), F.col("a_id").alias("id"))
    rows = items.select("imported_at", "id").crossJoin(F.broadcast(at))  # the anchor is one row
    return rows.agg(F.min(F.when(key > mark, key))["id"].alias("previous_id"), F.max(F.when(key < mark, key))["id"].alias("next_id"))


def cursor_of(seed: str) -> str:
    return hashlib.sha256(seed.encode()).hexdigest()


def rotation_rank(hash_col: Column, seed: str) -> Column:
    return F.when(hash_col >= cursor_of(seed), 0).otherwise(1)


def rotated(items: DataFrame, seed: str, page: int = 1, limit: int = PAGE_SIZE) -> DataFrame:
    """A page of the order by hash that starts at the seed's hash and wraps."""
    return items.orderBy(rotation_rank(F.col("hash"), seed), "hash").offset((page - 1) * limit).limit(limit)


def rotation_neighbours(items: DataFrame, hash_: str, seed: str) -> DataFrame:
    """(previous_hash, next_hash) of an item in the rotation; its two ends have one neighbour."""
    at = int(hash_ < cursor_of(seed))
    key = F.struct(rotation_rank(F.col("hash"), seed).alias("turn"), F.col("hash"))
    mark = F.struct(F.lit(at).alias("turn"), F.lit(hash_).alias("hash"))
    return items.agg(F.max(F.when(key < mark, key))["hash"].alias("previous_hash"), F.min(F.when(key > mark, key))["hash"].alias("next_hash"))
