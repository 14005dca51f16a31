"""Ingest: nested metadata to relations, differences between snapshots, and cleanup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import tag_category, tag_name
from ..functions.titles import base_title, title_key, title_number
from ..functions.urls import source_id, source_type


def current_tags(meta: DataFrame) -> DataFrame:
    """(file_id, raw) of the displayed current tags of all services, without nulls, blanks and system tags."""
    rows = meta.select("file_id", F.explode(F.map_values("tags")).alias("s")).select("file_id", F.explode(F.element_at("s.display_tags", "0")).alias("raw"))
    return rows.where(F.col("raw").isNotNull() & (F.trim("raw") != "") & ~F.lower("raw").startswith("system:"))


def tags(meta: DataFrame) -> DataFrame:
    """(file_id, name, category), once for each file whatever the case of the spelling; the least spelling stands for all."""
    rows = current_tags(meta).select("file_id", tag_name(F.col("raw")).alias("name"), tag_category(F.col("raw")).alias("category"))
    return rows.groupBy("file_id", "category", F.lower("name").alias("k")).agg(F.min("name").alias("name")).select("file_id", "name", "category")


def imported_at(services: Column) -> Column:
    """The time of the first service, in the order of their names, that has one."""
    times = F.filter(F.array_sort(F.map_entries(services)), lambda e: e["value"]["time_imported"].isNotNull())
    return F.timestamp_seconds(F.get(times, F.lit(0))["value"]["time_imported"])


def files(meta: DataFrame, now: str) -> DataFrame:
    """One row a file: the card columns, orientation and import time, which is now where no service has one."""
    w, h = F.col("width"), F.col("height")
    orientation = F.when(w.isNull() | h.isNull(), None).when(w > h, "landscape").when(h > w, "portrait").otherwise("square")
    at = F.coalesce(imported_at(F.col("file_services.current")), F.lit(now).cast("timestamp"))
    return meta.select("file_id", "hash", "size", F.col("mime").alias("mime_type"), "width", "height", "duration", "has_audio", "blurhash", orientation.alias("orientation"), at.alias("imported_at"))


def notes(meta: DataFrame) -> DataFrame:
    rows = meta.select("file_id", F.explode("notes").alias("name", "content"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def url_groups(meta: DataFrame) -> DataFrame:
    """(file_id, source_type, source_id, position) of the works that known urls name; the page number counts from 1, else 0."""
    rows = meta.select("file_id", F.explode("known_urls").alias("url"))
    page = F.when(F.col("url").rlike(r"_p\d+"), F.regexp_extract("url", r"_p(\d+)", 1).cast("long") + 1).when(F.col("url").rlike(r"/media/\D*\d+"), F.regexp_extract("url", r"/media/\D*(\d+)", 1).cast("decimal(38,0)").cast("long") + 1).otherwise(0)
    rows = rows.select("file_id", source_type(F.col("url")).alias("source_type"), source_id(F.col("url")).alias("source_id"), page.alias("position"))
    return rows.where("source_type IS NOT NULL").groupBy("file_id", "source_type", "source_id").agg(F.max("position").alias("position"))


def title_groups(meta: DataFrame) -> DataFrame:
    """(file_id, source_type, source_id, title, position) of title tags; a page tag's number wins over the
    title's own, and titles that are empty or a number without it group nothing."""
    raw = current_tags(meta)
    low = F.lower("raw")
    titles = raw.where(low.startswith("title:")).select("file_id", F.trim(F.substring("raw", 7, 1 << 30)).alias("t")).where("t <> ''")
    pages = raw.where(low.startswith("page:")).select("file_id", F.regexp_extract(F.trim(F.substring("raw", 6, 1 << 30)), r"^(\d+)", 1).try_cast("long").alias("page")).where("page > 0").groupBy("file_id").agg(F.min("page").alias("page"))
    rows = titles.join(pages, "file_id", "left").withColumn("title", base_title(F.col("t"))).withColumn("position", F.coalesce("page", title_number(F.col("t"))))
    rows = rows.where("title <> '' AND NOT rlike(title, '^[0-9]+$')").withColumn("source_id", title_key(F.col("title")))
    return rows.groupBy("file_id", F.lit("TITLE").alias("source_type"), "source_id").agg(F.min("title").alias("title"), F.min("position").alias("position"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The keys whose row was added, removed or changed, with the change; nulls are values like others."""
    has = lambda df, n: df.select(*[F.col(k).alias(f"{n}_{k}") for k in keys], F.lit(True).alias(f"{n}_has"), *[F.col(v).alias(f"{n}_{v}") for v in values])
    cond = reduce(Column.__and__, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    joined = has(old, "a").join(has(new, "b"), cond, "full_outer")
    same = reduce(Column.__and__, [F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values], F.lit(True))
    change = F.when(F.col("a_has").isNull(), "added").when(F.col("b_has").isNull(), "removed").when(~same, "changed")
    return joined.select(*[F.when(F.col("a_has").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys], change.alias("change")).where("change IS NOT NULL")


def changed_owners(old: DataFrame, new: DataFrame, owner: str, values: list[str]) -> DataFrame:
    """The owners whose set of values differs; only their relations are replaced."""
    return diff(old.distinct(), new.distinct(), [owner, *values], []).select(owner).distinct()


def orphan_tags(tag: DataFrame, item_tag: DataFrame) -> DataFrame:
    return tag.join(item_tag.select(F.col("tag_id").alias("id")), "id", "left_anti")


def orphan_groups(grp: DataFrame, grp_item: DataFrame) -> DataFrame:
    return grp.join(grp_item.select(F.col("group_id").alias("id")), "id", "left_anti")


def vanished(item: DataFrame, upstream_hashes: DataFrame) -> DataFrame:
    """Items that upstream no longer has; none if upstream has nothing at all."""
    if upstream_hashes.isEmpty():
        return item.limit(0)
    return item.join(upstream_hashes.select("hash"), "hash", "left_anti")
