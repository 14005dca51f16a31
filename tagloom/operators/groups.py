"""Groups of items: merging by members, filters, orders, previews, creators and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import like_escape, valid_creator
from .facets import eligible_groups
from .search import cursor_of, tag_counts

PREVIEW, CREATORS = 10, 3
# Artists that a group's page looks at, and those that it names.
PAGE_ARTISTS, PAGE_CREATORS = 10, 5


def merged(grp: DataFrame) -> DataFrame:
    """One row for the eligible groups of equal members: smallest id, ids, types and titles in order of id, and the count."""
    parts = F.array_sort(F.collect_list(F.struct("id", "source_type", "source_id", "title")))
    rows = eligible_groups(grp).groupBy("member_hash").agg(parts.alias("parts"), F.max("member_count").alias("post_count"))
    text = lambda name: F.array_join(F.transform("parts", lambda p: p[name].cast("string")), ",", "")
    return rows.select("member_hash", F.col("parts")[0]["id"].alias("id"), text("id").alias("ids"), text("source_type").alias("source_types"), text("title").alias("titles"), "post_count")


def ordered(rows: DataFrame, order: str, seed: str = "", page: int = 1, limit: int = 48) -> DataFrame:
    """newest, oldest, largest, or random: by member hash from the seed's hash on, wrapping."""
    keys = {
        "newest": [F.desc("id")],
        "oldest": [F.asc("id")],
        "largest": [F.desc("post_count"), F.desc("id")],
        "random": [F.when(F.col("member_hash") >= cursor_of(seed)[:32], 0).otherwise(1), F.asc("member_hash")],
    }[order]
    return rows.orderBy(*keys).offset((page - 1) * limit).limit(limit)


def by_creator(grp_item: DataFrame, tag: DataFrame, item_tag: DataFrame, text: str) -> DataFrame:
    """id of the groups with a member by a valid artist whose name holds the text."""
    names = tag.where((F.col("category") == "ARTIST") & valid_creator(F.col("name")) & F.col("name").ilike(f"%{like_escape(text)}%"))
    items = item_tag.join(names.select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select("item_id")
    return grp_item.join(items, "item_id", "left_semi").select(F.col("group_id").alias("id")).distinct()


def by_text(grp: DataFrame, grp_item: DataFrame, tag: DataFrame, item_tag: DataFrame, translation: DataFrame, text: str) -> DataFrame:
    """id of the groups whose source id, title, translated title or creator holds the text."""
    like = f"%{like_escape(text)}%"
    own = grp.where(F.col("source_id").ilike(like) | F.col("title").ilike(like)).select("id")
    translated = grp.join(translation.where(F.col("translated_content").ilike(like)), F.col("title_hash") == F.col("content_hash"), "left_semi").select("id")
    return own.union(translated).union(by_creator(grp_item, tag, item_tag, text)).distinct()


def previews(grp_item: DataFrame, most: int = PREVIEW) -> DataFrame:
    """(group_id, item_id, rank): the first members by position, then id."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("position", "item_id"))
    return grp_item.select("group_id", "item_id", rank.alias("rank")).where(F.col("rank") <= most)


def creators(grp_item: DataFrame, tag: DataFrame, item_tag: DataFrame, most: int = CREATORS) -> DataFrame:
    """(group_id, creators): the valid artists of the members, by items in all, then name."""
    artists = tag_counts(tag, item_tag).where((F.col("category") == "ARTIST") & valid_creator(F.col("name"))).select(F.col("id").alias("tag_id"), "name", "post_count")
    rows = grp_item.select("group_id", "item_id").join(item_tag, "item_id").join(artists, "tag_id").groupBy("group_id", "name").agg(F.max("post_count").alias("n"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "name"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("creators"))


def page_creators(grp_item: DataFrame, tag: DataFrame, item_tag: DataFrame) -> DataFrame:
    """(group_id, creators): of the PAGE_ARTISTS artists of most items, ties by id, the first PAGE_CREATORS valid ones.

    Validity is judged after the cut, so a group of many invalid names can show none.
    """
    artists = tag_counts(tag, item_tag).where(F.col("category") == "ARTIST").select(F.col("id").alias("tag_id"), "name", "post_count")
    met = grp_item.select("group_id", "item_id").join(item_tag, "item_id").join(artists, "tag_id").select("group_id", "tag_id", "name", "post_count").distinct()
    first = Window.partitionBy("group_id")
    top = met.withColumn("place", F.row_number().over(first.orderBy(F.desc("post_count"), "tag_id"))).where(F.col("place") <= PAGE_ARTISTS)
    valid = top.where(valid_creator(F.col("name"))).withColumn("rank", F.row_number().over(first.orderBy("place"))).where(F.col("rank") <= PAGE_CREATORS)
    return valid.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("creators"))


def type_counts(grp: DataFrame) -> DataFrame:
    """(source_type, n): distinct member lists a type, and under a null type those of all groups."""
    rows = eligible_groups(grp)
    per = rows.groupBy("source_type").agg(F.count_distinct("member_hash").alias("n"))
    return per.unionByName(rows.agg(F.lit(None).cast("string").alias("source_type"), F.count_distinct("member_hash").alias("n")))


def list_stats(grp: DataFrame, matching: DataFrame) -> DataFrame:
    """(groups, merged_total, filtered): the total is never less than what the filter leaves."""
    rows = eligible_groups(grp)
    total = rows.agg(F.count("*").alias("groups"), F.count_distinct("member_hash").alias("n"))
    left = rows.join(matching, "id", "left_semi").agg(F.count_distinct("member_hash").alias("filtered"))
    return total.crossJoin(left).select("groups", F.greatest("n", "filtered").alias("merged_total"), "filtered")  # one row each


def filmstrips(grp: DataFrame, grp_item: DataFrame) -> DataFrame:
    """Groups of equal ordered members as one: the first that isn't of type TITLE stays, and carries a title and all ids."""
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"].cast("string")), ",")
    members = grp_item.groupBy(F.col("group_id").alias("id")).agg(order.alias("members"))
    keep = F.struct((F.col("source_type") == "TITLE").alias("is_title"), "id", "source_type")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    out = grp.join(members, "id").groupBy("members").agg(F.min(keep).alias("k"), F.max("title").alias("title"), ids.alias("ids"))
    return out.select(F.col("k.id").alias("id"), F.col("k.source_type").alias("source_type"), "title", "ids")


def navigation_group(grp: DataFrame, grp_item: DataFrame) -> DataFrame:
    """(item_id, group_id): for each item the group to page through: not TITLE, then larger, then of the lowest id."""
    rows = grp_item.join(grp.select(F.col("id").alias("group_id"), "source_type", "member_count"), "group_id").where("member_count >= 2")
    key = F.struct((F.col("source_type") == "TITLE").alias("is_title"), (-F.col("member_count")).alias("size"), F.col("group_id"))
    return rows.groupBy("item_id").agg(F.min(key)["group_id"].alias("group_id"))


def reading_order(grp_item: DataFrame) -> DataFrame:
    """(group_id, page, item_id, previous, next) by position, then id."""
    place = Window.partitionBy("group_id").orderBy("position", "item_id")
    return grp_item.select("group_id", F.row_number().over(place).alias("page"), "item_id", F.lag("item_id").over(place).alias("previous"), F.lead("item_id").over(place).alias("next"))


def page_of(pages: DataFrame, group_id: int, page: int) -> DataFrame:
    """The page of a group, clamped to those there are."""
    rows = pages.where(F.col("group_id") == group_id)
    last = rows.agg(F.max("page").alias("last"))
    return rows.crossJoin(F.broadcast(last)).where(F.col("page") == F.least(F.greatest(F.lit(page), F.lit(1)), F.col("last"))).drop("last")  # one row
