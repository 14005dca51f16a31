"""Facets: suggestions, co-occurring tags with remaining counts, the tag tree, related tags and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import META_TAGS, META_TEXT, Query, like_escape, meta_tag, valid_creator, without_meta
from .search import ids_named, items_with, resolve_wildcard, tag_counts, with_favourites

#: Top tags a category when nothing is selected.
BALANCED = {"ARTIST": 20, "CHARACTER": 10, "COPYRIGHT": 10, "GENERAL": 50, "META": 10}


def meta_counts(items: DataFrame, favourite: DataFrame | None = None) -> DataFrame:
    """(id, name, description, count, remaining) of every computed tag, from one pass; ids are negative."""
    marked = with_favourites(items, favourite)
    one = marked.agg(F.count("*").alias("total"), *[F.count_if(meta_tag(n)).alias(n) for n in META_TAGS])
    rows = F.explode(F.array(*[F.struct(F.lit(-i - 1).alias("id"), F.lit(n).alias("name"), F.lit(META_TEXT[n]).alias("description"), F.col(n).alias("count")) for i, n in enumerate(META_TAGS)])).alias("m")
    return one.select("total", rows).select("m.*", (F.col("total") - F.col("m.count")).alias("remaining"))


def suggest(tag: DataFrame, item_tag: DataFrame, total: DataFrame, text: str = "", category: str | None = None, limit: int = 20) -> DataFrame:
    """Tags whose name holds the text, by number of items, with what would remain without them. total: one row (total)."""
    names = _named(tag, text, category)
    edges = item_tag if "post_count" in tag.columns else item_tag.join(names.select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return _top(tag_counts(names, edges), total, limit)


def _named(tag: DataFrame, text: str, category: str | None) -> DataFrame:
    """The tags of a category, if one is given, whose name holds the text, without invalid creators."""
    rows = tag.where(F.col("name").ilike(f"%{like_escape(text)}%"))
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.where((F.col("category") != "ARTIST") | valid_creator(F.col("name")))


def _top(rows: DataFrame, total: DataFrame, limit: int) -> DataFrame:
    """The tags of most items; total is one row."""
    top = rows.orderBy(F.desc("post_count"), "name", "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("id", "name", "category", F.col("post_count").alias("count"), F.greatest(F.col("total") - F.col("post_count"), F.lit(0)).alias("remaining"))


def eligible_groups(grp: DataFrame) -> DataFrame:
    """Groups of two members or more."""
    return grp.where((F.col("member_count") >= 2) & F.col("member_hash").isNotNull())


def grouped_items(grp: DataFrame, grp_item: DataFrame) -> DataFrame:
    """id of the items that lie in an eligible group."""
    return grp_item.join(eligible_groups(grp).select(F.col("id").alias("group_id")), "group_id", "left_semi").select(F.col("item_id").alias("id")).distinct()


def suggest_grouped(tag: DataFrame, item_tag: DataFrame, grp: DataFrame, grp_item: DataFrame, text: str = "", category: str | None = None, limit: int = 20) -> DataFrame:
    """As suggest, counting only the items in eligible groups."""
    inside = grouped_items(grp, grp_item)
    names = _named(tag.select("id", "name", "category"), text, category)
    edges = item_tag.join(names.select(F.col("id").alias("tag_id")), "tag_id", "left_semi").join(inside.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    rows = names.join(edges.groupBy("tag_id").agg(F.count("*").alias("post_count")), F.col("id") == F.col("tag_id"))
    return _top(rows, inside.agg(F.count("*").alias("total")), limit)


def filtered_items(item: DataFrame, tag: DataFrame, item_tag: DataFrame, query: Query, *, favourite: DataFrame | None = None, grouped: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """id of the items that the selected terms leave.

    Terms to include are intersected; with none, items with any tag are the start. distinct=False keeps an item once for each
    tag id of a single name, which only the total of the facets sees.
    """
    counted = tag_counts(tag, item_tag) if query.like or query.not_like else None
    of_pattern = lambda p: items_with(item_tag, resolve_wildcard(counted, p).select(F.col("id").alias("tag_id")))
    parts = [items_with(item_tag, ids_named(tag, [n])) for n in query.include] + [of_pattern(p) for p in query.like]
    start = parts[0] if parts else item.select("id") if (query.meta or query.not_meta) and not (query.exclude or query.not_like) else item_tag.select(F.col("item_id").alias("id"))
    simple = len(parts) == 1 and not (query.exclude or query.not_like or query.meta or query.not_meta or grouped is not None)
    out = start if simple and not distinct else start.distinct()
    for p in parts[1:]:
        out = out.join(p, "id", "left_semi")
    if query.exclude:
        out = out.join(items_with(item_tag, ids_named(tag, query.exclude)), "id", "left_anti")
    for p in query.not_like:
        out = out.join(of_pattern(p), "id", "left_anti")
    if query.meta or query.not_meta:
        kept = with_favourites(item, favourite)
        for n in query.meta:
            kept = kept.where(meta_tag(n))
        for n in query.not_meta:
            kept = kept.where(without_meta(n, "keep"))
        out = out.join(kept.select("id"), "id", "left_semi")
    return out if grouped is None else out.join(grouped, "id", "left_semi")


def cooccurring(item: DataFrame, tag: DataFrame, item_tag: DataFrame, query: Query, *, text: str = "", category: str | None = None, favourite: DataFrame | None = None, grouped: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(id, name, category, count, remaining) of the tags on the items that the query leaves.

    The query's own tags are left out. Without a text, tags on all items are left out too, as they narrow nothing.
    """
    left = filtered_items(item, tag, item_tag, query, favourite=favourite, grouped=grouped, distinct=False)
    total = left.agg(F.count("*").alias("total"))
    own = tag.where(F.lower("name").isin(*[n.lower() for n in (*query.include, *query.exclude)])) if query.include or query.exclude else tag.limit(0)
    counted = tag_counts(tag, item_tag) if query.like or query.not_like else None
    names = tag.where(F.col("name").ilike(f"%{like_escape(text)}%"))
    names = names.where(F.col("category") == category) if category else names
    names = names.where((F.col("category") != "ARTIST") | valid_creator(F.col("name"))).join(own.select("id"), "id", "left_anti")
    for p in (*query.like, *query.not_like):
        names = names.join(resolve_wildcard(counted, p).select("id"), "id", "left_anti")
    counts = item_tag.join(left.select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy("tag_id").agg(F.count("*").alias("count"))
    rows = names.join(counts, F.col("id") == F.col("tag_id")).crossJoin(F.broadcast(total)).withColumn("remaining", F.col("total") - F.col("count"))  # total is one row
    rows = rows if text else rows.where("remaining > 0")
    return rows.orderBy(F.desc("count"), "id").limit(limit).select("id", "name", "category", "count", "remaining")


def tree(item: DataFrame, tag: DataFrame, item_tag: DataFrame, query: Query, limit: int = 50) -> DataFrame:
    """(id, name, category, post_count, count, remaining) for a selection, counting each item once."""
    left = filtered_items(item, tag, item_tag, query)
    total = left.agg(F.count("*").alias("total"))
    own = ids_named(tag, [*query.include, *query.exclude]) if query.include or query.exclude else None
    counts = item_tag.join(left.select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy("tag_id").agg(F.count("*").alias("count"))
    rows = tag_counts(tag, item_tag).join(counts, F.col("id") == F.col("tag_id")).drop("tag_id")
    rows = rows.join(own.withColumnRenamed("tag_id", "id"), "id", "left_anti") if own is not None else rows
    rows = rows.crossJoin(F.broadcast(total)).withColumn("remaining", F.col("total") - F.col("count")).where("remaining > 0")
    return rows.orderBy(F.desc("count"), "id").limit(limit).select("id", "name", "category", "post_count", "count", "remaining")


def balanced(tag: DataFrame, item_tag: DataFrame, limits: dict[str, int] = BALANCED) -> DataFrame:
    """The top tags of each category, as many as its limit."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("post_count"), "id"))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    rows = tag_counts(tag, item_tag).withColumn("rank", rank)
    return rows.where((F.col("rank") <= max(limits.values())) & (F.col("rank") <= most[F.col("category")])).select("id", "name", "category", "post_count", "rank")


def related(page: DataFrame, tag: DataFrame, item_tag: DataFrame, query: Query, limit: int = 30) -> DataFrame:
    """(id, name, category, count) of the tags on a page's items, without the query's own names."""
    names = [n.lower() for n in (*query.include, *query.exclude)]
    edges = item_tag.join(page.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    counts = edges.groupBy("tag_id").agg(F.count("*").alias("count"))
    rows = tag.join(counts, F.col("id") == F.col("tag_id"))
    rows = rows.where(~F.lower("name").isin(*names)) if names else rows
    return rows.orderBy(F.desc("count"), "name", "id").limit(limit).select("id", "name", "category", "count")


def listing(tag: DataFrame, item_tag: DataFrame, text: str = "", category: str | None = None, sort: str = "-count", limit: int = 100, page: int = 1) -> DataFrame:
    """A page of tags sorted by count or name, a leading '-' for descending."""
    rows = tag_counts(tag, item_tag).where(F.col("name").ilike(f"%{like_escape(text)}%"))
    rows = rows.where(F.col("category") == category) if category else rows
    key = "post_count" if sort.lstrip("-") == "count" else "name"
    order = F.desc(key) if sort.startswith("-") else F.asc(key)
    limit = min(max(limit, 1), 200)
    return rows.orderBy(order, "id").offset((page - 1) * limit).limit(limit).select("id", "name", "category", "post_count")
