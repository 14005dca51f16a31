"""The library's queries over the driver tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import titles, urls
from ..functions.tags import META_TAGS, META_TEXT, parse_terms, tag_category, tag_name, valid_creator
from ..operators import facets, feed, fulltext, groups, ingest, recommend, search, similar, stats
from ..sources.store import held
from ..streaming import counters
from .gallery import AS_OF, Gallery, sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None, name: str | None = None):
    """Registers f(gallery) under its name, with the body of its SQL."""

    def wrap(f: Callable[[Gallery], DataFrame]):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(Gallery(spark, sf_dir))
        if oracle:
            ORACLES[name or f.__name__] = sql(oracle)
        return f

    return wrap


# --- derived columns

COUNTED = "counted AS (SELECT t.*, coalesce(n, 0) AS post_count FROM tag t LEFT JOIN (SELECT tag_id, count(*) AS n FROM item_tag GROUP BY tag_id) ON id = tag_id)"
WEIGHT = "weight AS (SELECT tag_id, count(*) AS post_count, (SELECT count(*) FROM item) AS items, greatest(0.0, ln((SELECT count(*) FROM item) / count(*))) AS idf FROM item_tag GROUP BY tag_id)"


@query(f"{COUNTED} SELECT id, name, category, post_count FROM counted")
def tag_post_count(g):
    return search.tag_counts(g.tag, g.item_tag).select("id", "name", "category", "post_count")


@query(f"{WEIGHT} SELECT tag_id, post_count, round(idf, 9) AS idf FROM weight")
def tag_idf(g):
    return recommend.weights(g.item, g.item_tag).select("tag_id", "post_count", F.round("idf", 9).alias("idf"))


@query(f"{WEIGHT} SELECT id AS item_id, round(coalesce(norm, 0), 6) AS norm FROM item LEFT JOIN (SELECT item_id, sqrt(sum(idf * idf)) AS norm FROM item_tag JOIN weight USING (tag_id) GROUP BY item_id) ON id = item_id")
def item_tag_norm(g):
    return recommend.norms(g.item, g.item_tag, recommend.weights(g.item, g.item_tag)).select("item_id", F.round("norm", 6).alias("norm"))


@query("SELECT orientation, count(*) AS n FROM item GROUP BY orientation")
def item_orientation(g):
    return g.item.groupBy("orientation").agg(F.count("*").alias("n"))


@query("SELECT id, member_count, member_hash FROM grp")
def group_member_hash(g):
    return g.grp.select("id", "member_count", "member_hash")


@query("SELECT content_hash, count(*) AS notes FROM note GROUP BY content_hash")
def content_hash_dedupe(g):
    return g.note.groupBy("content_hash").agg(F.count("*").alias("notes"))


# --- search

TAGGED = "(SELECT item_id FROM item_tag JOIN tag ON tag.id = tag_id WHERE lower(tag.name) = '{}')"
PAGE = "SELECT id, hash, width, height, mime_type FROM item WHERE {} ORDER BY imported_at DESC, id DESC LIMIT 48 OFFSET {}"
CARD = ("id", "hash", "width", "height", "mime_type")
LIKE = "(SELECT item_id FROM item_tag WHERE tag_id IN (SELECT id FROM counted WHERE name ILIKE '{}' ORDER BY post_count DESC, id LIMIT 500))"


def terms(name: str, text: str, condition: str, *, page: int = 1, null_mode: str = "sql", ctes: str = "") -> None:
    """A page of a search."""

    def run(g):
        fav = g.favourite if "favorite" in text else None
        return search.newest(search.search(g.item, g.counted, g.item_tag, parse_terms(text), favourite=fav, null_mode=null_mode), page).select(*CARD)

    query(f"{ctes} {PAGE.format(condition, (page - 1) * 48)}", name)(run)


terms("search_single_tag", "Red Plate", f"id IN {TAGGED.format('red plate')}")
terms("search_and_2", "red plate, blue ring", f"id IN {TAGGED.format('red plate')} AND id IN {TAGGED.format('blue ring')}")
terms("search_and_3", "red plate, blue ring, hot gear", f"id IN {TAGGED.format('red plate')} AND id IN {TAGGED.format('blue ring')} AND id IN {TAGGED.format('hot gear')}")
terms("search_exclude", "red plate, -old rod", f"id IN {TAGGED.format('red plate')} AND id NOT IN {TAGGED.format('old rod')}")
terms("search_exclude_only", "-red plate, -no such tag", f"id NOT IN {TAGGED.format('red plate')}")
terms("search_unknown_tag", "red plate, no such tag", "false")
terms("search_wildcard_prefix", "red*", f"id IN {LIKE.format('red%')}", ctes=COUNTED)
terms("search_wildcard_suffix", "*gizmo, small ring", f"id IN {LIKE.format('%gizmo')} AND id IN {TAGGED.format('small ring')}", ctes=COUNTED)
terms("search_wildcard_exclude", "hot gear, -*rod, -cold*", f"id IN {TAGGED.format('hot gear')} AND id NOT IN {LIKE.format('%rod')} AND id NOT IN {LIKE.format('cold%')}", ctes=COUNTED)
terms("search_like_escape", "red_plate*", "false")
terms("search_page_5", "red*", f"id IN {LIKE.format('red%')}", page=5, ctes=COUNTED)
terms("search_flagship", "red plate, blue ring, -old rod, landscape", f"id IN {TAGGED.format('red plate')} AND id IN {TAGGED.format('blue ring')} AND id NOT IN {TAGGED.format('old rod')} AND orientation = 'landscape'")

META_SQL = {
    "video": "mime_type LIKE 'video/%'", "animated": "mime_type IN ('image/gif', 'image/apng')", "portrait": "orientation = 'portrait'",
    "landscape": "orientation = 'landscape'", "square": "orientation = 'square'", "highres": "(width >= 1920 OR height >= 1920)",
    "lowres": "(width IS NOT NULL AND height IS NOT NULL AND width <= 500 AND height <= 500)", "favorite": "id IN (SELECT item_id FROM favourite)",
}
for _n, _c in META_SQL.items():
    terms(f"search_meta_{_n}", _n, _c)
terms("search_meta_negated_3vl", "-portrait, red plate", f"NOT orientation = 'portrait' AND id IN {TAGGED.format('red plate')}")
terms("search_meta_negated_keepnull", "-portrait, red plate", f"(orientation <> 'portrait' OR orientation IS NULL) AND id IN {TAGGED.format('red plate')}", null_mode="keep")
terms("search_meta_negated_sizes", "-highres, -lowres", "NOT (width >= 1920 OR height >= 1920) AND NOT (width IS NOT NULL AND height IS NOT NULL AND width <= 500 AND height <= 500)")


@query(f"{COUNTED} SELECT id, name, post_count FROM counted WHERE name ILIKE '%ring%' ORDER BY post_count DESC, id LIMIT 500")
def wildcard_resolve(g):
    return search.resolve_wildcard(g.counted, "*ring*").select("id", "name", "post_count")


@query(f"{COUNTED} SELECT count(*) > 500 AS truncated FROM counted WHERE name ILIKE '%e%'")
def wildcard_truncated(g):
    return search.wildcard_truncated(g.counted, "*e*")


@query("SELECT count(*) AS n FROM item")
def search_total(g):
    return g.item.agg(F.count("*").alias("n"))


ANCHOR = "(SELECT imported_at, id FROM item WHERE id = 77)"


def _around(condition: str) -> str:
    return f"""a AS {ANCHOR} SELECT (SELECT i.id FROM item i, a WHERE {condition} AND (i.imported_at, i.id) > (a.imported_at, a.id) ORDER BY i.imported_at, i.id LIMIT 1) AS previous_id,
        (SELECT i.id FROM item i, a WHERE {condition} AND (i.imported_at, i.id) < (a.imported_at, a.id) ORDER BY i.imported_at DESC, i.id DESC LIMIT 1) AS next_id"""


@query(_around(f"i.id IN {TAGGED.format('red plate')}"))
def neighbors_search(g):
    return search.neighbours(search.search(g.item, g.counted, g.item_tag, parse_terms("red plate")), g.item.where("id = 77"))


@query(_around("true"))
def neighbors_gallery(g):
    return search.neighbours(g.item, g.item.where("id = 77"))


_CURSOR = search.cursor_of("seed-7")


@query(f"SELECT id, hash FROM item ORDER BY CASE WHEN hash >= '{_CURSOR}' THEN 0 ELSE 1 END, hash LIMIT 48")
def rotation_page(g):
    return search.rotated(g.item, "seed-7").select("id", "hash")


@query(f"SELECT id, hash FROM item WHERE mime_type = 'image/gif' ORDER BY CASE WHEN hash >= '{search.cursor_of('zz-18')}' THEN 0 ELSE 1 END, hash LIMIT 100 OFFSET 100")
def rotation_wrap(g):
    return search.rotated(g.item.where("mime_type = 'image/gif'"), "zz-18", page=2, limit=100).select("id", "hash")


@query(f"r AS (SELECT hash, row_number() OVER (ORDER BY CASE WHEN hash >= '{_CURSOR}' THEN 0 ELSE 1 END, hash) AS n FROM item), a AS (SELECT n FROM r WHERE hash = sha256('77')) SELECT (SELECT hash FROM r, a WHERE r.n = a.n - 1) AS previous_hash, (SELECT hash FROM r, a WHERE r.n = a.n + 1) AS next_hash")
def rotation_neighbors(g):
    import hashlib

    return search.rotation_neighbours(g.item, hashlib.sha256(b"77").hexdigest(), "seed-7")


@query("SELECT id, hash FROM item ORDER BY imported_at, id LIMIT 48 OFFSET 48")
def gallery_oldest(g):
    return search.newest(g.item, 2, oldest=True).select("id", "hash")


# --- facets

VALID = "(category <> 'ARTIST' OR (NOT regexp_matches(name, '^[0-9]+$') AND NOT regexp_matches(name, '(?i)^user[\\s_]*[a-z]{4}[0-9]{4}$')))"


@query(f"{COUNTED} SELECT id, name, category, post_count AS count, greatest((SELECT count(*) FROM item) - post_count, 0) AS remaining FROM counted WHERE name ILIKE '%gear%' AND {VALID} ORDER BY post_count DESC, name, id LIMIT 20")
def suggest_simple(g):
    return facets.suggest(g.counted, g.item_tag, g.item.agg(F.count("*").alias("total")), "gear")


@query(f"{COUNTED} SELECT id, name, category, post_count AS count, greatest((SELECT count(*) FROM item) - post_count, 0) AS remaining FROM counted WHERE category = 'ARTIST' AND {VALID} ORDER BY post_count DESC, name, id LIMIT 50")
def suggest_popular(g):
    return facets.suggest(g.counted, g.item_tag, g.item.agg(F.count("*").alias("total")), category="ARTIST", limit=50)


GROUPED = "eligible AS (SELECT * FROM grp WHERE member_count >= 2 AND member_hash IS NOT NULL), inside AS (SELECT DISTINCT item_id AS id FROM grp_item WHERE group_id IN (SELECT id FROM eligible))"


@query(f"{GROUPED}, c AS (SELECT tag_id, count(*) AS n FROM item_tag WHERE item_id IN (SELECT id FROM inside) GROUP BY tag_id) SELECT id, name, category, n AS count, greatest((SELECT count(*) FROM inside) - n, 0) AS remaining FROM tag JOIN c ON id = tag_id WHERE name ILIKE '%ring%' AND {VALID} ORDER BY n DESC, name, id LIMIT 20")
def suggest_grouped(g):
    return facets.suggest_grouped(g.tag, g.item_tag, g.grp, g.grp_item, "ring")


@query("names AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN 'user_abcd' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') ELSE 'maker ' || o_orderkey END AS name, 'ARTIST' AS category FROM orders) SELECT name FROM names WHERE " + VALID)
def suggest_valid_creator(g):
    names = g.table("orders").selectExpr("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) WHEN o_orderkey % 3 = 1 THEN concat('user_abcd', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) ELSE concat('maker ', o_orderkey) END AS name")
    return names.where(valid_creator(F.col("name")))


_META_ROWS = " UNION ALL ".join(f"SELECT {-i - 1} AS id, '{n}' AS name, '{META_TEXT[n]}' AS description, count(*) FILTER (WHERE {META_SQL[n]}) AS count, count(*) - count(*) FILTER (WHERE {META_SQL[n]}) AS remaining FROM item" for i, n in enumerate(META_TAGS))


@query(_META_ROWS)
def meta_counts(g):
    return facets.meta_counts(g.item, g.favourite)


def cooccurrence(name: str, text: str, left: str, own: tuple[str, ...], *, grouped: bool = False, typed: str = "", category: str | None = None, ctes: str = "") -> None:
    """Facets of a selection; left: SQL of the items that it leaves, with repetitions."""
    without = " AND ".join(f"lower(name) <> '{o}'" for o in own) or "true"
    body = f"""{ctes + ', ' if ctes else ''}l AS ({left}), c AS (SELECT tag_id, count(*) AS count FROM item_tag WHERE item_id IN (SELECT id FROM l) GROUP BY tag_id)
        SELECT id, name, category, count, (SELECT count(*) FROM l) - count AS remaining FROM tag JOIN c ON id = tag_id
        WHERE {without} AND name ILIKE '%{typed}%' AND {VALID} {f"AND category = '{category}'" if category else ''} {'' if typed else 'AND (SELECT count(*) FROM l) - count > 0'} ORDER BY count DESC, id LIMIT 20"""

    def run(g):
        fav = g.favourite if "favorite" in text else None
        inside = facets.grouped_items(g.grp, g.grp_item) if grouped else None
        return facets.cooccurring(g.item, g.counted, g.item_tag, parse_terms(text), text=typed, category=category, favourite=fav, grouped=inside)

    query(body, name)(run)


_T = "SELECT item_id AS id FROM item_tag JOIN tag ON tag.id = tag_id WHERE lower(tag.name) = '{}'"
cooccurrence("facets_cooccurrence", "red plate", _T.format("red plate"), ("red plate",))
cooccurrence("cooccur_2", "red plate, blue ring", f"{_T.format('red plate')} INTERSECT {_T.format('blue ring')}", ("red plate", "blue ring"))
cooccurrence("cooccur_exclude", "red plate, -blue ring", f"{_T.format('red plate')} EXCEPT {_T.format('blue ring')}", ("red plate", "blue ring"))
cooccurrence("cooccur_exclude_only", "-blue ring", f"SELECT item_id AS id FROM item_tag EXCEPT {_T.format('blue ring')}", ("blue ring",))
cooccurrence("cooccur_meta", "red plate, landscape, -favorite", f"{_T.format('red plate')} INTERSECT SELECT id FROM item WHERE orientation = 'landscape' AND id NOT IN (SELECT item_id FROM favourite)", ("red plate",))
cooccurrence("cooccur_grouped", "red plate", f"{_T.format('red plate')} INTERSECT SELECT id FROM inside", ("red plate",), grouped=True, ctes=GROUPED)
cooccurrence("cooccur_typed", "red plate, blue ring", f"{_T.format('red plate')} INTERSECT {_T.format('blue ring')}", ("red plate", "blue ring"), typed="gear", category="GENERAL")


@query(f"SELECT (SELECT count(*) FROM ({_T.format('red plate')})) AS with_repeats, (SELECT count(DISTINCT id) FROM ({_T.format('red plate')})) AS items")
def cooccur_total_quirk(g):
    q = parse_terms("red plate")
    a = facets.filtered_items(g.item, g.tag, g.item_tag, q, distinct=False).agg(F.count("*").alias("with_repeats"))
    return a.crossJoin(facets.filtered_items(g.item, g.tag, g.item_tag, q).agg(F.count("*").alias("items")))  # one row each


_LIMIT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in facets.BALANCED.items()) + " END"


@query(f"{COUNTED}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY post_count DESC, id) AS rank FROM counted) SELECT id, name, category, post_count, rank FROM r WHERE rank <= {_LIMIT}")
def tree_balanced(g):
    return facets.balanced(g.counted, g.item_tag)


@query(f"{COUNTED}, l AS ({_T.format('red plate')} INTERSECT {_T.format('blue ring')}), c AS (SELECT tag_id, count(*) AS count FROM item_tag WHERE item_id IN (SELECT id FROM l) GROUP BY tag_id) SELECT id, name, category, post_count, count, (SELECT count(*) FROM l) - count AS remaining FROM counted JOIN c ON id = tag_id WHERE lower(name) NOT IN ('red plate', 'blue ring') AND (SELECT count(*) FROM l) - count > 0 ORDER BY count DESC, id LIMIT 50")
def tree_selected(g):
    return facets.tree(g.item, g.counted, g.item_tag, parse_terms("red plate, blue ring"))


@query(f"p AS ({PAGE.format(f'id IN {TAGGED.format(chr(114) + "ed plate")}', 0)}), c AS (SELECT tag_id, count(*) AS count FROM item_tag WHERE item_id IN (SELECT id FROM p) GROUP BY tag_id) SELECT t.id, name, category, count FROM tag t JOIN c ON t.id = tag_id WHERE lower(name) <> 'red plate' ORDER BY count DESC, name, t.id LIMIT 30")
def related_tags_page(g):
    q = parse_terms("red plate")
    return facets.related(search.newest(search.search(g.item, g.tag, g.item_tag, q)), g.tag, g.item_tag, q)


@query(f"{COUNTED} SELECT id, name, category, post_count FROM counted ORDER BY post_count DESC, id LIMIT 100")
def tag_listing_count(g):
    return facets.listing(g.counted, g.item_tag)


@query(f"{COUNTED} SELECT id, name, category, post_count FROM counted WHERE category = 'META' AND name ILIKE '%ring%' ORDER BY name, id LIMIT 100")
def tag_listing_name(g):
    return facets.listing(g.counted, g.item_tag, "ring", "META", "name")


@query("SELECT category, count(*) AS n FROM tag GROUP BY category UNION ALL SELECT NULL, count(*) FROM tag")
def category_counts(g):
    per = g.tag.groupBy("category").agg(F.count("*").alias("n"))
    return per.unionByName(g.tag.agg(F.lit(None).cast("string").alias("category"), F.count("*").alias("n")))


# --- groups

ELIGIBLE = "eligible AS (SELECT * FROM grp WHERE member_count >= 2 AND member_hash IS NOT NULL)"
MERGED = f"{ELIGIBLE}, merged AS (SELECT member_hash, min(id) AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, string_agg(source_type, ',' ORDER BY id) AS source_types, string_agg(coalesce(title, ''), ',' ORDER BY id) AS titles, max(member_count) AS post_count FROM eligible GROUP BY member_hash)"


@query(f"{ELIGIBLE} SELECT source_type, count(DISTINCT member_hash) AS n FROM eligible GROUP BY source_type UNION ALL SELECT NULL, count(DISTINCT member_hash) FROM eligible")
def group_type_counts(g):
    return groups.type_counts(g.grp)


def _creator(text: str) -> str:
    return f"SELECT DISTINCT group_id AS id FROM grp_item WHERE item_id IN (SELECT item_id FROM item_tag WHERE tag_id IN (SELECT id FROM tag WHERE category = 'ARTIST' AND {VALID} AND name ILIKE '%{text}%'))"


@query(f"{ELIGIBLE} SELECT count(*) AS groups, greatest(count(DISTINCT member_hash), count(DISTINCT member_hash) FILTER (WHERE id IN ({_creator('red ring')}))) AS merged_total, count(DISTINCT member_hash) FILTER (WHERE id IN ({_creator('red ring')})) AS filtered FROM eligible")
def group_list_stats(g):
    return groups.list_stats(g.grp, groups.by_creator(g.grp_item, g.tag, g.item_tag, "red ring"))


for _name, _sql in (("newest", "id DESC"), ("oldest", "id"), ("largest", "post_count DESC, id DESC"), ("random", f"CASE WHEN member_hash >= '{_CURSOR[:32]}' THEN 0 ELSE 1 END, member_hash")):
    query(f"{MERGED} SELECT * FROM merged ORDER BY {_sql} LIMIT 48", f"group_merge_{_name}")(lambda g, order=_name: groups.ordered(groups.merged(g.grp), order, "seed-7"))


@query(f"{MERGED} SELECT * FROM merged")
def group_merge(g):
    return groups.merged(g.grp)


@query(f"SELECT id FROM grp WHERE source_id ILIKE '%12%' OR title ILIKE '%12%' UNION SELECT id FROM grp WHERE title_hash IN (SELECT content_hash FROM translation WHERE translated_content ILIKE '%12%') UNION {_creator('12')}")
def group_filter_query(g):
    return groups.by_text(g.grp, g.grp_item, g.tag, g.item_tag, g.translation, "12")


@query(_creator("blue g"))
def group_filter_creator(g):
    return groups.by_creator(g.grp_item, g.tag, g.item_tag, "blue g")


@query("r AS (SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY position, item_id) AS rank FROM grp_item) SELECT * FROM r WHERE rank <= 10")
def group_preview_10(g):
    return groups.previews(g.grp_item)


@query(f"{COUNTED}, a AS (SELECT group_id, name, max(post_count) AS n FROM grp_item JOIN item_tag USING (item_id) JOIN counted ON id = tag_id WHERE category = 'ARTIST' AND {VALID} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, name) AS k FROM a) SELECT group_id, string_agg(name, ', ' ORDER BY k) AS creators FROM r WHERE k <= 3 GROUP BY group_id")
def group_creators(g):
    return groups.creators(g.grp_item, g.tag, g.item_tag)


@query("m AS (SELECT group_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY position, item_id) AS members FROM grp_item GROUP BY group_id), j AS (SELECT grp.*, members FROM grp JOIN m ON id = group_id) SELECT arg_min(id, (source_type = 'TITLE', id)) AS id, arg_min(source_type, (source_type = 'TITLE', id)) AS source_type, max(title) AS title, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM j GROUP BY members")
def filmstrip_dedupe(g):
    return groups.filmstrips(g.grp, g.grp_item)


@query("SELECT item_id, arg_min(group_id, (source_type = 'TITLE', -member_count, group_id)) AS group_id FROM grp_item JOIN grp ON id = group_id WHERE member_count >= 2 GROUP BY item_id")
def navigation_group(g):
    return groups.navigation_group(g.grp, g.grp_item)


@query("SELECT group_id, row_number() OVER w AS page, item_id, lag(item_id) OVER w AS previous, lead(item_id) OVER w AS next FROM grp_item WINDOW w AS (PARTITION BY group_id ORDER BY position, item_id)")
def reading_order(g):
    return groups.reading_order(g.grp_item)


@query("p AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY position, item_id) AS page, item_id FROM grp_item WHERE group_id = 70) SELECT * FROM p WHERE page = (SELECT max(page) FROM p)")
def reading_page_clamped(g):
    return groups.page_of(groups.reading_order(g.grp_item), 70, 999).select("group_id", "page", "item_id")


# --- similarity

SEEDS = f"SELECT item_id AS seed FROM favourite ORDER BY \"at\" DESC, item_id LIMIT {feed.RECENT}"
REC = f"""{WEIGHT}, norm AS (SELECT item_id, sqrt(sum(idf * idf)) AS norm FROM item_tag JOIN weight USING (tag_id) GROUP BY item_id),
kept AS (SELECT tag_id, idf FROM weight WHERE post_count > 1 AND post_count <= greatest(500, floor(0.30 * items))),
seeds AS ({SEEDS}),
own0 AS (SELECT seed, tag_id, idf, row_number() OVER (PARTITION BY seed ORDER BY idf DESC, tag_id) AS place FROM seeds JOIN item_tag ON item_id = seed JOIN kept USING (tag_id)),
own AS (SELECT * FROM own0 WHERE place <= 64),
met AS (SELECT seed, t.item_id, sum(idf * idf) AS shared FROM own o JOIN item_tag t USING (tag_id) WHERE place <= 16 AND t.item_id <> seed AND NOT EXISTS (SELECT 1 FROM grp_item a JOIN grp_item b USING (group_id) WHERE a.item_id = seed AND b.item_id = t.item_id) GROUP BY seed, t.item_id),
best0 AS (SELECT seed, m.item_id, norm, row_number() OVER (PARTITION BY seed ORDER BY round(CASE WHEN norm > 0 THEN shared / norm END, 9) DESC NULLS LAST, m.item_id) AS place FROM met m JOIN norm USING (item_id)),
best AS (SELECT * FROM best0 WHERE place <= 800),
dots AS (SELECT b.seed, b.item_id, any_value(b.norm) AS norm, sum(idf * idf) AS dot FROM best b JOIN item_tag t USING (item_id) JOIN own o ON o.seed = b.seed AND o.tag_id = t.tag_id GROUP BY b.seed, b.item_id),
scored AS (SELECT seed, d.item_id, round(CASE WHEN d.norm * s.norm > 0 THEN dot / (d.norm * s.norm) ELSE 0 END, 9) AS score FROM dots d JOIN norm s ON s.item_id = seed),
ranked AS (SELECT seed AS item_id, item_id AS recommended_id, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, item_id) AS rank FROM scored)"""


@query(f"{REC} SELECT item_id, recommended_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10")
def rec_batch(g):
    """One batch of seeds as a feed asks for: the newest favourites."""
    seeds = g.favourite.orderBy(F.desc("at"), "item_id").limit(feed.RECENT).select("item_id")
    return recommend.recommend(seeds, g.item, g.item_tag, g.grp_item, weight=g.weight, norm=g.norm).withColumn("score", F.round("score", 6))


@query(None)
def rec_all(g):
    """Recommendations of every item; a brute-force test stands for SQL, which is too slow over all."""
    return recommend.recommend_all(g.item, g.item_tag, g.grp_item, weight=g.weight, norm=g.norm).withColumn("score", F.round("score", 6))


@query(f"{WEIGHT} SELECT count(*) AS tags, count(*) FILTER (WHERE post_count > 1 AND post_count <= greatest(500, floor(0.30 * items))) AS kept FROM weight")
def rec_floor(g):
    ok = (F.col("post_count") > 1) & (F.col("post_count") <= F.greatest(F.lit(500), F.floor(F.lit(0.30) * F.col("items"))))
    return recommend.weights(g.item, g.item_tag).agg(F.count("*").alias("tags"), F.count_if(ok).alias("kept"))


COSINE = "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6)"


@query(f"SELECT a.item_id, {COSINE} AS score FROM embedding a, embedding b WHERE b.item_id = 5 AND a.item_id <> 5 ORDER BY score DESC, a.item_id LIMIT 288")
def knn_single(g):
    return similar.nearest(g.embedding, g.embedding.where("item_id = 5").select(F.col("item_id").alias("q_id"), F.col("v").alias("q")), exclude_self=True)


@query(f"t AS (SELECT a.item_id, {COSINE} AS score FROM embedding a, embedding b WHERE b.item_id = 5 ORDER BY score DESC, a.item_id LIMIT 288) SELECT * FROM t WHERE score >= 0.25")
def knn_min_score(g):
    return similar.nearest(g.embedding, g.embedding.where("item_id = 5").select(F.col("item_id").alias("q_id"), F.col("v").alias("q")), min_score=0.25)


_SAME = "NOT EXISTS (SELECT 1 FROM grp_item x JOIN grp_item y USING (group_id) WHERE x.item_id = b.item_id AND y.item_id = a.item_id)"


@query(f"r AS (SELECT b.item_id AS seed, a.item_id, {COSINE} AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY {COSINE} DESC, a.item_id) AS rank FROM embedding a, embedding b WHERE a.item_id <> b.item_id AND {_SAME}) SELECT * FROM r WHERE rank <= 20")
def knn_batch(g):
    """The neighbours of every vector."""
    seeds = g.embedding.select(F.col("item_id").alias("seed"), F.col("v").alias("q"))
    return similar.nearest_to_each(g.embedding, seeds, g.membership)


@query(f"s AS (SELECT item_id, v FROM embedding ORDER BY md5(CAST(item_id AS VARCHAR)) LIMIT 48), p AS (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM s a JOIN s b ON md5(CAST(a.item_id AS VARCHAR)) < md5(CAST(b.item_id AS VARCHAR))) SELECT round(least(greatest(quantile_cont(c, 0.9), 0.0), 0.95), 6) AS baseline, (SELECT count(*) FROM s) AS sample FROM p")
def calibration_baseline(g):
    return similar.baseline(g.embedding)


@query("SELECT item_id, phash FROM phash")
def phash_bits(g):
    return g.phash


@query("SELECT a.item_id, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance FROM phash a, phash b WHERE b.item_id = 5 AND a.item_id <> 5 AND bit_count(xor(a.phash, b.phash)) <= 24 ORDER BY distance, a.item_id LIMIT 100")
def phash_hamming(g):
    at = g.phash.where("item_id = 5").first()["phash"]
    return similar.near_hashes(g.phash, at, exclude=5, threshold=24, limit=100)


# --- feed

_AGE = "greatest(epoch_us(TIMESTAMP '{}') - epoch_us({}), 0) / 86400000000.0"
_DECAY = "exp(-ln(2) * " + _AGE + " / {})"


@query(f"SELECT item_id, round({_DECAY.format(AS_OF, '"at"', 90.0)}, 9) AS weight FROM favourite")
def seed_recency_weight(g):
    return feed.recency_weights(g.favourite, AS_OF).select("item_id", F.round("weight", 9).alias("weight"))


_VIEWS = "SELECT item_id AS seed, 0.35 * " + _DECAY.format(AS_OF, '"at"', 30.0) + " * least(1.0, ln(1 + view_count) / ln(9)) AS weight FROM view_ WHERE item_id NOT IN (SELECT item_id FROM favourite) AND item_id NOT IN (SELECT item_id FROM dismissal) ORDER BY \"at\" DESC, item_id LIMIT 25"


@query(f"v AS ({_VIEWS}) SELECT seed, round(weight, 9) AS weight FROM v")
def view_seed_weight(g):
    return feed.view_seeds(g.view, g.favourite.unionByName(g.dismissal), AS_OF).select("seed", F.round("weight", 9).alias("weight"))


def _channels(g):
    """Tag neighbours of the newest favourites (positive) and dismissals (negative)."""
    plus = feed.recency_weights(g.favourite, AS_OF).orderBy(F.desc("at"), "item_id").limit(10).select(F.col("item_id").alias("seed"), "weight", F.lit(True).alias("positive"))
    minus = feed.negative_seeds(g.dismissal, AS_OF).orderBy(F.desc("weight"), "seed").limit(10).withColumn("positive", F.lit(False))
    seeds = plus.unionByName(minus)
    near = recommend.recommend(seeds.select(F.col("seed").alias("item_id")), g.item, g.item_tag, g.grp_item, limit=feed.PER_SEED, weight=g.weight, norm=g.norm)
    return seeds, near.select(F.col("item_id").alias("seed"), F.col("recommended_id").alias("item_id"), F.col("score").alias("similarity"), F.lit("tag").alias("channel")).join(seeds, "seed")


_FEED = f"""plus_seeds AS (SELECT item_id AS seed, {_DECAY.format(AS_OF, '"at"', 90.0)} AS weight, true AS positive FROM favourite ORDER BY "at" DESC, item_id LIMIT 10),
minus30 AS (SELECT item_id AS seed, {_DECAY.format(AS_OF, '"at"', 60.0)} AS weight, false AS positive FROM dismissal ORDER BY "at" DESC, item_id LIMIT 30),
minus_seeds AS (SELECT * FROM minus30 ORDER BY weight DESC, seed LIMIT 10), signed AS (SELECT * FROM plus_seeds UNION ALL SELECT * FROM minus_seeds),
{REC.replace(SEEDS, "SELECT seed FROM signed")},
each_ AS (SELECT s.seed, positive, recommended_id AS item_id, 0.3 * weight * least(greatest(score, 0), 1) / CASE WHEN recommended_id IN (SELECT item_id FROM embedding) AND s.seed IN (SELECT item_id FROM embedding) THEN 1.0 ELSE 0.3 END AS c FROM ranked r JOIN signed s ON s.seed = r.item_id WHERE rank <= 20),
numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id, positive ORDER BY c DESC) - 1 AS k FROM each_),
merged_feed AS (SELECT item_id, round(coalesce(sum(CASE WHEN positive THEN round(c, 12) * pow(0.8, k) END), 0) - 0.8 * coalesce(sum(CASE WHEN NOT positive THEN c END), 0), 9) AS score FROM numbered GROUP BY item_id HAVING score > 0)"""


@query(f"{_FEED} SELECT item_id, round(score, 6) AS score FROM merged_feed")
def feed_merge(g):
    return feed.merge(_channels(g)[1], g.embedding).withColumn("score", F.round("score", 6))


def _scores(g):
    """A score for each item with a view, to boost and fade."""
    return g.view.select("item_id", (1.0 / (1 + F.col("item_id") % 97)).alias("score"))


@query(f"SELECT v.item_id, round(1.0 / (1 + v.item_id % 97) * (1 + 0.15 * {_DECAY.format('1998-11-01 00:00:00', 'imported_at', 7.0)}), 9) AS score FROM view_ v JOIN item ON id = v.item_id")
def feed_freshness(g):
    return feed.freshen(_scores(g), g.item, "1998-11-01 00:00:00").select("item_id", F.round("score", 9).alias("score"))


@query(f"SELECT item_id, round(1.0 / (1 + item_id % 97) * (1 - (1 - 0.3) * {_DECAY.format(AS_OF, '"at"', 30.0)}), 9) AS score FROM view_")
def feed_viewed_penalty(g):
    return feed.fade_viewed(_scores(g), g.view, AS_OF).select("item_id", F.round("score", 9).alias("score"))


@query("m AS (SELECT item_id FROM favourite), gs AS (SELECT DISTINCT group_id FROM grp_item WHERE item_id IN (SELECT item_id FROM m)) SELECT item_id FROM favourite UNION SELECT item_id FROM dismissal UNION SELECT item_id FROM grp_item WHERE group_id IN (SELECT group_id FROM gs)")
def feed_exclusions(g):
    return feed.excluded(g.favourite, g.dismissal, g.favourite.select(F.col("item_id").alias("seed")), g.grp_item)


@query("s AS (SELECT item_id, 1.0 / (1 + item_id % 97) AS score FROM view_), j AS (SELECT s.*, CASE WHEN blurhash IS NULL THEN '#' || item_id ELSE blurhash || '|' || coalesce(CAST(width AS VARCHAR), '-') || '|' || coalesce(CAST(height AS VARCHAR), '-') END AS look FROM s JOIN item ON id = item_id), r AS (SELECT *, row_number() OVER (PARTITION BY look ORDER BY score DESC, item_id) AS place FROM j) SELECT item_id, round(score, 9) AS score FROM r WHERE place = 1")
def feed_dedupe_visual(g):
    return feed.visual_first(_scores(g), g.item).select("item_id", F.round("score", 9).alias("score"))


def neighbourhoods(g, seeds):
    """(seed, item_id, similarity, channel, weight, positive): the neighbours of the seeds (seed, weight, positive) in both channels."""
    near = recommend.recommend(seeds.select(F.col("seed").alias("item_id")), g.item, g.item_tag, g.grp_item, limit=feed.PER_SEED, weight=g.weight, norm=g.norm)
    by_tag = near.select(F.col("item_id").alias("seed"), F.col("recommended_id").alias("item_id"), F.col("score").alias("similarity"), F.lit("tag").alias("channel"))
    own = seeds.join(g.embedding, F.col("seed") == F.col("item_id")).select("seed", F.col("v").alias("q"))
    by_vector = similar.nearest_to_each(g.embedding, own, g.grp_item, limit=feed.PER_SEED)
    base = similar.baseline(g.embedding).select("baseline")
    by_vector = by_vector.crossJoin(F.broadcast(base)).withColumn("similarity", similar.calibrated(F.col("score"), F.col("baseline"))).where("similarity >= 0.25")  # base is one row
    return by_tag.unionByName(by_vector.select("seed", "item_id", "similarity", F.lit("embedding").alias("channel"))).join(seeds, "seed")


_SIGNED = f"""signed AS (SELECT * FROM (SELECT item_id AS seed, {_DECAY.format(AS_OF, '"at"', 90.0)} AS weight, true AS positive FROM favourite ORDER BY "at" DESC, item_id LIMIT 30)
    UNION ALL SELECT *, true FROM ({_VIEWS}) UNION ALL SELECT * FROM (SELECT item_id AS seed, {_DECAY.format(AS_OF, '"at"', 60.0)} AS weight, false AS positive FROM dismissal ORDER BY "at" DESC, item_id LIMIT 30))"""
_BASE = "s48 AS (SELECT item_id, v FROM embedding ORDER BY md5(CAST(item_id AS VARCHAR)) LIMIT 48), base AS (SELECT round(least(greatest(quantile_cont(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 0.9), 0.0), 0.95), 6) AS baseline FROM s48 a JOIN s48 b ON a.item_id < b.item_id)"
_CHANNELS = f"""{_SIGNED}, {REC.replace(SEEDS, "SELECT seed FROM signed")}, {_BASE},
near_v AS (SELECT b.item_id AS seed, a.item_id, {COSINE} AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY {COSINE} DESC, a.item_id) AS place FROM embedding a, embedding b WHERE b.item_id IN (SELECT seed FROM signed) AND a.item_id <> b.item_id AND {_SAME}),
met_by AS (SELECT item_id AS seed, recommended_id AS item_id, 0.3 AS share, score AS similarity FROM ranked WHERE rank <= 20
    UNION ALL SELECT seed, item_id, 0.7, least(greatest((score - baseline) / (1 - baseline), 0), 1) AS c FROM near_v, base WHERE place <= 20 AND c >= 0.25),
each_ AS (SELECT seed, positive, item_id, sum(share * weight * least(greatest(similarity, 0), 1) / CASE WHEN item_id IN (SELECT item_id FROM embedding) AND seed IN (SELECT item_id FROM embedding) THEN 1.0 ELSE 0.3 END) AS c FROM met_by JOIN signed USING (seed) GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id, positive ORDER BY c DESC) - 1 AS k FROM each_),
merged_both AS (SELECT item_id, round(coalesce(sum(CASE WHEN positive THEN round(c, 12) * pow(0.8, k) END), 0) - 0.8 * coalesce(sum(CASE WHEN NOT positive THEN c END), 0), 9) AS score FROM numbered GROUP BY item_id HAVING score > 0)
SELECT item_id, round(score, 6) AS score FROM merged_both"""


@query(_CHANNELS)
def feed_merge_channels(g):
    """Both channels of the newest favourites, views and dismissals, as many of each as a feed takes."""
    plus = feed.recency_weights(g.favourite, AS_OF).orderBy(F.desc("at"), "item_id").limit(feed.RECENT).select(F.col("item_id").alias("seed"), "weight")
    plus = plus.unionByName(feed.view_seeds(g.view, g.favourite.unionByName(g.dismissal), AS_OF)).withColumn("positive", F.lit(True))
    seeds = plus.unionByName(feed.negative_seeds(g.dismissal, AS_OF).withColumn("positive", F.lit(False)))
    return feed.merge(neighbourhoods(g, seeds), g.embedding).withColumn("score", F.round("score", 6))


def _claim(ranked: str) -> str:
    """SQL of the first-claim rule over rows (n, item_id) numbered from 1."""
    return f"""ranked0 AS ({ranked}), lists AS (SELECT item_id, list(DISTINCT group_id) AS gs FROM grp_item WHERE item_id IN (SELECT item_id FROM ranked0) GROUP BY item_id),
    rows_ AS MATERIALIZED (SELECT n, item_id, coalesce(gs, []) AS gs FROM ranked0 LEFT JOIN lists USING (item_id)),
    fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS item_id, CAST([] AS BIGINT[]) AS claimed, false AS kept
        UNION ALL SELECT r.n, r.item_id, CASE WHEN list_has_any(claimed, gs) THEN claimed ELSE list_concat(claimed, gs) END, NOT list_has_any(claimed, gs) FROM fold f JOIN rows_ r ON r.n = f.n + 1)
    SELECT item_id FROM fold WHERE kept"""


@query(_claim('SELECT row_number() OVER (ORDER BY "at" DESC, item_id) AS n, item_id FROM (SELECT * FROM dismissal ORDER BY "at" DESC, item_id LIMIT 120)'))
def feed_collapse(g):
    """Dismissals, as many as a feed reads, of which each group has one."""
    return feed.collapsed(g.dismissal, g.grp_item, set(), feed.NEGATIVES * feed.OVERFETCH).select("item_id")


@query(_claim("SELECT row_number() OVER (ORDER BY 1.0 / (1 + item_id % 97) DESC, item_id) AS n, item_id FROM dismissal"))
def feed_claim_groups(g):
    """The first-claim rule over scored items."""
    ranked = g.dismissal.select("item_id", (1.0 / (1 + F.col("item_id") % 97)).alias("score"))
    return feed.one_of_each_group(ranked, g.grp_item).select("item_id")


@query(None)
def feed_full(g):
    """Seeds, neighbourhoods of both channels, merge, exclusions, boosts and dedupe, to a feed of at most FEED_SIZE items."""
    favourites = feed.collapsed_all(g.favourite, g.grp_item)
    picked = feed.seeds_of(feed.recency_weights(favourites, AS_OF), 5688000)
    if not picked:
        return g.item.limit(0).select(F.col("id").alias("item_id"), F.lit(0.0).alias("score"))
    plus = g.spark.createDataFrame(picked, "seed long, weight double").withColumn("positive", F.lit(True))
    explicit = g.favourite.unionByName(g.dismissal)
    unmarked = held(g.view.join(explicit.select("item_id").distinct(), "item_id", "left_anti"), "unmarked")
    most = feed.VIEWS * feed.OVERFETCH
    viewed = feed.collapsed(unmarked, g.grp_item, feed.claimed_among(favourites, unmarked, g.grp_item, most), most)
    views = feed.view_seeds(viewed, explicit, AS_OF).withColumn("positive", F.lit(True))
    dismissed = feed.collapsed(g.dismissal, g.grp_item, set(), feed.NEGATIVES * feed.OVERFETCH)
    seeds = held(plus.unionByName(views).unionByName(feed.negative_seeds(dismissed, AS_OF).withColumn("positive", F.lit(False))).coalesce(1), "seeds")
    rows = held(feed.merge(neighbourhoods(g, seeds), g.embedding), "merged")
    # Only groups of candidates can exclude one; those are at most the seeds times their neighbours.
    met = g.grp_item.join(F.broadcast(rows.select("item_id")), "item_id", "left_semi").select("group_id")
    rows = rows.join(feed.excluded(g.favourite, g.dismissal, seeds, g.grp_item.join(met, "group_id", "left_semi")), "item_id", "left_anti")
    rows = held(feed.fade_viewed(feed.freshen(rows, g.item, AS_OF), g.view, AS_OF), "ranked")
    return feed.visual_first(feed.one_of_each_group(rows, g.grp_item), g.item).orderBy(F.desc("score"), "item_id").limit(feed.FEED_SIZE)


# --- text

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(f"SELECT id FROM note WHERE len(list_filter({_WORDS.format('content')}, lambda w: w = 'the')) > 0 AND len(list_filter({_WORDS.format('content')}, lambda w: w = 'with')) > 0")
def fts_and(g):
    return g.note.where(fulltext.matches(fulltext.words(F.col("content")), "the with", prefix=False)).select("id")


@query(f"SELECT id FROM note WHERE len(list_filter({_WORDS.format('content')}, lambda w: starts_with(w, 'thre'))) > 0")
def fts_prefix(g):
    return g.note.where(fulltext.matches(fulltext.words(F.col("content")), "thre")).select("id")


@query(f"SELECT id FROM note WHERE contains(' ' || array_to_string({_WORDS.format('content')}, ' ') || ' ', ' of the ')")
def fts_phrase(g):
    return g.note.where(fulltext.matches(fulltext.words(F.col("content")), '"of the"', prefix=False)).select("id")


@query(f"n AS (SELECT id, {_WORDS.format('content')} AS ws FROM note) SELECT id FROM n WHERE list_contains(ws, 'und') OR (list_contains(ws, 'para') AND NOT list_contains(ws, 'los'))")
def fts_or_not(g):
    return g.note.where(fulltext.matches(fulltext.words(F.col("content")), "und or para -los", prefix=False)).select("id")


@query(f"""b AS (SELECT 'note' AS result_type, n.id, n.content_hash, content AS shown FROM note n JOIN item ON item.id = n.item_id UNION ALL SELECT 'group', g.id, title_hash, title FROM grp g JOIN grp_item p ON g.id = group_id AND position = 0 WHERE title IS NOT NULL),
    x AS (SELECT result_type, id, shown FROM b UNION ALL SELECT result_type, id, translated_content FROM b JOIN translation USING (content_hash))
    SELECT DISTINCT result_type, id FROM x WHERE len(list_filter({_WORDS.format('shown')}, lambda w: starts_with(w, 'customer') OR starts_with(w, 'der'))) > 0""")
def fts_union_dedupe(g):
    own = g.note.join(g.item.select(F.col("id").alias("item_id")), "item_id", "left_semi").select(F.lit("note").alias("result_type"), "id", "content_hash", F.col("content").alias("shown"))
    first = g.grp_item.where("position = 0").select(F.col("group_id").alias("id"))
    titled = g.grp.where("title IS NOT NULL").join(first, "id", "left_semi").select(F.lit("group").alias("result_type"), "id", F.col("title_hash").alias("content_hash"), F.col("title").alias("shown"))
    both = own.unionByName(titled)
    every = both.unionByName(both.join(g.translation, "content_hash").select("result_type", "id", "content_hash", F.col("translated_content").alias("shown")))
    return every.where(fulltext.matches(fulltext.words(F.col("shown")), "customer or der")).select("result_type", "id").distinct()


def _ranked(terms: tuple[str, str], both: bool) -> str:
    """SQL of a ranked search for two beginnings of words, neither of which begins the other."""
    a, b = terms
    marked = f"(^|[^\\p{{L}}\\p{{N}}])((?i:{a}|{b}))"
    value = "CASE WHEN t <> t0 THEN CAST(0.1 AS DOUBLE) / (pos - pos0) END" if both else "CAST(0.1 AS DOUBLE)"
    cut = lambda i: f"array_to_string(pieces[greatest({i} - 12, 0) + 1:greatest({i} - 12, 0) + 24], ' ')"
    return f"""b AS (SELECT 'note' AS result_type, n.id, n.item_id, imported_at, n.content_hash, content AS shown FROM note n JOIN item ON item.id = n.item_id
        UNION ALL SELECT 'group', g.id, p.item_id, imported_at, title_hash, title FROM grp g JOIN grp_item p ON g.id = group_id AND position = 0 JOIN item ON item.id = p.item_id WHERE title IS NOT NULL),
    x AS (SELECT * FROM b UNION ALL SELECT result_type, id, item_id, imported_at, content_hash, translated_content FROM b JOIN translation USING (content_hash)),
    w AS MATERIALIZED (SELECT result_type, id, item_id, imported_at, shown, row_number() OVER () AS k, {_WORDS.format('shown')} AS ws FROM x),
    h AS (SELECT k, pos, CASE WHEN starts_with(word, '{a}') THEN 1 ELSE 2 END AS t FROM (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) WHERE starts_with(word, '{a}') OR starts_with(word, '{b}')),
    c AS (SELECT k, t, pos, lag(t) OVER (PARTITION BY k ORDER BY pos) AS t0, lag(pos) OVER (PARTITION BY k ORDER BY pos) AS pos0 FROM h),
    q AS (SELECT k, round(coalesce(sum({value} ORDER BY pos), 0), 6) AS rank FROM c GROUP BY k HAVING {'count(DISTINCT t) = 2' if both else 'true'}),
    o AS (SELECT *, row_number() OVER (PARTITION BY result_type, id ORDER BY rank DESC, item_id, shown) AS place FROM w JOIN q USING (k)),
    one AS (SELECT * FROM o WHERE place = 1),
    top AS (SELECT *, (SELECT count(*) FROM one) AS total, regexp_split_to_array(replace(replace(replace(shown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\s+') AS pieces FROM one ORDER BY rank DESC, imported_at DESC, result_type, id LIMIT 48),
    m AS (SELECT *, list_filter(range(0, len(pieces)), lambda i: regexp_matches(pieces[i + 1], '{marked}')) AS hits FROM top),
    f AS (SELECT *, coalesce(hits[1], 0) AS i1, list_filter(hits, lambda i: i > coalesce(hits[1], 0) + 12)[1] AS i2 FROM m)
    SELECT result_type, id, item_id, rank, total, regexp_replace({cut('i1')} || CASE WHEN i2 IS NULL THEN '' ELSE ' ... ' || {cut('i2')} END, '{marked}', '\\1<mark>\\2</mark>', 'g') AS headline FROM f"""


@query(_ranked(("the", "custom"), both=False))
def fts_ranked(g):
    return fulltext.search_notes(g.note, g.translation, g.grp, g.grp_item, g.item, "the or custom")


@query(_ranked(("the", "with"), both=True))
def fts_ranked_and(g):
    return fulltext.search_notes(g.note, g.translation, g.grp, g.grp_item, g.item, "the with")


@query(f"SELECT id, hash FROM item WHERE id IN (SELECT item_id FROM note WHERE list_contains({_WORDS.format('content')}, 'src3') OR list_contains({_WORDS.format('name')}, 'src3')) ORDER BY imported_at DESC, id DESC LIMIT 48")
def search_note_filter(g):
    found = search.search(g.item, g.tag, g.item_tag, parse_terms(""), note_ids=fulltext.items_with_note(g.note, "src3"))
    return search.newest(found).select("id", "hash")


# --- statistics and jobs


@query("SELECT DISTINCT content_hash, content FROM note WHERE trim(content) <> '' AND content_hash NOT IN (SELECT content_hash FROM translation)")
def untranslated_distinct(g):
    return stats.untranslated(g.note, g.translation)


@query("SELECT count(DISTINCT content_hash) AS texts, count(DISTINCT content_hash) FILTER (WHERE content_hash IN (SELECT content_hash FROM translation)) AS translated, count(DISTINCT content_hash) FILTER (WHERE content_hash NOT IN (SELECT content_hash FROM translation)) AS missing FROM note WHERE trim(content) <> ''")
def translation_coverage(g):
    return stats.coverage(g.note, g.translation)


_COST = f"u AS (SELECT DISTINCT content_hash, content FROM note WHERE trim(content) <> '' AND content_hash NOT IN (SELECT content_hash FROM translation)), t AS (SELECT count(*) AS texts, CAST(coalesce(sum(ceil((length(content) - w) / 4 + w / 2)), 0) AS BIGINT) AS t FROM (SELECT content, len(regexp_extract_all(content, '{stats.CJK}')) AS w FROM u)) SELECT texts, texts * 120 + t AS tokens_in, texts * 80 AS tokens_out, round((texts * 120 + t + texts * 80 * 4.0) / 1e6, 6) AS cost FROM t"


@query(_COST)
def cost_estimate(g):
    return stats.cost(stats.untranslated(g.note, g.translation))


_OK = "mime_type IN ('image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/avif', 'image/tiff')"
_HAS = "id IN (SELECT item_id FROM phash)"


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE {_OK}) AS supported, count(*) FILTER (WHERE {_OK} AND {_HAS}) AS hashed, count(*) FILTER (WHERE {_OK} AND NOT {_HAS}) AS pending, count(*) FILTER (WHERE NOT {_OK}) AS unsupported FROM item")
def status_counts(g):
    return stats.hash_status(g.item, g.phash)


@query(f"SELECT id, mime_type FROM item WHERE {_OK} AND id NOT IN (SELECT item_id FROM embedding) ORDER BY id LIMIT 100")
def work_queue_pending(g):
    return stats.pending(g.item, g.embedding)


@query("SELECT 'items' AS name, count(*) AS n FROM item UNION ALL SELECT 'tags', count(*) FROM tag UNION ALL SELECT 'groups', count(*) FROM grp UNION ALL SELECT 'tags ' || category, count(*) FROM tag GROUP BY category")
def home_stats(g):
    return stats.home(g.item, g.tag, g.grp)


@query(f"{COUNTED}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY post_count DESC, id) AS rank FROM counted WHERE category <> 'META') SELECT category, rank, id, name, post_count FROM r WHERE rank <= 20")
def popular_tags(g):
    return stats.popular(g.counted, g.item_tag)


@query("SELECT count(*) AS recent FROM item WHERE imported_at >= TIMESTAMP '1998-07-15 00:00:00' - INTERVAL 24 HOURS")
def recent_imports(g):
    return stats.recent(g.item, "1998-07-15 00:00:00")


@query("a AS (SELECT id, width FROM item WHERE id % 5 <> 0), b AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE width END AS width FROM item WHERE id % 3 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.width IS DISTINCT FROM b.width")
def sync_diff(g):
    old = g.item.where("id % 5 <> 0").select("id", "width")
    new = g.item.where("id % 3 <> 0").select("id", F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE width END").alias("width"))
    return ingest.diff(old, new, ["id"], ["width"])


@query("t AS (SELECT * FROM item_tag WHERE tag_id % 2 = 0), p AS (SELECT * FROM grp_item WHERE item_id % 4 = 0) SELECT 'tag' AS kind, id FROM tag WHERE id NOT IN (SELECT tag_id FROM t) UNION ALL SELECT 'group', id FROM grp WHERE id NOT IN (SELECT group_id FROM p)")
def orphan_cleanup(g):
    a = ingest.orphan_tags(g.tag, g.item_tag.where("tag_id % 2 = 0")).select(F.lit("tag").alias("kind"), "id")
    return a.unionByName(ingest.orphan_groups(g.grp, g.grp_item.where("item_id % 4 = 0")).select(F.lit("group").alias("kind"), "id"))


_URLS = "u AS (SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN 'https://www.pixiv.net/en/artworks/' || page_id WHEN 1 THEN 'https://x.com/someone/status/' || page_id WHEN 2 THEN 'https://www.deviantart.com/a-b/art/Red-Ring-' || page_id WHEN 3 THEN 'https://danbooru.donmai.us/posts/' || page_id WHEN 4 THEN 'https://gelbooru.com/index.php?page=post&s=view&id=' || page_id ELSE url END AS url FROM pages)"


def _urls(g):
    cases = "CASE page_id % 6 WHEN 0 THEN concat('https://www.pixiv.net/en/artworks/', page_id) WHEN 1 THEN concat('https://x.com/someone/status/', page_id) WHEN 2 THEN concat('https://www.deviantart.com/a-b/art/Red-Ring-', page_id) WHEN 3 THEN concat('https://danbooru.donmai.us/posts/', page_id) WHEN 4 THEN concat('https://gelbooru.com/index.php?page=post&s=view&id=', page_id) ELSE url END"
    return g.table("pages").select(F.col("page_id").alias("id"), F.expr(cases).alias("url"))


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{k}'" for k, p in urls.SOURCE_PATTERNS) + " END"
_WORK = "CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN regexp_extract(url, '{p}', 1)" for _, p in urls.SOURCE_PATTERNS) + " END"


@query(f"{_URLS} SELECT id, {_TYPE} AS source_type, {_WORK} AS source_id FROM u")
def url_source_parse(g):
    return _urls(g).select("id", urls.source_type(F.col("url")).alias("source_type"), urls.source_id(F.col("url")).alias("source_id"))


@query(f"{_URLS}, p AS (SELECT *, {_TYPE} AS k FROM u), s AS (SELECT id, CASE k WHEN 'PIXIV' THEN 'https://www.pixiv.net/artworks/' || ({_WORK}) WHEN 'TWITTER' THEN 'https://twitter.com/i/status/' || ({_WORK}) WHEN 'DEVIANTART' THEN 'https://www.deviantart.com/deviation/' || ({_WORK}) WHEN 'DANBOORU' THEN 'https://danbooru.donmai.us/posts/' || ({_WORK}) WHEN 'GELBOORU' THEN 'https://gelbooru.com/index.php?page=post&s=view&id=' || ({_WORK}) ELSE url END AS url, coalesce(k, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')) AS label FROM p) SELECT id, url, label FROM s")
def display_sources(g):
    return urls.display_sources(_urls(g).withColumn("place", F.lit(0))).select("id", "url", "label")


_TITLES = "t AS (SELECT id, CASE id % 7 WHEN 0 THEN name || ' ' || (id % 90 + 1) WHEN 1 THEN name || ' (' || (id % 90 + 1) || ')' WHEN 2 THEN name || ' - Part ' || (id % 90 + 1) WHEN 3 THEN name || ' 3/10' WHEN 4 THEN name || '_' || (id % 90 + 1) WHEN 5 THEN name || ' chapter ' || (id % 90 + 1) || ' [2]' ELSE '第' || (id % 90 + 1) || '話' END AS title FROM tag)"


def _titles(g):
    return g.tag.select("id", F.expr("CASE id % 7 WHEN 0 THEN concat(name, ' ', id % 90 + 1) WHEN 1 THEN concat(name, ' (', id % 90 + 1, ')') WHEN 2 THEN concat(name, ' - Part ', id % 90 + 1) WHEN 3 THEN concat(name, ' 3/10') WHEN 4 THEN concat(name, '_', id % 90 + 1) WHEN 5 THEN concat(name, ' chapter ', id % 90 + 1, ' [2]') ELSE concat('第', id % 90 + 1, '話') END").alias("title"))


def _stripped() -> str:
    out = "trim(title)"
    for p in titles.STRIP:
        out = f"regexp_replace({out}, '{p}', '')"
    return f"regexp_replace(trim({out}), '\\s+', ' ', 'g')"


_NUMBER = "coalesce(" + ", ".join(f"nullif(regexp_extract(trim(title), '{p}', 1), '')" for p in titles.NUMBER) + ", '0')"


@query(f"{_TITLES} SELECT id, {_stripped()} AS base, CAST({_NUMBER} AS BIGINT) AS number, lower({_stripped()}) AS key FROM t")
def title_normalise(g):
    base = titles.base_title(F.col("title"))
    return _titles(g).select("id", base.alias("base"), titles.title_number(F.col("title")).alias("number"), titles.title_key(base).alias("key"))


_RAW = "r AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Artist: ' || name WHEN 1 THEN 'char:' || name WHEN 2 THEN 'odd space:' || name WHEN 3 THEN name ELSE 'rating:safe' END AS raw FROM tag)"


@query(f"{_RAW}, c AS (SELECT id, raw, CASE lower(trim(split_part(raw, ':', 1))) WHEN 'artist' THEN 'ARTIST' WHEN 'char' THEN 'CHARACTER' WHEN 'rating' THEN 'META' ELSE 'GENERAL' END AS category FROM r) SELECT id, category, CASE WHEN category = 'GENERAL' THEN raw ELSE trim(regexp_replace(raw, '^[^:]*:', '')) END AS name FROM c")
def tag_namespace_map(g):
    raw = g.tag.select("id", F.expr("CASE id % 5 WHEN 0 THEN concat('Artist: ', name) WHEN 1 THEN concat('char:', name) WHEN 2 THEN concat('odd space:', name) WHEN 3 THEN name ELSE 'rating:safe' END").alias("raw"))
    return raw.select("id", tag_category(F.col("raw")).alias("category"), tag_name(F.col("raw")).alias("name"))


@query("t AS (SELECT item_id AS id, min(CASE WHEN category = 'ARTIST' THEN name END) AS artist, min(CASE WHEN category = 'CHARACTER' THEN name END) AS character FROM item_tag JOIN tag ON tag.id = tag_id GROUP BY item_id) SELECT item.id, concat_ws('_', artist, character, substr(hash, 1, 8)) AS name FROM item LEFT JOIN t ON t.id = item.id")
def download_names(g):
    return stats.download_names(g.item, g.tag, g.item_tag)


@query(f"p AS ({PAGE.format('true', 0)}) SELECT id, id IN (SELECT item_id FROM favourite) AS is_favourite FROM p")
def favourite_annotation(g):
    return stats.annotate(search.newest(g.item), g.favourite).select("id", "is_favourite")


@query("SELECT i.id, coalesce((SELECT count(*) FROM item_tag WHERE item_id = i.id), 0) AS tags, coalesce((SELECT count(*) FROM note WHERE item_id = i.id), 0) AS notes, coalesce((SELECT count(*) FROM grp_item WHERE item_id = i.id), 0) AS groups FROM item i")
def item_details(g):
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(c)
    return stats.details(g.item, g.tag, g.item_tag, g.note, g.translation, g.grp_item).select("id", size("tags"), size("notes"), size("groups"))


# --- events


@query("SELECT user_id, count(*) AS view_count, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def view_counter(g):
    return counters.view_counts(g.table("events")).select("user_id", "view_count", F.unix_micros(F.col("first_viewed_at").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_viewed_at").cast("timestamp")).alias("last_us"))


@query("w AS (SELECT event_type, epoch_us(ts) // 60000000 AS minute, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, minute, n, greatest(n - 1, 0) AS refused FROM w")
def request_windows(g):
    rows = counters.request_windows(g.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", most=1)
    return rows.select("event_type", F.floor(F.unix_micros("start") / 60_000_000).alias("minute"), "n", "refused")


@query("SELECT epoch_us(ts) // 300000000 AS bucket, count(*) AS n FROM events GROUP BY bucket")
def feed_buckets(g):
    return g.table("events").groupBy(counters.feed_bucket(F.col("ts")).alias("bucket")).agg(F.count("*").alias("n"))


@query("r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k = 1")
def upsert_latest(g):
    from ..sources.upsert import upsert

    events = g.table("events").select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("at"))
    return upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "at").select("user_id", "event_id")

# DuckDB numbers rows in 64 bits, Spark in 32.
for _name, _col in (("tree_balanced", "rank"), ("group_preview_10", "rank"), ("rec_batch", "rank"), ("knn_batch", "rank"), ("popular_tags", "rank"), ("reading_order", "page"), ("reading_page_clamped", "page")):
    ORACLES[_name] = f"SELECT * REPLACE (CAST({_col} AS INTEGER) AS {_col}) FROM ({ORACLES[_name]})"
