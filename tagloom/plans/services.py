"""Queries of what runs beside searches: jobs, caches, sinks, reads in steps and ingest; they register in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tags import search_meta
from ..operators import facets, feed, groups, ingest, jobs, recommend, similar, stats, vector_cache
from ..sources import metadata, scan, upsert
from . import catalogue
from .catalogue import COSINE, COUNTED, VALID, query
from .gallery import AS_OF

_OK = "mime_type IN ('image/jpeg', 'image/png', 'image/gif', 'image/webp', 'image/avif', 'image/tiff')"


def _config(g) -> jobs.VectorConfig:
    """The config of the newer model; the vectors of the gallery are of one length."""
    return jobs.VectorConfig("http://local", "base", len(g.embedding.first()["v"]), 512)


# --- jobs


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE thumbnail_status = '{s}') AS {s.lower()}" for s in jobs.THUMBNAIL_STATES) + " FROM job")
def thumbnail_status(g):
    return jobs.thumbnail_status(g.job)


@query(f"e AS (SELECT status FROM vector_row JOIN item ON id = item_id WHERE model = 'base' AND {_OK}), c AS (SELECT (SELECT count(*) FROM item) AS total, (SELECT count(*) FROM item WHERE {_OK}) AS supported, (SELECT count(*) FROM e WHERE status = 'COMPLETE') AS embedded, (SELECT count(*) FROM e WHERE status = 'FAILED') AS failed) SELECT *, greatest(supported - embedded - failed, 0) AS pending, total - supported AS unsupported FROM c")
def vector_status(g):
    return jobs.vector_status(g.item, g.vector_row, _config(g))


@query("i AS (SELECT ocr_status FROM item JOIN job ON id = item_id WHERE mime_type LIKE 'image/%') SELECT count(*) FILTER (WHERE ocr_status = 'PENDING') AS pending, count(*) FILTER (WHERE ocr_status = 'COMPLETE') AS complete, count(*) FILTER (WHERE ocr_status = 'FAILED') AS failed, (SELECT count(*) FROM region) AS regions FROM i")
def ocr_status(g):
    return jobs.ocr_status(g.item, g.job, g.region)


@query("SELECT id, mime_type FROM item WHERE (mime_type LIKE 'image/%' OR mime_type LIKE 'video/%') AND id IN (SELECT item_id FROM job WHERE thumbnail_status = 'PENDING')")
def thumbnail_queue(g):
    return jobs.thumbnail_queue(g.item, g.job)


@query(f"SELECT id, mime_type FROM item WHERE {_OK} AND id > 100 AND id NOT IN (SELECT item_id FROM vector_row WHERE model = 'base') ORDER BY id LIMIT 50")
def vector_queue_after(g):
    return jobs.vector_queue(g.item, g.vector_row, _config(g), 50, after=100)


@query(f"SELECT id, mime_type FROM item WHERE {_OK} AND id IN (SELECT item_id FROM vector_row WHERE model = 'base' AND status = 'FAILED') ORDER BY id LIMIT 100")
def vector_queue_retry(g):
    return jobs.vector_queue(g.item, g.vector_row, _config(g), 100, retry_failed=True)


_CARRIES = "id IN (SELECT item_id FROM item_tag JOIN tag ON tag.id = tag_id WHERE tag.name = 'red plate')"


@query(f"SELECT id, mime_type FROM item WHERE mime_type LIKE 'image/%' AND {_CARRIES} AND id IN (SELECT item_id FROM job WHERE ocr_status IN ('PENDING', 'FAILED')) ORDER BY imported_at DESC, id DESC LIMIT 500")
def ocr_queue_tagged(g):
    return jobs.ocr_queue(g.item, g.job, g.tag, g.item_tag, tags=(" Red plate ", " "), retry_failed=True)


@query("SELECT id, mime_type FROM item WHERE mime_type LIKE 'image/%' AND id IN (SELECT item_id FROM job WHERE ocr_status = 'PENDING') ORDER BY imported_at DESC, id DESC LIMIT 500")
def ocr_queue_pending(g):
    return jobs.ocr_queue(g.item, g.job, g.tag, g.item_tag)


@query("""c AS (SELECT item_id, reading_order, greatest(x, 0) AS x0, greatest(y, 0) AS y0, least(x + width, 100) AS x1, least(y + height, 80) AS y1, trim(ocr_text) AS t FROM region)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY reading_order) - 1 AS INTEGER) AS reading_order, round(x0 / 100, 6) AS x, round(y0 / 80, 6) AS y, round((x1 - x0) / 100, 6) AS width, round((y1 - y0) / 80, 6) AS height, t AS ocr_text FROM c WHERE x1 > x0 AND y1 > y0 AND t <> ''""")
def ocr_boxes(g):
    return stats.normalised_boxes(g.region)


# --- groups, vectors and facets


@query(f"{COUNTED}, a AS (SELECT DISTINCT group_id, id, name, post_count FROM grp_item JOIN item_tag USING (item_id) JOIN counted ON id = tag_id WHERE category = 'ARTIST'), t AS (SELECT *, 'ARTIST' AS category, row_number() OVER (PARTITION BY group_id ORDER BY post_count DESC, id) AS place FROM a), v AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY place) AS k FROM t WHERE place <= 10 AND {VALID}) SELECT group_id, string_agg(name, ', ' ORDER BY k) AS creators FROM v WHERE k <= 5 GROUP BY group_id")
def group_page_creators(g):
    return groups.page_creators(g.grp_item, g.counted, g.item_tag)


@query(f"t AS (SELECT a.item_id, {COSINE} AS score FROM vector_row a, embedding b WHERE a.model = 'base' AND a.status = 'COMPLETE' AND b.item_id = 5 AND a.item_id <> 5 ORDER BY score DESC, a.item_id LIMIT 1000), p AS (SELECT * FROM t WHERE score >= 0.1) SELECT item_id, score, (SELECT count(*) FROM p) AS total FROM p ORDER BY score DESC, item_id LIMIT 20 OFFSET 20")
def semantic_page(g):
    asked = g.embedding.where("item_id = 5").select(F.col("item_id").alias("q_id"), F.col("v").alias("q"))
    return similar.result_page(g.vector_row, _config(g), asked, skip=20, limit=20, min_score=0.1, exclude_self=True)


_SAMPLED = "s AS (SELECT item_id, v FROM vector_row WHERE model = 'base' AND status = 'COMPLETE' ORDER BY md5(CAST(item_id AS VARCHAR)) LIMIT 48), p AS (SELECT list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM s a JOIN s b ON a.item_id < b.item_id)"


@query(f"{_SAMPLED} SELECT 'base' AS model, CAST(7 AS BIGINT) AS generation, round(least(greatest(quantile_cont(c, 0.9), 0.0), 0.95), 6) AS baseline, (SELECT count(*) FROM s) AS sample FROM p UNION ALL SELECT 'old', 5, 0.5, 48")
def calibration_setting(g):
    """A stale row of the config gives way to a new estimate; the row of another model stays."""
    config = _config(g)
    old = g.spark.createDataFrame([("http://local", m, config.dimensions, 512, 5, b, 48) for m, b in (("base", 0.9), ("old", 0.5))], "base_url string, model string, dimensions int, resolution int, generation long, baseline double, sample long")
    new = similar.remember_baseline(old, similar.baseline(similar.complete(g.vector_row, config)), config, 7)
    return new.select("model", "generation", "baseline", "sample")


@query(f"m AS ({catalogue._META_ROWS}) SELECT name, count, remaining FROM m WHERE name ILIKE '%full hd%' OR description ILIKE '%full hd%' OR name ILIKE '%WIDE%' OR description ILIKE '%WIDE%'")
def meta_search(g):
    found = {*search_meta("full hd"), *search_meta("WIDE")}
    return facets.meta_counts(g.item, g.favourite).where(F.col("name").isin(*found)).select("name", "count", "remaining")


# --- caches


@query(f"SELECT item_id, recommended_id, score FROM rec_cache WHERE item_id IN (SELECT item_id FROM rec_cache GROUP BY item_id HAVING max(computed_at) > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS)")
def rec_cache_fresh(g):
    return recommend.fresh(g.rec_cache, AS_OF).select("item_id", "recommended_id", "score")


@query("SELECT item_id, recommended_id, score FROM rec_cache WHERE item_id NOT IN (SELECT item_id FROM favourite) AND recommended_id NOT IN (SELECT item_id FROM favourite)")
def rec_cache_invalidated(g):
    return recommend.invalidate(g.rec_cache, g.favourite.select("item_id")).select("item_id", "recommended_id", "score")


@query(f"SELECT query_hash, model, epoch_us(CASE WHEN model = 'base' AND query_hash = sha256('query 8') THEN TIMESTAMP '2024-03-01 00:00:00' ELSE last_used_at END) AS used_us FROM query_vector")
def query_vector_touched(g):
    used = vector_cache.lookup(g.query_vector, vector_cache.text_key("  query  8 "), "http://local", "base", _config(g).dimensions)
    rows = vector_cache.touched(g.query_vector, used, "2024-03-01 00:00:00")
    return rows.select("query_hash", "model", F.unix_micros("last_used_at").alias("used_us"))


@query("n AS (SELECT query_hash, model, TIMESTAMP '2024-03-01 00:00:00' AS last_used_at FROM query_vector WHERE item_id % 3 = 0 AND item_id % 2 = 1) SELECT query_hash, model, epoch_us(coalesce(n.last_used_at, q.last_used_at)) AS used_us FROM query_vector q LEFT JOIN n USING (query_hash, model)")
def query_vector_remembered(g):
    """New answers to a third of the queries; half of them are of a wrong length and are refused."""
    n = F.regexp_extract("query", r"(\d+)", 1).cast("long")
    given = g.query_vector.where(n % 3 == 0).withColumn("embedding", F.when(n % 2 == 1, F.col("embedding")).otherwise(F.array(F.lit(1.0))))
    rows = vector_cache.remember(g.query_vector, given.withColumn("last_used_at", F.lit("2024-03-01 00:00:00").cast("timestamp")))
    return rows.select("query_hash", "model", F.unix_micros("last_used_at").alias("used_us"))


# --- sinks and reads in steps

_OLD = "old AS (SELECT id, width FROM item WHERE id % 3 = 0), new AS (SELECT id, CASE WHEN id % 8 <> 0 THEN coalesce(width, 0) + 1 END AS width FROM item WHERE id % 2 = 0)"


def _versions(g):
    new = g.item.where("id % 2 = 0").select("id", F.expr("CASE WHEN id % 8 <> 0 THEN coalesce(width, 0) + 1 END").alias("width"))
    return g.item.where("id % 3 = 0").select("id", "width"), new


@query(f"{_OLD} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def sink_insert_ignore(g):
    return upsert.insert_ignore(*_versions(g), ["id"])


@query(f"{_OLD} SELECT coalesce(o.id, n.id) AS id, coalesce(n.width, o.width) AS width FROM old o FULL JOIN new n ON o.id = n.id")
def sink_upsert_changed(g):
    return upsert.upsert_if_changed(*_versions(g), "id", "width")


@query(f"{_OLD} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def sink_replace(g):
    return upsert.replace_keys(*_versions(g), ["id"])


@query("SELECT id, hash FROM item WHERE id > 500 ORDER BY id LIMIT 5000")
def keyset_page(g):
    return scan.after(g.item, "id", 500).select("id", "hash")


_ASKED = [41, 7, 99999999, 7, 300, 5]


@query("a AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(_ASKED)) + ") AS t(ord, id)) SELECT item.id, hash, CAST(ord AS BIGINT) AS ord FROM a JOIN item ON a.id = item.id")
def rows_in_order(g):
    return scan.in_order(g.item.select("id", "hash"), "id", _ASKED)


# --- ingest


def _metadata(g):
    """Upstream objects as JSON text, one an item."""
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    i = F.col("id")
    raws = F.array(name("creator:Maker ", i % 100), name("Plain ", i % 7), name("PLAIN ", i % 7), F.lit("system:inbox"), F.lit("  "), name("series:S", i % 9))
    services = F.when(i % 4 != 0, F.create_map(F.lit("b"), F.struct((1_600_000_000 + i).alias("time_imported"))))
    parts = F.struct(
        i.alias("file_id"), "hash", F.col("mime_type").alias("mime"), "width", "height", F.create_map(F.lit("own"), F.struct(F.create_map(F.lit("0"), raws).alias("display_tags"))).alias("tags"),
        F.struct(services.alias("current")).alias("file_services"), F.create_map(F.lit("translation"), name("text of ", i)).alias("notes"),
        F.array(name("https://www.pixiv.net/en/artworks/", i), name("https://example.com/", i)).alias("known_urls"),
    )
    return metadata.parse_metadata(g.item.select(F.to_json(parts).alias("value")))


@query("SELECT id AS file_id, hash, mime_type, width, height, orientation, CASE WHEN id % 4 <> 0 THEN (1600000000 + id) * 1000000 ELSE epoch_us(TIMESTAMP '2024-02-01 00:00:00') END AS imported_us FROM item")
def metadata_files(g):
    return ingest.files(_metadata(g), AS_OF).select("file_id", "hash", "mime_type", "width", "height", "orientation", F.unix_micros("imported_at").alias("imported_us"))


@query("SELECT id AS file_id, 'Maker ' || id % 100 AS name, 'ARTIST' AS category FROM item UNION ALL SELECT id, 'PLAIN ' || id % 7, 'GENERAL' FROM item UNION ALL SELECT id, 'S' || id % 9, 'COPYRIGHT' FROM item")
def metadata_tags(g):
    return ingest.tags(_metadata(g))


@query("SELECT id AS file_id, 'translation' AS name, 'text of ' || id AS content, sha256('text of ' || id) AS content_hash FROM item")
def metadata_notes(g):
    return ingest.notes(_metadata(g))


@query("SELECT id AS file_id, 'PIXIV' AS source_type, CAST(id AS VARCHAR) AS source_id, CAST(0 AS BIGINT) AS position FROM item")
def metadata_groups(g):
    return ingest.url_groups(_metadata(g))
