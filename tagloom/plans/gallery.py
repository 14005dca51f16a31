"""A tagged gallery as views over the driver tables, in Spark and as DuckDB CTEs with the same rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import median_bits
from ..operators.recommend import norms, weights
from ..operators.search import tag_counts
from ..sources.store import stored

#: The moment that ages are counted from; queries never read the clock.
AS_OF = "2024-02-01 00:00:00"
CATEGORIES = {"ECONOMY": "ARTIST", "LARGE": "CHARACTER", "MEDIUM": "COPYRIGHT", "PROMO": "META", "SMALL": "GENERAL", "STANDARD": "GENERAL"}


class Gallery:
    """item, tag, item_tag, grp, grp_item, note, translation, embedding, phash, favourite, dismissal and view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def item(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "sha2(CAST(o_orderkey AS STRING), 256) AS hash",
            "o_orderdate AS imported_at",
            "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(200 + (o_orderkey * 37) % 2600 AS INT) END AS width",
            "CASE WHEN o_orderkey % 17 <> 0 THEN CAST(200 + (o_orderkey * 53) % 2000 AS INT) END AS height",
            "CASE o_orderkey % 7 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/apng' WHEN 3 THEN 'image/jpeg' ELSE 'image/png' END AS mime_type",
            "CASE WHEN o_orderkey % 11 <> 0 THEN concat('b', CAST(o_orderkey % 499 AS STRING)) END AS blurhash",
        ).withColumn("orientation", F.expr("CASE WHEN width IS NULL OR height IS NULL THEN NULL WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END"))

    @cached_property
    def tag(self) -> DataFrame:
        category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), category[F.col("p_type")].alias("category"))

    @cached_property
    def edges(self) -> DataFrame:
        """item_tag with repeated rows: semi and anti joins need no distinct, which would be a shuffle."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("tag_id"))

    def stored(self, name: str, tables: tuple[str, ...], build) -> DataFrame:
        """A relation that a library holds as a table: derived once from the driver's tables, and read from then on."""
        return stored(self.spark, name, [f"{self.sf_dir}/{t}.parquet" for t in tables], build)

    @cached_property
    def item_tag(self) -> DataFrame:
        return self.stored("item_tag", ("lineitem",), lambda: self.edges.distinct().repartitionByRange("tag_id").sortWithinPartitions("tag_id", "item_id"))

    @cached_property
    def counted(self) -> DataFrame:
        """tag with its stored post_count."""
        return self.stored("counted", ("part", "lineitem"), lambda: tag_counts(self.tag, self.item_tag))

    @cached_property
    def weight(self) -> DataFrame:
        return self.stored("weight", ("orders", "lineitem"), lambda: weights(self.item, self.item_tag))

    @cached_property
    def norm(self) -> DataFrame:
        return self.stored("norm", ("orders", "lineitem"), lambda: norms(self.item, self.item_tag, self.weight))

    @cached_property
    def grp_item(self) -> DataFrame:
        return self.stored("grp_item", ("orders",), self._grp_item)

    @cached_property
    def membership(self) -> DataFrame:
        """(group_id, item_id) of grp_item as it is derived: without positions that is a scan, which few items needn't store."""
        return self._grp_item().select("group_id", "item_id")

    def _grp_item(self) -> DataFrame:
        orders = self.table("orders")
        place = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        by_customer = orders.select("o_custkey", "o_orderkey", (F.row_number().over(place) - 1).alias("position"))
        a = by_customer.select((F.col("o_custkey") * 10).alias("group_id"), F.col("o_orderkey").alias("item_id"), "position")
        b = by_customer.where("o_custkey % 3 = 0").select((F.col("o_custkey") * 10 + 9).alias("group_id"), F.col("o_orderkey").alias("item_id"), "position")
        by_priority = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")
        c = orders.select((F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("group_id"), F.col("o_orderkey").alias("item_id"), (F.row_number().over(by_priority) - 1).alias("position"))
        return a.unionByName(b).unionByName(c)

    @cached_property
    def grp(self) -> DataFrame:
        return self.stored("grp", ("orders", "customer"), self._grp)

    def _grp(self) -> DataFrame:
        orders, customer = self.table("orders"), self.table("customer")
        own = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().join(customer, "c_custkey")
        none = F.lit(None).cast("string")
        a = own.select((F.col("c_custkey") * 10).alias("id"), F.col("c_mktsegment").alias("source_type"), F.col("c_custkey").cast("string").alias("source_id"), none.alias("title"))
        b = own.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 10 + 9).alias("id"), F.lit("TITLE").alias("source_type"), F.lower("c_name").alias("source_id"), F.col("c_name").alias("title"))
        c = orders.select(F.col("o_custkey").alias("k"), F.substring("o_orderpriority", 1, 1).cast("long").alias("p")).distinct()
        c = c.select((F.col("k") * 10 + F.col("p")).alias("id"), F.lit("OTHER").alias("source_type"), F.concat_ws("-", F.col("k").cast("string"), F.col("p").cast("string")).alias("source_id"), none.alias("title"))
        groups = a.unionByName(b).unionByName(c).withColumn("title_hash", F.sha2("title", 256))
        return groups.join(member_stats(self.grp_item), F.col("id") == F.col("group_id"), "left").drop("group_id").fillna({"member_count": 0})

    @cached_property
    def note(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("item_id"), F.concat(F.lit("note "), F.col("source")).alias("name"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), "lang")

    @cached_property
    def translation(self) -> DataFrame:
        talk = self.table("conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min("text").alias("translated_content"))
        return self.note.where("lang <> 'en'").join(talk, "id").groupBy("content_hash").agg(F.min("translated_content").alias("translated_content"))

    @cached_property
    def embedding(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))

    @cached_property
    def phash(self) -> DataFrame:
        return self.stored("phash", ("embeddings",), lambda: self.embedding.select("item_id", median_bits(F.col("v")).alias("phash")))

    def signal(self, types: tuple[str, ...]) -> DataFrame:
        """(item_id, at, n): latest time and number of the events of the types, dealt over the items."""
        n = self.table("orders").agg(F.count("*").alias("items"))
        events = self.table("events").where(F.col("event_type").isin(*types)).crossJoin(F.broadcast(n))  # one row
        return events.groupBy((F.col("event_id") * 7919 % F.col("items")).alias("item_id")).agg(F.max("ts").alias("at"), F.count("*").alias("n"))

    @cached_property
    def favourite(self) -> DataFrame:
        return self.stored("favourite", ("orders", "events"), lambda: self.signal(("purchase",)).select("item_id", "at"))

    @cached_property
    def dismissal(self) -> DataFrame:
        return self.stored("dismissal", ("orders", "events"), lambda: self.signal(("error",)).select("item_id", "at").join(self.favourite.select("item_id"), "item_id", "left_anti"))

    @cached_property
    def view(self) -> DataFrame:
        return self.stored("view", ("orders", "events"), lambda: self.signal(("view", "click")).select("item_id", "at", F.col("n").alias("view_count")))

    @cached_property
    def job(self) -> DataFrame:
        """(item_id, thumbnail_status, ocr_status)."""
        return self.item.selectExpr(
            "id AS item_id",
            "CASE id % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'PROCESSING' WHEN 4 THEN 'UNSUPPORTED' ELSE 'COMPLETE' END AS thumbnail_status",
            "CASE id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PENDING' ELSE 'COMPLETE' END AS ocr_status",
        )

    @cached_property
    def vector_row(self) -> DataFrame:
        """(item_id, base_url, model, dimensions, resolution, status, v): the vectors as rows of two configs."""
        return self.embedding.selectExpr(
            "item_id", "'http://local' AS base_url", "CASE WHEN item_id % 5 = 0 THEN 'old' ELSE 'base' END AS model", "size(v) AS dimensions", "512 AS resolution",
            "CASE WHEN item_id % 6 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status", "v",
        )

    @cached_property
    def region(self) -> DataFrame:
        """Text boxes: one of some hundred images a document, partly outside of it."""
        return self.table("documents").selectExpr(
            "doc_id % 300 AS item_id", "doc_id AS reading_order", "CAST(doc_id * 7 % 131 - 20 AS DOUBLE) AS x", "CAST(doc_id * 11 % 101 - 10 AS DOUBLE) AS y",
            "CAST(doc_id % 40 AS DOUBLE) AS width", "CAST(doc_id % 30 AS DOUBLE) AS height", "100.0D AS image_width", "80.0D AS image_height",
            "CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE concat(' box ', doc_id, ' ') END AS ocr_text",
        )

    @cached_property
    def rec_cache(self) -> DataFrame:
        """(item_id, recommended_id, score, computed_at): two cached rows an item, of some days."""
        return self.item.selectExpr(
            "id AS item_id", "explode(array(1, 2)) AS k",
        ).selectExpr("item_id", "item_id + k AS recommended_id", "1.0D / k AS score", f"TIMESTAMP '{AS_OF}' - make_interval(0, 0, 0, 0, CAST(item_id % 40 + 3 * k AS INT)) AS computed_at")

    @cached_property
    def query_vector(self) -> DataFrame:
        """The cache of query vectors: the embeddings as answers to texts."""
        return self.embedding.selectExpr(
            "sha2(concat('query ', item_id), 256) AS query_hash", "'http://local' AS base_url", "CASE WHEN item_id % 5 = 0 THEN 'old' ELSE 'base' END AS model",
            "size(v) AS dimensions", "concat('query ', item_id) AS query", "v AS embedding", f"TIMESTAMP '{AS_OF}' - make_interval(0, 0, 0, CAST(item_id % 30 AS INT)) AS last_used_at",
        )


def member_stats(grp_item: DataFrame) -> DataFrame:
    """(group_id, member_count, member_hash): MD5 of the members' ids in numeric order, comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",")
    return grp_item.groupBy("group_id").agg(F.count("*").alias("member_count"), F.md5(ids).alias("member_hash"))


_CATEGORY = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items())

CTES = f"""
item0 AS (SELECT o_orderkey AS id, sha256(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderdate AS imported_at,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(200 + (o_orderkey * 37) % 2600 AS INTEGER) END AS width,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(200 + (o_orderkey * 53) % 2000 AS INTEGER) END AS height,
    CASE o_orderkey % 7 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/apng' WHEN 3 THEN 'image/jpeg' ELSE 'image/png' END AS mime_type,
    CASE WHEN o_orderkey % 11 <> 0 THEN 'b' || (o_orderkey % 499) END AS blurhash FROM orders),
item AS (SELECT *, CASE WHEN width IS NULL OR height IS NULL THEN NULL WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END AS orientation FROM item0),
tag AS (SELECT p_partkey AS id, p_name AS name, CASE p_type {_CATEGORY} END AS category FROM part),
item_tag AS (SELECT DISTINCT l_orderkey AS item_id, l_partkey AS tag_id FROM lineitem),
by_customer AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders),
grp_item AS (SELECT o_custkey * 10 AS group_id, o_orderkey AS item_id, position FROM by_customer
    UNION ALL SELECT o_custkey * 10 + 9, o_orderkey, position FROM by_customer WHERE o_custkey % 3 = 0
    UNION ALL SELECT o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT), o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 FROM orders),
member_stats AS (SELECT group_id, count(*) AS member_count, md5(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id)) AS member_hash FROM grp_item GROUP BY group_id),
own_customer AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)),
grp0 AS (SELECT c_custkey * 10 AS id, c_mktsegment AS source_type, CAST(c_custkey AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS title FROM own_customer
    UNION ALL SELECT c_custkey * 10 + 9, 'TITLE', lower(c_name), c_name FROM own_customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT DISTINCT o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT), 'OTHER', o_custkey || '-' || substr(o_orderpriority, 1, 1), NULL FROM orders),
grp AS (SELECT g.*, sha256(title) AS title_hash, coalesce(member_count, 0) AS member_count, member_hash FROM grp0 g LEFT JOIN member_stats ON g.id = group_id),
note AS (SELECT doc_id AS id, doc_id AS item_id, 'note ' || source AS name, text AS content, sha256(text) AS content_hash, lang FROM documents),
talk AS (SELECT conv_id AS id, min(text) AS translated_content FROM conversations GROUP BY conv_id),
translation AS (SELECT content_hash, min(translated_content) AS translated_content FROM note JOIN talk USING (id) WHERE lang <> 'en' GROUP BY content_hash),
embedding AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings),
phash AS (SELECT item_id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN v[i + 1] > list_median(v[2:64]) THEN (1::BIGINT << (63 - i)) ELSE 0::BIGINT END))::BIGINT AS phash FROM embedding),
signals AS (SELECT event_id * 7919 % (SELECT count(*) FROM orders) AS item_id, event_type, ts FROM events),
favourite AS (SELECT item_id, max(ts) AS "at" FROM signals WHERE event_type = 'purchase' GROUP BY item_id),
dismissal AS (SELECT item_id, max(ts) AS "at" FROM signals WHERE event_type = 'error' AND item_id NOT IN (SELECT item_id FROM favourite) GROUP BY item_id),
view_ AS (SELECT item_id, max(ts) AS "at", count(*) AS view_count FROM signals WHERE event_type IN ('view', 'click') GROUP BY item_id),
job AS (SELECT id AS item_id, CASE id % 9 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'PROCESSING' WHEN 4 THEN 'UNSUPPORTED' ELSE 'COMPLETE' END AS thumbnail_status,
    CASE id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'PENDING' ELSE 'COMPLETE' END AS ocr_status FROM item),
vector_row AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'old' ELSE 'base' END AS model, CASE WHEN item_id % 6 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status, v FROM embedding),
region AS (SELECT doc_id % 300 AS item_id, doc_id AS reading_order, CAST(doc_id * 7 % 131 - 20 AS DOUBLE) AS x, CAST(doc_id * 11 % 101 - 10 AS DOUBLE) AS y, CAST(doc_id % 40 AS DOUBLE) AS width, CAST(doc_id % 30 AS DOUBLE) AS height,
    CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE ' box ' || doc_id || ' ' END AS ocr_text FROM documents),
rec_cache AS (SELECT id AS item_id, id + k AS recommended_id, CAST(1 AS DOUBLE) / k AS score, TIMESTAMP '{AS_OF}' - to_hours(CAST(id % 40 + 3 * k AS INTEGER)) AS computed_at FROM item, (VALUES (1), (2)) AS t(k)),
query_vector AS (SELECT sha256('query ' || item_id) AS query_hash, CASE WHEN item_id % 5 = 0 THEN 'old' ELSE 'base' END AS model, TIMESTAMP '{AS_OF}' - to_days(CAST(item_id % 30 AS INTEGER)) AS last_used_at, item_id FROM embedding)"""


def sql(body: str) -> str:
    """DuckDB SQL over the gallery: further CTEs may come first, as 'x AS (...), y AS (...) SELECT ...'."""
    body = body.strip()
    return f"WITH RECURSIVE {CTES.strip()}{' ' if body[:6].upper() == 'SELECT' else ', '}{body}"
