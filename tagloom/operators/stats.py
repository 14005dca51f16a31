"""Statistics, work queues, translations, cost estimates and item details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import valid_creator
from .search import tag_counts

# Types with a perceptual hash or a vector, and the tokens and prices of a translation.
HASHED_MIMES = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/avif", "image/tiff")
PROMPT_TOKENS, OUTPUT_TOKENS, PRICE_IN, PRICE_OUT = 120, 80, 1.00, 4.00
POPULAR = 20
CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"


def home(item: DataFrame, tag: DataFrame, grp: DataFrame) -> DataFrame:
    """(name, n): items, tags, groups, and tags of each category."""
    rows = [x.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, x in (("items", item), ("tags", tag), ("groups", grp))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(tag.groupBy(F.concat(F.lit("tags "), F.col("category")).alias("name")).agg(F.count("*").alias("n")))


def popular(tag: DataFrame, item_tag: DataFrame, categories: tuple[str, ...] = ("ARTIST", "CHARACTER", "COPYRIGHT", "GENERAL"), most: int = POPULAR) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("post_count"), "id"))
    rows = tag_counts(tag, item_tag).where(F.col("category").isin(*categories)).withColumn("rank", rank)
    return rows.where(F.col("rank") <= most).select("category", "rank", "id", "name", "post_count")


def recent(item: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return item.where(F.col("imported_at") >= F.expr(f"timestamp '{as_of}' - interval {hours} hours")).agg(F.count("*").alias("recent"))


def hash_status(item: DataFrame, phash: DataFrame) -> DataFrame:
    """(total, supported, hashed, pending, unsupported) in one pass."""
    has = phash.select(F.col("item_id").alias("id"), F.lit(True).alias("has")).dropDuplicates(["id"])
    ok = F.col("mime_type").isin(*HASHED_MIMES)
    done = F.coalesce("has", F.lit(False))
    return item.join(has, "id", "left").agg(F.count("*").alias("total"), F.count_if(ok).alias("supported"), F.count_if(ok & done).alias("hashed"), F.count_if(ok & ~done).alias("pending"), F.count_if(~ok).alias("unsupported"))


def pending(item: DataFrame, done: DataFrame, limit: int = 100) -> DataFrame:
    """The first items, by id, that can have a hash or vector and have none."""
    return item.where(F.col("mime_type").isin(*HASHED_MIMES)).join(done.select(F.col("item_id").alias("id")), "id", "left_anti").orderBy("id").limit(limit).select("id", "mime_type")


def untranslated(note: DataFrame, translation: DataFrame) -> DataFrame:
    """(content_hash, content): distinct texts that aren't blank and have no translation."""
    return note.where(F.trim("content") != "").select("content_hash", "content").distinct().join(translation, "content_hash", "left_anti")


def coverage(note: DataFrame, translation: DataFrame) -> DataFrame:
    """(texts, translated, missing) of distinct hashes."""
    has = translation.select("content_hash", F.lit(True).alias("has")).dropDuplicates(["content_hash"])
    rows = note.where(F.trim("content") != "").join(has, "content_hash", "left")
    own = lambda cond: F.count_distinct(F.when(cond, F.col("content_hash")))
    return rows.agg(F.count_distinct("content_hash").alias("texts"), own(F.col("has")).alias("translated"), own(F.col("has").isNull()).alias("missing"))


def token_estimate(text: Column) -> Column:
    """A quarter token a character, half for Chinese, Japanese and Korean, rounded up."""
    wide = F.regexp_count(text, F.lit(CJK))
    return F.ceil((F.length(text) - wide) / 4 + wide / 2)


def cost(texts: DataFrame, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> DataFrame:
    """(texts, tokens_in, tokens_out, cost) of translating the column content."""
    sums = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).cast("long").alias("t"))
    rows = sums.select("texts", (F.col("texts") * PROMPT_TOKENS + F.col("t")).alias("tokens_in"), (F.col("texts") * OUTPUT_TOKENS).alias("tokens_out"))
    return rows.withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 6))


def download_names(item: DataFrame, tag: DataFrame, item_tag: DataFrame) -> DataFrame:
    """(id, name): first artist that isn't a number, first character, and eight characters of the hash."""
    rows = item_tag.join(tag.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id")
    artist = F.min(F.when((F.col("category") == "ARTIST") & valid_creator(F.col("name")), F.col("name")))
    character = F.min(F.when(F.col("category") == "CHARACTER", F.col("name")))
    names = rows.groupBy(F.col("item_id").alias("id")).agg(artist.alias("artist"), character.alias("character"))
    return item.join(names, "id", "left").select("id", F.concat_ws("_", "artist", "character", F.substring("hash", 1, 8)).alias("name"))


def details(item: DataFrame, tag: DataFrame, item_tag: DataFrame, note: DataFrame, translation: DataFrame, grp_item: DataFrame) -> DataFrame:
    """Each item with its tags, notes (translation, else text's hash) and groups, nested and in order."""
    t = item_tag.join(tag.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id").groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("category", "name", "tag_id"))).alias("tags"))
    n = note.join(translation, "content_hash", "left").groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("name"), "content_hash", "translated_content"))).alias("notes"))
    g = grp_item.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("group_id", "position"))).alias("groups"))
    return item.join(t, "id", "left").join(n, "id", "left").join(g, "id", "left")


def annotate(page: DataFrame, favourite: DataFrame) -> DataFrame:
    """page with is_favourite; all rows stay."""
    marks = favourite.select(F.col("item_id").alias("f_id"), F.lit(True).alias("f")).dropDuplicates(["f_id"])
    return page.join(marks, F.col("id") == F.col("f_id"), "left").withColumn("is_favourite", F.coalesce("f", F.lit(False))).drop("f_id", "f")


def normalised_boxes(boxes: DataFrame) -> DataFrame:
    """Text boxes (item_id, reading_order, x, y, width, height, image_width, image_height, ocr_text) clamped to the image, as
    shares of it, without empty ones, numbered anew."""
    x0, y0 = F.greatest("x", F.lit(0.0)), F.greatest("y", F.lit(0.0))
    x1, y1 = F.least(F.col("x") + F.col("width"), F.col("image_width")), F.least(F.col("y") + F.col("height"), F.col("image_height"))
    rows = boxes.withColumn("w", x1 - x0).withColumn("h", y1 - y0).where("w > 0 AND h > 0 AND trim(ocr_text) <> ''")
    order = Window.partitionBy("item_id").orderBy("reading_order", "x", "y")
    share = lambda c, of: F.round(c / F.col(of), 6)
    return rows.select("item_id", (F.row_number().over(order) - 1).alias("reading_order"), share(x0, "image_width").alias("x"), share(y0, "image_height").alias("y"), share(F.col("w"), "image_width").alias("width"), share(F.col("h"), "image_height").alias("height"), F.trim("ocr_text").alias("ocr_text"))
