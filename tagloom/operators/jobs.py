"""Background jobs over items: breakdowns by status, and the items that each job takes next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import ids_named, items_with
from .stats import HASHED_MIMES

# States of a thumbnail, and the default and largest batch of text recognition.
THUMBNAIL_STATES = ("PENDING", "PROCESSING", "COMPLETE", "FAILED", "UNSUPPORTED")
OCR_BATCH, MOST_OCR_BATCH = 500, 10_000


@dataclass(frozen=True)
class VectorConfig:
    """What the vectors of one search have in common."""

    base_url: str
    model: str
    dimensions: int
    resolution: int

    def matches(self) -> Column:
        own = {"base_url": self.base_url, "model": self.model, "dimensions": self.dimensions, "resolution": self.resolution}
        cond = F.lit(True)
        for name, value in own.items():
            cond &= F.col(name) == value
        return cond


def is_image() -> Column:
    return F.col("mime_type").startswith("image/")


def thumbnail_status(job: DataFrame) -> DataFrame:
    """One row (total, and a count of each state) of rows with thumbnail_status, which counts nowhere else if null."""
    return job.agg(F.count("*").alias("total"), *[F.count_if(F.col("thumbnail_status") == s).alias(s.lower()) for s in THUMBNAIL_STATES])


def vector_status(item: DataFrame, vectors: DataFrame, config: VectorConfig) -> DataFrame:
    """(total, supported, embedded, failed, pending, unsupported) for one config; vectors (item_id, config, status)."""
    own = vectors.where(config.matches()).select(F.col("item_id").alias("id"), "status")
    ok = F.col("mime_type").isin(*HASHED_MIMES)
    per = item.select("id", "mime_type").join(own, "id", "left").groupBy("id").agg(
        F.max(ok).alias("ok"), *[F.count_if(ok & (F.col("status") == s)).alias(s) for s in ("COMPLETE", "FAILED")]
    )
    sums = per.agg(F.count("*").alias("total"), F.count_if("ok").alias("supported"), *[F.coalesce(F.sum(s), F.lit(0)).alias(n) for s, n in (("COMPLETE", "embedded"), ("FAILED", "failed"))])
    pending = F.greatest(F.col("supported") - F.col("embedded") - F.col("failed"), F.lit(0))
    return sums.select("total", "supported", "embedded", "failed", pending.alias("pending"), (F.col("total") - F.col("supported")).alias("unsupported"))


def ocr_status(item: DataFrame, job: DataFrame, region: DataFrame) -> DataFrame:
    """(pending, complete, failed) images, and the text regions of all items."""
    images = item.where(is_image()).select("id").join(job.select(F.col("item_id").alias("id"), "ocr_status"), "id")
    counts = images.agg(*[F.count_if(F.col("ocr_status") == s).alias(s.lower()) for s in ("PENDING", "COMPLETE", "FAILED")])
    return counts.crossJoin(region.agg(F.count("*").alias("regions")))  # one row each


def thumbnail_queue(item: DataFrame, job: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, mime_type): pending images and videos by id."""
    pending = job.where(F.col("thumbnail_status") == "PENDING").select(F.col("item_id").alias("id"))
    rows = item.where(is_image() | F.col("mime_type").startswith("video/")).join(pending, "id", "left_semi").select("id", "mime_type").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def vector_queue(item: DataFrame, vectors: DataFrame, config: VectorConfig, limit: int, *, retry_failed: bool = False, after: int | None = None) -> DataFrame:
    """(id, mime_type) by id: supported items without a row of the config, or with retry_failed those that failed under it.

    after: the last id of the batch before.
    """
    own = vectors.where(config.matches())
    rows = item.where(F.col("mime_type").isin(*HASHED_MIMES))
    rows = rows if after is None else rows.where(F.col("id") > after)
    had = (own.where(F.col("status") == "FAILED") if retry_failed else own).select(F.col("item_id").alias("id"))
    return rows.join(had, "id", "left_semi" if retry_failed else "left_anti").orderBy("id").limit(limit).select("id", "mime_type")


def ocr_queue(item: DataFrame, job: DataFrame, tag: DataFrame, item_tag: DataFrame, *, tags: tuple[str, ...] = (), retry_failed: bool = False, limit: int = OCR_BATCH) -> DataFrame:
    """(id, mime_type): images whose text is pending, or failed too with retry_failed, newest first, then by id.

    tags: names that an item has to carry, all of them, in lower case; a name matches as it is written, blanks ask for nothing.
    """
    limit = min(max(limit, 1), MOST_OCR_BATCH)
    due = job.where(F.col("ocr_status").isin("PENDING", *(["FAILED"] if retry_failed else []))).select(F.col("item_id").alias("id"))
    rows = item.where(is_image()).join(due, "id", "left_semi")
    for name in filter(None, (t.strip().lower() for t in tags)):
        rows = rows.join(items_with(item_tag, ids_named(tag.where(F.col("name") == name), [name])), "id", "left_semi")
    return rows.orderBy(F.desc("imported_at"), F.desc("id")).limit(limit).select("id", "mime_type")
