"""A table of query vectors: keys of texts and images, lookup that notes the use, and upsert."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import valid_vector
from ..sources.upsert import upsert

#: What a vector depends on besides the query.
SCOPE = ["query_hash", "base_url", "model", "dimensions"]


def normalised(query: str) -> str:
    return " ".join(query.split())


def text_key(query: str) -> str:
    return hashlib.sha256(normalised(query).encode()).hexdigest()


def image_key(image_hash: str, resolution: int) -> str:
    """The key of an image query: the parts are parted by NUL, which none of them holds."""
    if not re.fullmatch("[0-9a-f]{64}", image_hash):
        raise TypeError("an image hash has 64 lower-case hex digits")
    if resolution < 1:
        raise ValueError("a resolution is a positive number of pixels")
    return hashlib.sha256("\0".join(("semantic-image-query", image_hash, str(resolution))).encode()).hexdigest()


def lookup(cache: DataFrame, key: str, base_url: str, model: str, dimensions: int) -> DataFrame:
    """The row of a key in a scope, if its vector is sound; an image's row has no query."""
    own = (F.col("query_hash") == key) & (F.col("base_url") == base_url) & (F.col("model") == model) & (F.col("dimensions") == dimensions)
    return cache.where(own & valid_vector(F.col("embedding"), dimensions))


def touched(cache: DataFrame, used: DataFrame, now: str) -> DataFrame:
    """The cache with last_used_at set to now for the rows of used."""
    marks = used.select(*SCOPE, F.lit(now).cast("timestamp").alias("tl_now")).dropDuplicates(SCOPE)
    return cache.join(marks, SCOPE, "left").withColumn("last_used_at", F.coalesce("tl_now", "last_used_at")).select(*cache.columns)


def remember(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with new rows in the place of those of equal scope; rows with unsound vectors are refused."""
    return upsert(cache, rows.where(valid_vector(F.col("embedding"), F.col("dimensions"))), SCOPE, "last_used_at")
