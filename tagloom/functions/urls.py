"""Source urls: which site and work they name, their canonical form, and which are worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of each site's work urls; the first that matches names the source.
SOURCE_PATTERNS = (
    ("PIXIV", r"(?i)pixiv\.net/(?:en/)?artworks/(\d+)"),
    ("PIXIV", r"(?i)pixiv\.net/member_illust\.php\?.*illust_id=(\d+)"),
    ("PIXIV", r"(?i)pximg\.net/.*/(\d+)_p\d+"),
    ("TWITTER", r"(?i)(?:twitter|x)\.com/\w+/status/(\d+)"),
    ("DEVIANTART", r"(?i)deviantart\.com/[\w-]+/art/[\w-]+-(\d+)"),
    ("DEVIANTART", r"(?i)deviantart\.com/deviation/(\d+)"),
    ("DEVIANTART", r"(?i)fav\.me/([a-z0-9]+)"),
    ("DANBOORU", r"(?i)danbooru\.donmai\.us/posts/(\d+)"),
    ("GELBOORU", r"(?i)gelbooru\.com/index\.php\?.*[?&]id=(\d+)"),
    ("GELBOORU", r"(?i)gelbooru\.com/.*[?&]id=(\d+)"),
)

# The canonical url of a work.
CANONICAL = {
    "PIXIV": "https://www.pixiv.net/artworks/",
    "TWITTER": "https://twitter.com/i/status/",
    "DEVIANTART": "https://www.deviantart.com/deviation/",
    "DANBOORU": "https://danbooru.donmai.us/posts/",
    "GELBOORU": "https://gelbooru.com/index.php?page=post&s=view&id=",
}

# Hosts of plain image files, and endpoints of programs.
IMAGE_HOSTS = (r"^i\.pximg\.net$", r"^pbs\.twimg\.com$", r"^cdn\.donmai\.us$", r"^img\d*\.gelbooru\.com$", r"^wimg\.rule34\.xxx$", r"\.wixmp\.com$")
ENDPOINTS = (r"/ajax/", r"/api/", r"\?.*format=json")


def source_type(url: Column) -> Column:
    out = F
    for kind, pattern in SOURCE_PATTERNS:
        out = out.when(url.rlike(pattern), F.lit(kind))
    return out


def source_id(url: Column) -> Column:
    out = F
    for _, pattern in SOURCE_PATTERNS:
        out = out.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))
    return out


def canonical_url(kind: Column, work: Column) -> Column:
    start = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    return F.concat(start[kind], work)


def host(url: Column) -> Column:
    """The lower-cased host of an absolute http url, null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def worth_showing(url: Column) -> Column:
    image = host(url).rlike("(?i)" + "|".join(IMAGE_HOSTS))
    return F.coalesce(~image, F.lit(False)) & ~url.rlike("(?i)" + "|".join(ENDPOINTS))


def display_sources(urls: DataFrame) -> DataFrame:
    """(id, source_type, source_id, url, label) from rows (id, place, url): one a work, canonical; other urls by their host."""
    rows = urls.select("id", "place", "url", source_type(F.col("url")).alias("source_type"), source_id(F.col("url")).alias("source_id"))
    rows = rows.where(F.col("source_type").isNotNull() | worth_showing(F.col("url")))
    known = F.col("source_type").isNotNull()
    rows = rows.withColumn("shown", F.when(known, canonical_url(F.col("source_type"), F.col("source_id"))).otherwise(F.col("url")))
    label = F.when(known, F.col("source_type")).otherwise(F.regexp_replace(host(F.col("url")), r"^www\.", ""))
    one = rows.withColumn("label", label).groupBy("id", "shown").agg(F.min(F.struct("place", "source_type", "source_id", "label")).alias("k"))
    return one.select("id", F.col("k.place").alias("place"), F.col("k.source_type").alias("source_type"), F.col("k.source_id").alias("source_id"), F.col("shown").alias("url"), F.col("k.label").alias("label"))
