"""Mixing sources to target weights by Poisson replication (operator 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, row, small_side, table, unpacked

#: Target weights by source; others weigh DEFAULT_WEIGHT.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
DEFAULT_WEIGHT = 1.0
#: Expected documents out, as a share of those in.
EPOCHS = 1.0
SEED = "mix-1"
#: A mean above this is split into equal parts with a draw each, as their sum is Poisson too.
MOST_MEAN = 16.0
#: Terms of the distribution function of a mean of at most MOST_MEAN; the rest has a probability below 1e-30.
TERMS = 96
#: Sources up to which their rates are broadcast; beyond, the join is by shuffle.
MOST_SOURCES = 20_000


def rates(docs: DataFrame, weights: dict[str, float] | DataFrame = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, rate): the mean number of copies that gives each source its share of epochs * N documents. A null source is one.

    weights: by source, or a table (source, weight) with a row a source; sources it lacks weigh DEFAULT_WEIGHT.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    given = weights if isinstance(weights, DataFrame) else docs.sparkSession.createDataFrame(sorted(weights.items()), "source string, weight double")
    given = given.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
    weighted = counts.join(given, F.col("source") == F.col("w_source"), "left").select("source", "n", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)).alias("weight"))
    total = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    return weighted.crossJoin(F.broadcast(total)).select("source", (F.col("weight") / F.col("all_weight") * F.col("all_n") * epochs / F.col("n")).alias("rate"))  # total is one row


def uniform(key: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> tuple[Column, Column]:
    """The distribution function of a part of the mean rate, and, given that as tl_cdf, a Poisson number of that mean.

    The number is found by inversion at uniform numbers seeded with doc_id.
    """
    parts = F.greatest(F.ceil(rate / MOST_MEAN), F.lit(1)).cast("int")
    mean = rate / parts
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("cdf"))

    def term(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.array_append(acc["cdf"], acc["sum"] + p).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, term, lambda acc: acc["cdf"])
    draw = lambda i: uniform(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), i.cast("string")))
    below = lambda n, u: n + F.size(F.filter(F.col("tl_cdf"), lambda c: c <= u))
    return cdf, F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), draw), F.lit(0), below)


def replicate(docs: DataFrame, weights: dict[str, float] | DataFrame = WEIGHTS, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """(tl_row, tl_rate, tl_copies, tl_replica, tl_order): each row of docs as often as drawn, in no particular order."""
    cdf, drawn = copies(row("doc_id"), F.col("tl_rate"), seed)
    table_ = rates(docs, weights, epochs).select(F.col("source").alias("tl_source"), F.col("rate").alias("tl_rate"))
    table_ = small_side(table_.withColumn("tl_cdf", cdf), MOST_SOURCES)  # a distribution function a source, not a document
    joined = packed(docs).join(table_, row("source").eqNullSafe(F.col("tl_source"))).withColumn("tl_copies", drawn)
    exploded = joined.where("tl_copies > 0").withColumn("tl_replica", F.explode(F.sequence(F.lit(0), F.col("tl_copies") - 1)))
    order = F.md5(F.concat_ws("|", F.lit(seed + "/order"), row("doc_id").cast("string"), F.col("tl_replica").cast("string")))
    return exploded.select("tl_row", "tl_rate", "tl_copies", "tl_replica", order.alias("tl_order"))


def mix(docs: DataFrame, weights: dict[str, float] | DataFrame = WEIGHTS, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """Each document as often as a Poisson draw of its source's rate says, in a global order by hash; columns as they were.

    The draw depends on seed and doc_id alone, so a rerun or a lost task gives the same; rows of one doc_id draw alike, those
    without a doc_id as one. Rows of equal order are in that of their texts' hashes. A null source has the default weight; null texts
    are rows like any other. An empty table gives an empty one.
    """
    return unpacked(_shuffled(replicate(docs, weights, epochs, seed)), docs.columns)


def _shuffled(rows: DataFrame) -> DataFrame:
    """The rows in a global order by tl_order, with ties by the row's hash of text."""
    return rows.repartitionByRange(F.col("tl_order")).sortWithinPartitions("tl_order", F.xxhash64(row("text")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are replicated and shuffled; each replica's text is reported by its hash. The cases of mix hold."""
    rows = _shuffled(replicate(table(spark, sf_dir, "documents")))
    own = [row(c).alias(c) for c in ("doc_id", "source")]
    return rows.select(*own, F.sha2(row("text"), 256).alias("text_sha256"), F.round("tl_rate", 9).alias("rate"), F.col("tl_copies").alias("n_copies"), F.col("tl_replica").alias("replica"), F.col("tl_order").alias("order_key"))


def op4_sql() -> str:
    weight = " ".join(f"WHEN '{s}' THEN {w:.17g}" for s, w in sorted(WEIGHTS.items()))
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, CAST(CASE source {weight} ELSE {DEFAULT_WEIGHT} END AS DOUBLE) AS weight FROM documents GROUP BY source),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts) * CAST({EPOCHS} AS DOUBLE) / n AS rate FROM counts),
split AS (SELECT *, CAST(greatest(ceil(rate / {MOST_MEAN}), 1) AS BIGINT) AS parts FROM rated),
terms AS (SELECT source, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS cdf, rate / parts AS mean FROM split
    UNION ALL SELECT source, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1), mean FROM terms WHERE k < {TERMS}),
tables AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY source),
draws AS (SELECT d.doc_id, d.source, d.text, s.rate, t.cdfs, unnest(range(s.parts)) AS i FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT doc_id, source, text, rate, CAST(sum(len(list_filter(cdfs, lambda c: c <= CAST(CAST('0x' || substr(md5('{SEED}|' || doc_id || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496))) AS INTEGER) AS n_copies FROM draws GROUP BY doc_id, source, text, rate)
SELECT doc_id, source, sha256(text) AS text_sha256, rate, n_copies, replica, md5('{SEED}/order|' || doc_id || '|' || replica) AS order_key
FROM (SELECT doc_id, source, text, round(rate, 9) AS rate, n_copies, CAST(unnest(range(n_copies)) AS INTEGER) AS replica FROM drawn)"""
