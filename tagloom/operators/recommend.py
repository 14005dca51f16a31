"""Tag recommendations: TF-IDF cosine with cheap retrieval and exact reranking, and their cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, scratch, sweep

# Tags that score, tags that retrieve, candidates that are reranked, and the ubiquity floor.
SCORING_TAGS, RETRIEVAL_TAGS, RERANKED = 64, 16, 800
FLOOR_SHARE, FLOOR_ITEMS = 0.30, 500
TTL_HOURS, DRIFT = 24, 0.02
#: Pairs of seed and candidate that one round of recommend_all shuffles, and those of one of its tasks.
ROUND_PAIRS, TASK_PAIRS = 64_000_000, 1_000_000


def weights(item: DataFrame, item_tag: DataFrame) -> DataFrame:
    """(tag_id, post_count, idf) of the tags in use; idf is ln(items / post_count), at least 0."""
    n = item.agg(F.count("*").alias("items"))
    counts = item_tag.groupBy("tag_id").agg(F.count("*").alias("post_count"))
    return counts.crossJoin(F.broadcast(n)).select("tag_id", "post_count", "items", F.greatest(F.lit(0.0), F.log(F.col("items") / F.col("post_count"))).alias("idf"))  # n is one row


def norms(item: DataFrame, item_tag: DataFrame, weight: DataFrame) -> DataFrame:
    """(item_id, norm): root of the summed squared idf of all of an item's tags, 0 without any."""
    sums = item_tag.join(weight, "tag_id").groupBy("item_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return item.select(F.col("id").alias("item_id")).join(sums, "item_id", "left").fillna({"norm": 0.0})


def _kept(weight: DataFrame) -> DataFrame:
    return weight.where((F.col("post_count") > 1) & (F.col("post_count") <= F.greatest(F.lit(FLOOR_ITEMS), F.floor(F.lit(FLOOR_SHARE) * F.col("items")))))


def recommend(seeds: DataFrame, item: DataFrame, item_tag: DataFrame, grp_item: DataFrame, *, limit: int = 10, weight: DataFrame | None = None, norm: DataFrame | None = None) -> DataFrame:
    """(item_id, recommended_id, score, rank) for each seed (item_id).

    Tags of one item only and of too many items don't count as a seed's tags, but norms cover all tags. Candidates share one of
    the seed's first RETRIEVAL_TAGS tags, aren't the seed and share no group with it; the RERANKED best by shared squared idf
    over their norm are scored with the seed's first SCORING_TAGS tags. Scores are rounded to 9 places before they rank.
    weight, norm: what weights() and norms() gave, where a library has stored it.
    """
    weight = weights(item, item_tag) if weight is None else weight
    norm = norms(item, item_tag, weight) if norm is None else norm
    kept = _kept(weight).select("tag_id", "idf")
    first = Window.partitionBy("seed").orderBy(F.desc("idf"), "tag_id")
    own = seeds.select(F.col("item_id").alias("seed")).distinct().join(item_tag, F.col("seed") == F.col("item_id")).join(kept, "tag_id").select("seed", "tag_id", "idf")
    own = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= SCORING_TAGS)
    # Per tag at most the floor's items: a tag with more was dropped above.
    met = own.where(F.col("place") <= RETRIEVAL_TAGS).join(item_tag, "tag_id").where("item_id <> seed").groupBy("seed", "item_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("shared"))
    same = grp_item.select(F.col("group_id"), F.col("item_id").alias("seed")).join(seeds.select(F.col("item_id").alias("seed")).distinct(), "seed", "left_semi").join(grp_item.select("group_id", "item_id"), "group_id").select("seed", "item_id").distinct()
    met = met.join(same, ["seed", "item_id"], "left_anti").join(norm, "item_id")
    best = Window.partitionBy("seed").orderBy(F.desc_nulls_last(F.round(F.when(F.col("norm") > 0, F.col("shared") / F.col("norm")), 9)), "item_id")
    met = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= RERANKED).select("seed", "item_id", "norm")
    dots = met.join(item_tag, "item_id").join(own.select("seed", "tag_id", "idf"), ["seed", "tag_id"]).groupBy("seed", "item_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.join(norm.select(F.col("item_id").alias("seed"), F.col("norm").alias("seed_norm")), "seed")
    length = F.col("norm") * F.col("seed_norm")
    scored = scored.withColumn("score", F.round(F.when(length > 0, F.col("dot") / length).otherwise(0.0), 9))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("seed").alias("item_id"), F.col("item_id").alias("recommended_id"), "score", "rank")


def recommend_all(item: DataFrame, item_tag: DataFrame, grp_item: DataFrame, *, limit: int = 10, weight: DataFrame | None = None, norm: DataFrame | None = None, round_pairs: int = ROUND_PAIRS) -> DataFrame:
    """What recommend gives with every item as a seed, in rounds of about round_pairs pairs, so that shuffled pairs never lie on disk at once.

    A seed of at most RETRIEVAL_TAGS tags whose lists hold at most RERANKED other items in all is light: all its candidates are
    reranked, and their score is the shared squared idf over both norms. Light seeds get their tags' lists of items with norms;
    the others go through recommend. Rounds write their rows to the shared folder; without one, all goes through recommend.
    """
    spark = item.sparkSession
    weight = weights(item, item_tag) if weight is None else weight
    norm = norms(item, item_tag, weight) if norm is None else norm
    every = item.select(F.col("id").alias("item_id"))
    path = scratch(spark, "recommendations")
    if path is None:
        return recommend(every, item, item_tag, grp_item, limit=limit, weight=weight, norm=norm)
    own = Window.partitionBy("item_id")
    first = own.orderBy(F.desc("idf"), "tag_id")
    used = item_tag.join(_kept(weight).select("tag_id", "idf", F.col("post_count").alias("n")), "tag_id")
    # Sums are over the retrieval tags; a seed beyond them is heavy by its number of tags.
    used = used.withColumn("tags", F.count("*").over(own)).withColumn("place", F.row_number().over(first))
    used = used.withColumn("met", F.sum(F.when(F.col("place") <= RETRIEVAL_TAGS, F.col("n") - 1)).over(own)).withColumn("light", (F.col("tags") <= RETRIEVAL_TAGS) & (F.col("met") <= RERANKED))
    used.select("item_id", "tag_id", "idf", "n", "met", "light").write.option("compression", "zstd").parquet(f"{path}/used")
    used = spark.read.parquet(f"{path}/used")
    sweep(spark)
    by_seed = used.groupBy("item_id").agg(F.first("light").alias("light"), F.first("met").alias("met"))
    sizes = {r["light"]: r["pairs"] for r in by_seed.groupBy("light").agg(F.sum("met").alias("pairs")).collect()}  # two rows
    schema, parts = "item_id long, recommended_id long, score double, rank int", []
    if sizes.get(True):
        # A light seed's tags have at most RERANKED other items, which bounds the lists.
        groups = grp_item.groupBy("item_id").agg(F.collect_set("group_id").alias("groups"))
        held = used.where(F.col("n") <= RERANKED + 1).join(norm, "item_id").join(groups, "item_id", "left")
        lists = held.groupBy("tag_id").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("item_id", "norm", "light", "groups")).alias("x"))
        lists = lists.select((F.col("idf") * F.col("idf")).alias("w"), "x.item_id", "x.norm", "x.light", "x.groups").mapInArrow(_skipped(), "w double, item_id array<long>, norm array<double>, light array<boolean>, a array<int>, b array<int>")
        lists.write.option("compression", "zstd").parquet(f"{path}/lists")
        sweep(spark)
        lists = spark.read.parquet(f"{path}/lists")
        rounds = -(-sizes[True] // round_pairs)
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes[True] // rounds // TASK_PAIRS + 1)
        for r in range(rounds):
            sent = lists.mapInArrow(_sent(r, rounds), "seed long, seed_norm double, w double, items array<long>, norms array<double>")
            sent.repartition(tasks, "seed").sortWithinPartitions("seed").mapInArrow(_ranked(limit), schema).write.option("compression", "zstd").parquet(f"{path}/light-{r}")
            parts.append(f"{path}/light-{r}")
            sweep(spark)
    rounds = -(-(sizes.get(False) or 0) // round_pairs)
    for r in range(rounds):
        seeds = by_seed.where(~F.col("light") & (F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)).select("item_id")
        recommend(seeds, item, item_tag, grp_item, limit=limit, weight=weight, norm=norm).write.option("compression", "zstd").parquet(f"{path}/heavy-{r}")
        parts.append(f"{path}/heavy-{r}")
        sweep(spark)
    for name in ("used", "lists"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    if not parts:
        discard(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts)


def _skipped():
    """Of rows (w, item_id, norm, light, groups), lists over a tag's items: the pairs of places that share a group, instead of the groups."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for groups in batch.column(4).to_pylist():
                members: dict[int, list[int]] = {}
                for i, own in enumerate(groups):
                    for g in own or ():
                        members.setdefault(g, []).append(i)
                pairs = sorted({(i, j) for m in members.values() if len(m) > 1 for i in m for j in m if i != j})
                a.append([i for i, _ in pairs])
                b.append([j for _, j in pairs])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], names=["w", "item_id", "norm", "light", "a", "b"])

    return rows


def _sent(r: int, rounds: int):
    """The lists to each light seed of a round, without the seed and those that share a group with it."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            w = np.asarray(batch.column(0))
            n = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
            item, norm, light = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            # A multiplicative hash, as ids may come in steps.
            mixed = (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            seed = np.flatnonzero(light & (mixed % np.uint64(rounds) == r))
            size = n[row[seed]]
            if not size.sum():
                continue
            begin = np.cumsum(size) - size
            of = np.repeat(np.arange(len(seed)), size)
            other = np.arange(size.sum()) - begin[of] + start[row[seed]][of]
            keep = other != seed[of]
            pairs = np.asarray(batch.column(4).value_lengths()).astype(np.int64)
            if pairs.any():
                base = np.repeat(start, pairs)
                a, b = (batch.column(k).flatten().to_numpy(zero_copy_only=False) + base for k in (4, 5))
                place = np.full(len(item), -1)
                place[seed] = np.arange(len(seed))
                asked = place[a] >= 0
                k = place[a[asked]]
                keep[begin[k] + b[asked] - start[row[b[asked]]]] = False
            ends = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(seed)))])
            offsets = pa.array(ends, pa.int32())
            other = other[keep]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[other])) for x in (item, norm)]
            out = pa.RecordBatch.from_arrays([pa.array(item[seed]), pa.array(norm[seed]), pa.array(w[row[seed]]), *lists], names=["seed", "seed_norm", "w", "items", "norms"])
            for lo in range(0, len(seed), 10_000):
                yield out.slice(lo, 10_000)

    return rows


def _ranked(limit: int):
    """The first candidates of each seed, of rows in the order of the seeds."""

    def rows(batches):
        import numpy as np
        import pyarrow as pa

        def done(t):
            n = np.asarray(t.column(3).combine_chunks().value_lengths()).astype(np.int64)
            flat = [t.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in (3, 4)]
            seed, seed_norm, w = (np.repeat(t.column(k).to_numpy(), n) for k in (0, 1, 2))
            order = np.lexsort((flat[0], seed))
            seed, seed_norm, w, item, norm = (x[order] for x in (seed, seed_norm, w, *flat))
            if not len(seed):
                return
            at = np.flatnonzero(np.concatenate([[True], (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])]))
            dot, length = np.add.reduceat(w, at), norm[at] * seed_norm[at]
            seed, item = seed[at], item[at]
            score = np.round(np.divide(dot, length, out=np.zeros(len(dot)), where=length > 0), 9)
            order = np.lexsort((item, -score, seed))
            seed, item, score = seed[order], item[order], score[order]
            first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
            place = np.arange(len(seed)) - np.repeat(first, np.diff(np.append(first, len(seed))))
            keep = place < limit
            yield pa.RecordBatch.from_arrays([pa.array(seed[keep]), pa.array(item[keep]), pa.array(score[keep]), pa.array((place[keep] + 1).astype(np.int32))], names=["item_id", "recommended_id", "score", "rank"])

        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            seed = t.column(0).to_numpy()
            cut = int(np.searchsorted(seed, seed[-1])) if len(seed) else 0
            yield from done(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None:
            yield from done(left)

    return rows


def fresh(cache: DataFrame, as_of: str) -> DataFrame:
    """The cached rows (item_id, recommended_id, score, computed_at) of items whose newest row is younger than the TTL."""
    newest = cache.groupBy("item_id").agg(F.max("computed_at").alias("newest"))
    alive = newest.where(F.col("newest") > F.expr(f"timestamp '{as_of}' - interval {TTL_HOURS} hours")).select("item_id")
    return cache.join(alive, "item_id", "left_semi")


def cached(seeds: DataFrame, cache: DataFrame, as_of: str, compute) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache): fresh rows as they are; the other seeds computed and put in the place of their old rows."""
    alive = fresh(cache, as_of).join(seeds, "item_id", "left_semi")
    cold = seeds.join(alive.select("item_id").distinct(), "item_id", "left_anti")
    rows = compute(cold).select("item_id", "recommended_id", "score").withColumn("computed_at", F.lit(as_of).cast("timestamp"))
    kept = cache.join(cold, "item_id", "left_anti")
    return alive.unionByName(rows), kept.unionByName(rows)


def drifted(marker: int | None, total: int) -> bool:
    """Whether so many items came or went that every cached score is stale."""
    return marker is None or marker <= 0 or abs(total - marker) >= DRIFT * marker


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache without rows from or to the changed items (item_id)."""
    left = cache.join(changed, "item_id", "left_anti")
    return left.join(changed.select(F.col("item_id").alias("recommended_id")), "recommended_id", "left_anti").select(*cache.columns)
