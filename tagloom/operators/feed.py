"""The personal feed: signals as seeds, a signed merge of their neighbourhoods, boosts, penalties and dedupe."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import delete, discard, scratch, sweep

# Fixed values of the feed.
RECENT, SAMPLED, BANDS, PER_SEED = 30, 60, 5, 20
EMBEDDING_WEIGHT, TAG_WEIGHT = 0.7, 0.3
FAVOURITE_HALF_LIFE, SAMPLED_FLOOR = 90.0, 0.25
NEGATIVES, NEGATIVE_HALF_LIFE, NEGATIVE_STRENGTH = 30, 60.0, 0.8
VIEWS, VIEW_HALF_LIFE, VIEW_CAP, VIEW_SATURATION = 25, 30.0, 0.35, 8
VIEWED_FLOOR, VIEWED_HALF_LIFE = 0.3, 30.0
DISCOUNT, FRESHNESS, FRESHNESS_HALF_LIFE, FEED_SIZE = 0.8, 0.15, 7.0, 500


def age_days(at: Column, as_of: str) -> Column:
    return F.greatest((F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0, F.lit(0.0))


def decay(days: Column, half_life: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * days / half_life)


def mulberry32(seed: int):
    """A generator of numbers in [0, 1) from a 32-bit state."""
    state = seed & 0xFFFFFFFF
    mul = lambda a, b: (a * b) & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = mul(state ^ state >> 15, state | 1)
        t ^= (t + mul(t ^ t >> 7, t | 61)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    return draw


def weighted_draw(pool: list[tuple[int, float]], k: int, draw) -> list[tuple[int, float]]:
    """k of the (id, weight) rows, without replacement, each draw in proportion to the weights left."""
    left, out = list(pool), []
    while left and len(out) < k:
        at = draw() * sum(w for _, w in left)
        for i, (_, w) in enumerate(left):
            at -= w
            if at <= 0 or i == len(left) - 1:
                out.append(left.pop(i))
                break
    return out


def select_seeds(newest_first: list[tuple[int, float]], bucket: int) -> list[tuple[int, float]]:
    """The RECENT newest favourites by recency weight, and SAMPLED drawn from equal bands of the older ones.

    A band short of rows leaves its draws to the pooled rest. Sampled weights are at least SAMPLED_FLOOR. The fold is over one
    person's favourites; its draws depend on each other, so it runs on the driver.
    """
    recent, older = newest_first[:RECENT], newest_first[RECENT:]
    draw = mulberry32(bucket)
    per_band = SAMPLED // BANDS
    size = len(older) // BANDS
    picked: list[tuple[int, float]] = []
    for b in range(BANDS):
        band = older[b * size : (b + 1) * size if b < BANDS - 1 else len(older)]
        picked += weighted_draw(band, per_band + (SAMPLED - per_band * BANDS if b == 0 else 0), draw)
    chosen = {i for i, _ in picked}
    picked += weighted_draw([x for x in older if x[0] not in chosen], SAMPLED - len(picked), draw)
    return recent + [(i, max(w, SAMPLED_FLOOR)) for i, w in picked]


#: Favourites in a block: the driver holds the sum of each block, and the rows of the blocks that a draw falls into.
BLOCK = 1_024


def seeds_of(favourite: DataFrame, bucket: int) -> list[tuple[int, float]]:
    """What select_seeds gives for favourite (item_id, at, weight), newest first.

    The favourites stay in a table, in order; a draw finds its block by the blocks' sums, then its row in the block.
    """
    spark = favourite.sparkSession
    path = scratch(spark, "favourites")
    newest = favourite.orderBy(F.desc("at"), "item_id").select("item_id", "weight")
    if path is None:
        return select_seeds([tuple(r) for r in newest.collect()], bucket)
    newest.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    # A row's number is its partition, which is a range of the order, and its place in there, in 33 bits.
    rows = spark.read.parquet(path).withColumn("part", F.shiftright("row", 33).cast("int"))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}  # one row a partition
    starts, n = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(n)
        n += sizes.get(part, 0)
    if n <= max(BLOCK, RECENT + SAMPLED):
        out = select_seeds([(r["item_id"], r["weight"]) for r in rows.orderBy("row").collect()], bucket)
        discard(path)
        return out
    older = n - RECENT
    size = older // BANDS
    start = F.element_at(F.lit(starts).cast("array<long>"), F.col("part") + 1)
    rows = rows.withColumn("place", start + F.col("row").bitwiseAND((1 << 33) - 1) - RECENT)
    recent = [(r["item_id"], r["weight"]) for r in rows.where("place < 0").orderBy("place").collect()]  # RECENT rows
    band = F.least(F.floor(F.col("place") / size), F.lit(BANDS - 1))
    rows = rows.where("place >= 0").withColumn("band", band).withColumn("block", F.floor((F.col("place") - F.col("band") * size) / BLOCK))
    # Added in the order of the rows, so that sums don't depend on tasks.
    in_order = F.array_sort(F.collect_list(F.struct("place", "weight")))
    sums: list[dict[int, float]] = [{} for _ in range(BANDS)]
    for r in rows.groupBy("band", "block").agg(F.aggregate(in_order, F.lit(0.0), lambda t, x: t + x["weight"]).alias("sum")).orderBy("band", "block").collect():  # one row a block
        sums[r["band"]][r["block"]] = r["sum"]
    met: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def fetch(keys: set[tuple[int, int]]) -> None:
        asked = rows.where((F.col("band") * (1 << 32) + F.col("block")).isin([b * (1 << 32) + k for b, k in keys]))
        for r in asked.orderBy("place").collect():  # at most a block a draw
            met.setdefault((r["band"], r["block"]), []).append((r["item_id"], r["weight"]))

    def fall(left: dict[int, float], u: float) -> tuple[int, float]:
        """The block that a draw falls into, and what is left of it there."""
        at = u * sum(left.values())
        for k, w in left.items():
            if at - w <= 0:
                return k, at
            at -= w
        return k, at + w

    draw = mulberry32(bucket)
    quota = [SAMPLED // BANDS + (SAMPLED % BANDS if b == 0 else 0) for b in range(BANDS)]  # no band is short of rows here
    draws = [[draw() for _ in range(q)] for q in quota]
    fetch({(b, fall(sums[b], u)[0]) for b in range(BANDS) for u in draws[b]})
    picked = []
    for b in range(BANDS):
        left = sums[b]
        for u in draws[b]:
            k, at = fall(left, u)
            if (b, k) not in met:  # what was drawn before has moved the draw into another block
                fetch({(b, k)})
            own = met[b, k]
            for i, (_, w) in enumerate(own):
                at -= w
                if at <= 0 or i == len(own) - 1:
                    picked.append(own.pop(i))
                    break
            if own:
                left[k] = sum(w for _, w in own)
            else:
                del left[k]
    discard(path)
    return recent + [(i, max(w, SAMPLED_FLOOR)) for i, w in picked]


def recency_weights(signals: DataFrame, as_of: str, half_life: float = FAVOURITE_HALF_LIFE) -> DataFrame:
    """signals (item_id, at) with weight, halved every half_life days."""
    return signals.withColumn("weight", decay(age_days(F.col("at"), as_of), half_life))


def negative_seeds(dismissal: DataFrame, as_of: str) -> DataFrame:
    """(seed, weight) of the newest dismissals."""
    rows = recency_weights(dismissal, as_of, NEGATIVE_HALF_LIFE)
    return rows.orderBy(F.desc("at"), "item_id").limit(NEGATIVES).select(F.col("item_id").alias("seed"), "weight")


def view_seeds(view: DataFrame, explicit: DataFrame, as_of: str) -> DataFrame:
    """(seed, weight) of the newest views of items without an explicit signal: by recency and the saturated view count."""
    rows = view.join(explicit.select("item_id").distinct(), "item_id", "left_anti").orderBy(F.desc("at"), "item_id").limit(VIEWS)
    depth = F.least(F.lit(1.0), F.log(1.0 + F.col("view_count")) / F.log(F.lit(1.0 + VIEW_SATURATION)))
    return rows.select(F.col("item_id").alias("seed"), (VIEW_CAP * decay(age_days(F.col("at"), as_of), VIEW_HALF_LIFE) * depth).alias("weight"))


def merge(channels: DataFrame, embedded: DataFrame) -> DataFrame:
    """(item_id, score) from rows (seed, weight, positive, channel, item_id, similarity); channel is 'tag' or 'embedding'.

    A candidate gets from each seed the weighted similarities over what it could reach: the tag channel, and the embedding one
    if both ends have a vector. Positive contributions add up with a geometric discount from the largest on, negative ones are
    subtracted plainly; scores above zero stay.
    """
    has = embedded.select(F.col("item_id").alias("e_id")).distinct()
    marked = channels.join(has, F.col("item_id") == F.col("e_id"), "left").withColumn("item_has", F.col("e_id").isNotNull()).drop("e_id")
    marked = marked.join(has, F.col("seed") == F.col("e_id"), "left").withColumn("seed_has", F.col("e_id").isNotNull()).drop("e_id")
    share = F.when(F.col("channel") == "embedding", EMBEDDING_WEIGHT).otherwise(TAG_WEIGHT)
    reach = F.when(F.col("item_has") & F.col("seed_has"), TAG_WEIGHT + EMBEDDING_WEIGHT).otherwise(TAG_WEIGHT)
    part = share * F.col("weight") * F.least(F.greatest("similarity", F.lit(0.0)), F.lit(1.0)) / reach
    each = marked.groupBy("seed", "positive", "item_id").agg(F.sum(part).alias("c"))
    # A candidate's contributions: one a seed, and there are at most RECENT + SAMPLED + VIEWS + NEGATIVES seeds.
    plus = F.sort_array(F.collect_list(F.when(F.col("positive"), F.round("c", 12))), asc=False)
    minus = F.coalesce(F.sum(F.when(~F.col("positive"), F.col("c"))), F.lit(0.0))
    rows = each.groupBy("item_id").agg(plus.alias("plus"), minus.alias("minus"))
    total = F.aggregate(F.transform("plus", lambda c, i: c * F.pow(F.lit(DISCOUNT), i)), F.lit(0.0), lambda s, x: s + x)
    scored = rows.select("item_id", F.round(total - NEGATIVE_STRENGTH * F.col("minus"), 9).alias("score"))
    return scored.where("score > 0")


def freshen(rows: DataFrame, item: DataFrame, as_of: str) -> DataFrame:
    """Scores raised for items imported lately; without a date they stay."""
    at = item.select(F.col("id").alias("item_id"), "imported_at")
    boost = F.when(F.col("imported_at").isNotNull(), 1 + FRESHNESS * decay(age_days(F.col("imported_at"), as_of), FRESHNESS_HALF_LIFE)).otherwise(1.0)
    return rows.join(at, "item_id", "left").withColumn("score", F.col("score") * boost).drop("imported_at")


def fade_viewed(rows: DataFrame, view: DataFrame, as_of: str) -> DataFrame:
    """Scores lowered for items seen lately, the less the longer ago."""
    seen = view.select("item_id", F.col("at").alias("seen_at"))
    fade = F.when(F.col("seen_at").isNotNull(), 1 - (1 - VIEWED_FLOOR) * decay(age_days(F.col("seen_at"), as_of), VIEWED_HALF_LIFE)).otherwise(1.0)
    return rows.join(seen, "item_id", "left").withColumn("score", F.col("score") * fade).drop("seen_at")


def excluded(favourite: DataFrame, dismissal: DataFrame, seeds: DataFrame, grp_item: DataFrame) -> DataFrame:
    """item_id of favourites, dismissals, and every member of a group with a seed (seed) or a favourite."""
    marked = seeds.select(F.col("seed").alias("item_id")).unionByName(favourite.select("item_id")).distinct()
    groups = grp_item.join(marked, "item_id", "left_semi").select("group_id").distinct()
    members = grp_item.join(groups, "group_id", "left_semi").select("item_id")
    return favourite.select("item_id").unionByName(dismissal.select("item_id")).unionByName(members).unionByName(seeds.select(F.col("seed").alias("item_id"))).distinct()


def first_claim(rows: Iterable[tuple[int, list[int]]], claimed: set[int] | None = None) -> list[int]:
    """ids of the ranked (id, groups) rows, dropping one if any of its groups was claimed by a row kept before it.

    claimed: groups claimed by earlier lists of the same polarity; it grows.
    """
    claimed = set() if claimed is None else claimed
    out = []
    for i, groups in rows:
        if claimed.isdisjoint(groups):
            out.append(i)
            claimed.update(groups)
    return out


def visual_first(ranked: DataFrame, item: DataFrame) -> DataFrame:
    """ranked (item_id, score) with one item for each blurhash and size, the best; items without a blurhash all stay."""
    rows = ranked.join(item.select(F.col("id").alias("item_id"), "blurhash", "width", "height"), "item_id")
    key = F.coalesce(F.concat_ws("|", "blurhash", F.coalesce(F.col("width").cast("string"), F.lit("-")), F.coalesce(F.col("height").cast("string"), F.lit("-"))), F.lit(""))
    rows = rows.withColumn("look", F.when(F.col("blurhash").isNotNull(), key).otherwise(F.concat(F.lit("#"), F.col("item_id").cast("string"))))
    rank = F.row_number().over(Window.partitionBy("look").orderBy(F.desc("score"), "item_id"))
    return rows.withColumn("place", rank).where("place = 1").select("item_id", "score")


#: How many times the seeds it needs a feed reads of views and dismissals.
OVERFETCH = 4
#: Kept signals that are broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000


def collapsed(signals: DataFrame, grp_item: DataFrame, claimed: set[int], most: int | None = None) -> DataFrame:
    """signals (item_id, at, ...) without those in a group that a newer one, or one of an earlier list, has claimed.

    Signals are folded in order on the driver, partition by partition as they arrive, however many there are; it holds the
    kept ids and the claimed groups.
    """
    newest = signals.orderBy(F.desc("at"), "item_id").limit(most) if most else signals
    groups = grp_item.join(newest.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.collect_set("group_id").alias("groups"))
    rows = newest.select("item_id", "at").join(groups, "item_id", "left").orderBy(F.desc("at"), "item_id").select("item_id", "groups").toLocalIterator()
    kept = first_claim(((r["item_id"], r["groups"] or []) for r in rows), claimed)
    ids = signals.sparkSession.createDataFrame([(i,) for i in kept], "item_id long")
    return newest.join(F.broadcast(ids) if len(kept) <= MOST_BROADCAST else ids, "item_id", "left_semi")


#: Signals that are folded on the driver, and rounds after which it folds the rest however many there are.
FOLDED, ROUNDS = 20_000, 30


def collapsed_all(signals: DataFrame, grp_item: DataFrame) -> DataFrame:
    """(item_id, at, groups) of what collapsed keeps of all signals (item_id, at), of which an item has one; groups: those they claim.

    In each round a signal that is the first in all of its groups is kept, and the others in those groups are dropped, which is what
    the fold in order comes to. A round decides one signal at least and mostly nearly all.
    """
    spark = signals.sparkSession
    groups = grp_item.join(signals.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.collect_set("group_id").alias("groups"))
    marked = signals.select("item_id", "at").join(groups, "item_id", "left")
    path = scratch(spark, "collapsed")
    if path is None:
        return collapsed(signals, grp_item, set()).select("item_id").join(marked, "item_id")
    marked.write.parquet(f"{path}/open-0")
    sweep(spark)
    left = spark.read.parquet(f"{path}/open-0")
    left.where("groups IS NULL").write.parquet(f"{path}/kept")
    left, r = left.where("groups IS NOT NULL"), 0
    while n := left.count():
        if n <= FOLDED or r == ROUNDS:
            rows = left.orderBy(F.desc("at"), "item_id").select("item_id", "groups").toLocalIterator()
            ids = spark.createDataFrame([(i,) for i in first_claim((x["item_id"], x["groups"]) for x in rows)], "item_id long")
            left.join(ids, "item_id", "left_semi").write.mode("append").parquet(f"{path}/kept")
            break
        pairs = left.select("item_id", F.struct("at", -F.col("item_id")).alias("key"), F.explode("groups").alias("group_id"))
        first = pairs.groupBy("group_id").agg(F.max("key").alias("first"))
        won = pairs.join(first, "group_id").groupBy("item_id").agg(F.bool_and(F.col("key") == F.col("first")).alias("won")).where("won")
        left.join(won, "item_id", "left_semi").write.parquet(f"{path}/won-{r}")
        sweep(spark)
        won = spark.read.parquet(f"{path}/won-{r}")
        won.write.mode("append").parquet(f"{path}/kept")
        decided = pairs.join(won.select(F.explode("groups").alias("group_id")), "group_id", "left_semi").select("item_id")  # those kept among them
        left.join(decided, "item_id", "left_anti").write.parquet(f"{path}/open-{r + 1}")
        sweep(spark)
        delete(spark, f"{path}/open-{r}")
        delete(spark, f"{path}/won-{r}")
        r += 1
        left = spark.read.parquet(f"{path}/open-{r}")
    delete(spark, f"{path}/open-{r}")
    return spark.read.parquet(f"{path}/kept")


def claimed_among(kept: DataFrame, signals: DataFrame, grp_item: DataFrame, most: int) -> set[int]:
    """Of the groups that kept (groups) has claimed, those of the most newest signals (item_id, at)."""
    newest = signals.orderBy(F.desc("at"), "item_id").limit(most).select("item_id")
    met = grp_item.join(newest, "item_id", "left_semi").select("group_id")
    return {r["group_id"] for r in kept.select(F.explode("groups").alias("group_id")).join(met, "group_id", "left_semi").distinct().collect()}


def one_of_each_group(ranked: DataFrame, grp_item: DataFrame) -> DataFrame:
    """ranked (item_id, score) after the first-claim rule over the items' groups.

    The rule is sequential, so the candidates of one feed (its seeds times their neighbours) are folded on the driver, partition
    by partition as they arrive, however many there are.
    """
    groups = grp_item.join(ranked.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.collect_set("group_id").alias("groups"))
    rows = ranked.join(groups, "item_id", "left").orderBy(F.desc("score"), "item_id").select("item_id", "groups").toLocalIterator()
    kept = first_claim((r["item_id"], r["groups"] or []) for r in rows)
    ids = ranked.sparkSession.createDataFrame([(i,) for i in kept], "item_id long")
    return ranked.join(F.broadcast(ids) if len(kept) <= MOST_BROADCAST else ids, "item_id", "left_semi")
