"""Vector search, score calibration and near-duplicate images by perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, hamming
from ..sources.store import delete, files_of, scratch, sweep
from ..sources.upsert import replace_keys
from .jobs import VectorConfig

# Results of a search, candidates and limit of a panel, sample of a calibration.
SEARCH_CAP, CANDIDATES, PANEL, PANEL_FLOOR = 288, 200, 20, 0.25
MOST_RESULTS = 1000
SAMPLE, LEAST_SAMPLE, PERCENTILE, MOST_BASELINE = 48, 16, 0.9, 0.95
#: Seeds that a broadcast may hold, that a block may hold where there are more, and ids that a broadcast may hold.
MOST_SENT, MOST_SEEDS, MOST_IDS = 4_096, 131_072, 1_000_000
#: Numbers in a task's seeds, seeds that are worth a task, seeds and vectors of a tile, pairs of equal groups made at once.
TASK_NUMBERS, TASK_SEEDS, TILE, CHUNK, PAIRS = 1 << 20, 1_024, 512, 4_096, 1 << 22


def nearest(vectors: DataFrame, query: DataFrame, *, exclude_self: bool = False, cap: int = SEARCH_CAP, min_score: float | None = None) -> DataFrame:
    """(item_id, score) of the cap vectors nearest to the one row of query (q_id, q), then those of at least min_score.

    The floor comes after the cap, so it never widens the search. Scores are rounded to 6 places; ties go by id.
    """
    rows = vectors.crossJoin(F.broadcast(query.limit(1)))  # one row
    rows = rows.where("item_id <> q_id") if exclude_self else rows
    top = rows.select("item_id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "item_id").limit(cap)
    return top if min_score is None else top.where(F.col("score") >= min_score)


def complete(vectors: DataFrame, config: VectorConfig) -> DataFrame:
    """(item_id, v) of the vectors of one config that are done."""
    return vectors.where(config.matches() & (F.col("status") == "COMPLETE") & F.col("v").isNotNull()).select("item_id", "v")


def result_page(vectors: DataFrame, config: VectorConfig, query: DataFrame, *, skip: int = 0, limit: int = PANEL, cap: int = MOST_RESULTS, min_score: float | None = None, exclude_self: bool = False) -> DataFrame:
    """(item_id, score, total): a page of what nearest gives over a config's vectors; total counts all that pass the floor."""
    cap = min(max(cap, 1), MOST_RESULTS)
    passing = nearest(complete(vectors, config), query, exclude_self=exclude_self, cap=cap, min_score=min_score)
    total = F.count("*").over(Window.partitionBy(F.lit(0)))  # at most MOST_RESULTS rows
    return passing.withColumn("total", total).orderBy(F.desc("score"), "item_id").offset(skip).limit(limit)


def nearest_to_each(vectors: DataFrame, seeds: DataFrame, grp_item: DataFrame | None = None, *, limit: int = PANEL, floor: float | None = None) -> DataFrame:
    """(seed, item_id, score, rank): for each seed (seed, q) the nearest vectors outside of its groups, then the floor.

    All seeds against all vectors: few seeds are sent to the tasks that read the vectors, many are dealt to tasks that each
    read all vectors. Vectors of another length than the seeds', and those without a direction, have no score.
    """
    n = seeds.count()
    return (_nearest_to_few if n <= min(MOST_SENT, MOST_SEEDS) else _nearest_to_many)(vectors, seeds, grp_item, limit, floor)


def _nearest_to_many(vectors: DataFrame, seeds: DataFrame, grp_item: DataFrame | None, limit: int, floor: float | None) -> DataFrame:
    """Writes the vectors with their groups once, then the neighbours of one block of seeds after the other. A task finds all
    neighbours of its seeds, so none of their candidates are shuffled."""
    spark = vectors.sparkSession
    path = scratch(spark, "nearest")
    if path is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    seeds = seeds.where("q IS NOT NULL AND size(q) > 0").select("seed", "q")
    n, width, most = seeds.agg(F.count("*"), F.min(F.size("q")), F.max(F.size("q"))).first()
    if not n:  # no seed has a vector
        return spark.createDataFrame([], "seed long, item_id long, score double, rank int")
    if width < most:
        raise ValueError("the seeds of one search have vectors of one length")
    vectors = vectors.where((F.size("v") == width) & F.forall("v", lambda x: x.isNotNull())).select("item_id", "v")
    if grp_item is None:
        none = F.lit(None).cast("array<long>")
        seeds, vectors = seeds.withColumn("groups", none), vectors.withColumn("groups", none)
    else:
        # Only groups of seeds and vectors matter; they are read once.
        seeds.select(F.col("seed").alias("item_id")).unionByName(vectors.select("item_id")).distinct().write.parquet(f"{path}/ids")
        ids = spark.read.parquet(f"{path}/ids")
        ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
        grp_item.select("group_id", "item_id").join(ids, "item_id", "left_semi").groupBy("item_id").agg(F.collect_set(F.col("group_id").cast("long")).alias("groups")).write.parquet(f"{path}/groups")
        groups = spark.read.parquet(f"{path}/groups")
        seeds, vectors = seeds.join(groups.withColumnRenamed("item_id", "seed"), "seed", "left"), vectors.join(groups, "item_id", "left")
    cores = spark.sparkContext.defaultParallelism
    vectors.select("item_id", "v", "groups").coalesce(2 * cores).write.parquet(f"{path}/vectors")
    sweep(spark)
    blocks, parts = -(-n // MOST_SEEDS), []
    search = _searcher(files_of(spark, f"{path}/vectors"), width, limit, floor)
    block, each = F.pmod(F.xxhash64("seed"), F.lit(blocks)), -(-n // blocks)
    tasks = max(-(-each * width // TASK_NUMBERS), min(2 * cores, -(-each // TASK_SEEDS)))
    for b in range(blocks):
        # By another key than the join's, whose partitions Spark would take over and put together.
        dealt = seeds.where(block == b).repartition(tasks, F.xxhash64("seed", F.lit(1)))
        dealt.select("seed", "q", "groups").mapInArrow(search, "seed long, item_id long, score double, rank int").write.parquet(f"{path}/block-{b}")
        parts.append(f"{path}/block-{b}")
        sweep(spark)
    delete(spark, f"{path}/vectors")
    return spark.read.schema("seed long, item_id long, score double, rank int").parquet(*parts)


def _searcher(files: list[str], width: int, limit: int, floor: float | None):
    """A function from batches of seeds (seed, q, groups) to their neighbours among the vectors (item_id, v, groups) in the files.

    Products in single precision leave out what can't be among the best of a seed by more than their error; the rest is scored
    in double precision.
    """
    import numpy as np
    import pyarrow as pa

    # The most that single precision and the rounding of scores may add up to.
    slack = 1.05 * (width + 8) * 2.0**-24 + 0.51e-6

    def flat(lists):
        """(place of the list, value) of each value."""
        import pyarrow.compute as pc

        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        return np.repeat(np.arange(len(n)), n), np.asarray(lists.flatten()).astype(np.int64)

    def filed(keys, rows):
        """The rows by key: keys, start and number of each, rows."""
        order = np.argsort(keys, kind="stable")
        known, start, n = np.unique(keys[order], return_index=True, return_counts=True)
        return known, start, n, rows[order]

    def looked_up(index, wanted):
        """(start, number) of the rows of each wanted key."""
        known, start, n, _ = index
        if not len(known):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        k = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return start[k], np.where(known[k] == wanted, n[k], 0)

    def met(index, start, n, col):
        """(row, col) of the rows of each looked up key."""
        first = np.repeat(start - (np.cumsum(n) - n), n)
        return index[3][first + np.arange(len(first))], np.repeat(col, n)

    def vectors():
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        for file in files:
            store, inner = FileSystem.from_uri(file)
            with store.open_input_file(inner) as f, pq.ParquetFile(f) as table:
                for b in table.iter_batches(batch_size=CHUNK, columns=["item_id", "v", "groups"], use_threads=False):
                    yield np.asarray(b.column(0)).astype(np.int64), np.asarray(b.column(1).flatten()).astype(np.float64).reshape(-1, width), *flat(b.column(2))

    def normal(v):
        """Lengths, rows of length 1 in single precision, and which rows are too short or long for these to be exact enough."""
        length = np.sqrt((v * v).sum(axis=1))
        return length, (v / length[:, None]).astype(np.float32), (length > 0) & ~((length > 1e-140) & (length < 1e140))

    def ranked(seed, item, score):
        """The order by seed, score and id, and each place in it."""
        order = np.lexsort((item, -score, seed))
        seed = seed[order]
        first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        return order, np.arange(len(seed)) - np.repeat(first, np.diff(np.append(first, len(seed))))

    def search(batches):
        got = [(np.asarray(b.column(0)).astype(np.int64), np.asarray(b.column(1).flatten()).astype(np.float64).reshape(-1, width), *flat(b.column(2))) for b in batches if b.num_rows]
        if not got:
            return
        with np.errstate(all="ignore"):
            yield neighbours(got)

    def neighbours(got):
        base = np.cumsum([0, *(len(x[0]) for x in got)])
        ids, q = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        by_id = filed(ids, np.arange(len(ids)))
        by_group = filed(np.concatenate([x[3] for x in got]), np.concatenate([x[2] + at for x, at in zip(got, base)]))
        got.clear()
        length, unit, wild = normal(q)
        unit[~(length > 0)] = np.nan
        # The best so far, unknown ones last; nothing after the last of a seed is among its best.
        item, score = np.full((len(ids), limit), np.iinfo(np.int64).max), np.full((len(ids), limit), -np.inf)
        low, late, waiting = np.full(len(ids), -np.inf, np.float32), [], 0
        products, marks, eight = np.empty(TILE * CHUNK, np.float32), np.zeros(TILE * CHUNK + 8, bool), np.arange(8)

        def take():
            """The best of what was found since the last time and what was known before."""
            x, i, s = (np.concatenate(z) for z in zip(*late))
            late.clear()
            rows = np.unique(x)
            i, s = np.concatenate([item[rows].ravel(), i]), np.concatenate([score[rows].ravel(), s])
            order, place = ranked(np.concatenate([np.repeat(rows, limit), x]), i, s)
            order = order[place < limit]
            item[rows], score[rows] = i[order].reshape(-1, limit), s[order].reshape(-1, limit)
            low[rows] = np.nextafter((score[rows, -1] - slack).astype(np.float32), np.float32(-np.inf))

        def tile(lo, hi, own, v, size, odd, part, row, col):
            """What the vectors add to the best of the seeds from lo to hi; row, col: the pairs that don't count."""
            n = (hi - lo) * len(own)
            product, mark = products[:n].reshape(hi - lo, -1), marks[:n].reshape(hi - lo, -1)
            np.matmul(unit[lo:hi], own.T, out=product)
            product[wild[lo:hi]] = np.inf
            if len(odd):
                product[:, odd] = np.inf
            product[row - lo, col] = np.nan
            np.greater_equal(product, low[lo:hi, None], out=mark)
            marks[n : n + 8] = False
            at = np.flatnonzero(marks[: -(-n // 8) * 8].view(np.uint64))  # most are none
            at = (at[:, None] * 8 + eight).ravel()
            at = at[marks[at]]
            out = 0
            for k in range(0, len(at), step := max(1, TASK_NUMBERS // width)):
                x, y = np.divmod(at[k : k + step], len(own))
                x += lo
                s = np.round(np.einsum("ij,ij->i", q[x], v[y]) / (length[x] * size[y]), 6)
                i, bar = part[y], score[x, -1]
                better = (s > bar) | ((s == bar) & (i < item[x, -1]))
                if better.any():
                    late.append((x[better], i[better], s[better]))
                    out += len(late[-1][0])
            return out

        seen = since = 0
        for i, v, owner, group in vectors():
            size, own, odd = normal(v)
            own[~(size > 0)] = np.nan
            start, n = looked_up(by_group, group)
            weight = np.cumsum(np.bincount(owner, n, len(i)))
            a = 0
            while a < len(i):
                # Few at first, when any may be among the best, and few where large groups meet.
                z = min(len(i), a + max(64, seen), max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + PAIRS, "right"))))
                inside = (owner >= a) & (owner < z) & (n > 0)
                self_at, self_n = looked_up(by_id, i[a:z])
                rows, cols = (np.concatenate(x) for x in zip(met(by_id, self_at, self_n, np.arange(z - a)), met(by_group, start[inside], n[inside], owner[inside] - a)))
                order = np.argsort(rows, kind="stable")
                rows, cols = rows[order], cols[order]
                cuts = np.searchsorted(rows, np.arange(0, len(ids) + TILE, TILE))
                for t, lo in enumerate(range(0, len(ids), TILE)):
                    own_pairs = slice(cuts[t], cuts[t + 1])
                    waiting += tile(lo, min(lo + TILE, len(ids)), own[a:z], v[a:z], size[a:z], np.flatnonzero(odd[a:z]), i[a:z], rows[own_pairs], cols[own_pairs])
                    if waiting > PAIRS:
                        take()
                        waiting = 0
                seen, since, a = seen + z - a, since + z - a, z
                if waiting and (since >= seen - since or since >= 16 * CHUNK):
                    take()
                    waiting = since = 0
        if late:
            take()
        # Rows of one seed that came more than once are ranked together.
        seed, i, s = np.repeat(ids, limit), item.ravel(), score.ravel()
        order, place = ranked(seed, i, s)
        keep = (place < limit) & (s[order] > (-np.inf)) & (True if floor is None else s[order] >= floor)
        order = order[keep]
        return pa.RecordBatch.from_arrays([pa.array(seed[order]), pa.array(i[order]), pa.array(s[order]), pa.array((place[keep] + 1).astype(np.int32))], names=["seed", "item_id", "score", "rank"])

    return search


def _nearest_to_few(vectors: DataFrame, seeds: DataFrame, grp_item: DataFrame | None, limit: int, floor: float | None) -> DataFrame:
    """The neighbours by a broadcast of the seeds. Each task multiplies its vectors with the seeds and hands on the best of each
    seed only; ranks are taken over those."""
    import numpy as np
    import pyarrow as pa

    none = F.lit(None).cast("array<long>")
    if grp_item is None:
        asked, held = seeds.withColumn("groups", none), vectors.withColumn("groups", none)
    else:
        own = seeds.join(grp_item.select(F.col("item_id").alias("seed"), "group_id"), "seed", "left").groupBy("seed").agg(F.collect_set("group_id").alias("groups"))
        asked = seeds.join(own, "seed")
        # Only the groups that a seed is in: most vectors have none of them.
        met = grp_item.join(own.select(F.explode("groups").alias("group_id")).distinct(), "group_id", "left_semi").groupBy("item_id").agg(F.collect_set("group_id").alias("groups"))
        held = vectors.join(met, "item_id", "left")
    rows = asked.select("seed", "q", "groups").where("q IS NOT NULL AND size(q) > 0").collect()  # at most MOST_SENT
    if not rows:  # no seed has a vector
        return vectors.sparkSession.createDataFrame([], "seed long, item_id long, score double, rank int")
    width = len(rows[0]["q"])
    ids = np.array([r["seed"] for r in rows], np.int64)
    matrix = np.array([r["q"] for r in rows if len(r["q"]) == width], np.float64).reshape(-1, width)
    if len(matrix) < len(rows):
        raise ValueError("the seeds of one search have vectors of one length")
    length = np.sqrt((matrix * matrix).sum(axis=1))
    ids, matrix, length = ids[length > 0], matrix[length > 0], length[length > 0]
    at = {int(i): k for k, i in enumerate(ids)}
    members: dict[int, list[int]] = {}
    for r in rows:
        for g in r["groups"] or ():
            if r["seed"] in at:
                members.setdefault(g, []).append(at[r["seed"]])
    sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix, length, at, members))

    def best(seed, item, score):
        """The first of each seed by rounded score, then id."""
        order = np.lexsort((item, -score, seed))
        seed, item, score = seed[order], item[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
        place = np.arange(len(seed)) - np.repeat(first, np.diff(np.append(first, len(seed))))
        keep = place < limit
        return seed[keep], item[keep], score[keep]

    def scored(batches):
        ids, matrix, length, at, members = sent.value
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            item = np.asarray(b.column(0)).astype(np.int64)
            v = np.asarray(b.column(1).flatten()).astype(np.float64).reshape(len(item), -1)
            for lo in range(0, len(item), 512):
                part, own = item[lo : lo + 512], v[lo : lo + 512]
                size = np.sqrt((own * own).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.round(matrix @ own.T / (length[:, None] * size), 6)
                score[:, size == 0] = np.nan
                for k, (i, groups) in enumerate(zip(part.tolist(), b.column(2)[lo : lo + 512].to_pylist())):
                    if i in at:
                        score[at[i], k] = np.nan
                    for g in groups or ():
                        score[members[g], k] = np.nan
                if score.shape[1] > limit:
                    bar = -np.partition(np.where(np.isnan(score), np.inf, -score), limit - 1, axis=1)[:, limit - 1]
                    x, y = np.nonzero(score >= bar[:, None])  # nothing is at least a NaN, and all is at least the bar of too few numbers
                else:
                    x, y = np.nonzero(~np.isnan(score))
                top = best(*(np.concatenate(z) for z in zip(top, (x, part[y], score[x, y]))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[top[0]]), pa.array(top[1]), pa.array(top[2])], names=["seed", "item_id", "score"])

    given = held.select("item_id", "v", "groups").where((F.size("v") == width) & F.forall("v", lambda x: x.isNotNull()))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "item_id"))
    found = given.mapInArrow(scored, "seed long, item_id long, score double").withColumn("rank", rank).where(F.col("rank") <= limit)
    return found if floor is None else found.where(F.col("score") >= floor)


def baseline(vectors: DataFrame) -> DataFrame:
    """One row (baseline, sample): the 90th percentile of the cosine of each two of 48 vectors in the order of their ids' MD5."""
    sample = vectors.orderBy(F.md5(F.col("item_id").cast("string"))).limit(SAMPLE)
    rn = sample.select(F.row_number().over(Window.orderBy(F.md5(F.col("item_id").cast("string")))).alias("rn"), "v")  # SAMPLE rows
    a, b = rn.select(F.col("rn").alias("i"), F.col("v").alias("x")), rn.select(F.col("rn").alias("j"), F.col("v").alias("y"))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j"))
    p = F.expr(f"percentile_cont({PERCENTILE}) WITHIN GROUP (ORDER BY c)")
    n = rn.agg(F.count("*").alias("sample"))
    at = pairs.select(cosine(F.col("x"), F.col("y")).alias("c")).agg(p.alias("p"))
    clamped = F.least(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)), F.lit(MOST_BASELINE))
    return at.crossJoin(n).select(F.round(F.when(F.col("sample") >= LEAST_SAMPLE, clamped).otherwise(0.0), 6).alias("baseline"), "sample")  # one row each


SETTING = ["base_url", "model", "dimensions", "resolution"]


def known_baseline(settings: DataFrame, config: VectorConfig, generation: int) -> DataFrame:
    """(baseline, sample) as stored for a config under the present generation; none if vectors were cleared since."""
    return settings.where(config.matches() & (F.col("generation") == generation)).select("baseline", "sample")


def remember_baseline(settings: DataFrame, estimate: DataFrame, config: VectorConfig, generation: int) -> DataFrame:
    """The settings with an estimate (baseline, sample) in the place of the config's row, stamped with the generation read before
    it was made. Estimates from less than a whole sample aren't stored, as more vectors will change them."""
    stamp = {"base_url": config.base_url, "model": config.model, "dimensions": config.dimensions, "resolution": config.resolution, "generation": generation}
    whole = estimate.where(F.col("sample") >= SAMPLE)
    rows = whole.select(*[F.lit(v).cast(settings.schema[k].dataType).alias(k) for k, v in stamp.items()], "baseline", "sample")
    return replace_keys(settings, rows, SETTING)


def calibrated(score, base):
    """The score above the baseline as a part of what lies above it, between 0 and 1."""
    return F.least(F.greatest((score - base) / (1 - base), F.lit(0.0)), F.lit(1.0))


def near_hashes(hashes: DataFrame, query_hash: int, *, exclude: int | None = None, threshold: int = 10, limit: int = 20) -> DataFrame:
    """(item_id, distance) of the hashes within the threshold, nearest first, ties by id."""
    threshold, limit = min(max(threshold, 0), 64), min(max(limit, 1), 100)
    rows = hashes if exclude is None else hashes.where(F.col("item_id") != exclude)
    return rows.select("item_id", hamming(F.col("phash"), F.lit(query_hash).cast("long")).alias("distance")).where(F.col("distance") <= threshold).orderBy("distance", "item_id").limit(limit)
