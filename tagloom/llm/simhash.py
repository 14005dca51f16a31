"""SimHash near-dedup by the generalised pigeonhole principle (operator 8).

Fingerprints link at MOST_BITS or fewer differing bits. Bits that go together are grouped into partitions; each partition p
gets a threshold t_p, with the sum of (t_p + 1) equal to MOST_BITS + 1. Two fingerprints that link then differ in at most t_p
bits of some partition p: were it t_p + 1 or more in all of them, they would differ in more than MOST_BITS. The thresholds
come from dynamic programming on estimated candidate counts; they decide the cost, never the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, modest_batches, packed, row, ship, small_side, spread, table, unpacked, written
from .components import components

ship(__name__)

MOST_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints from which the driver estimates candidate counts; only the plan depends on them.
SAMPLE = 1024
#: Rows that one bucket may have; larger ones are compared block by block, by as many tasks as it takes.
BUCKET = 8192
#: Rows up to which a bucket's pairs are compared by shifting, without a search.
SHIFTS = 24
#: Relative costs, in nanoseconds, of a row that is dealt out and of a pair that is compared.
ROW_COST, PAIR_COST = 1500, 15


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash, unsigned, over XXH64 of 4-word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lower-cased
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[SHINGLE - 1 :].tolist() or [len(whole)]
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. A null text counts as empty."""
    modest_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_fingerprint_rows), f"doc_id {kind}, fp long")


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64), np.int64)
    for b in batches:
        fp = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["i", "n"])


def bit_correlation(classes: DataFrame, n: int) -> np.ndarray:
    """Absolute correlation of each two bits over all distinct fingerprints: 4096 sums, whatever the input."""
    rows = classes.select("fp").mapInArrow(lean(_bit_rows), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(4096)
    for r in rows:
        both[r["i"]] = r["n"]
    both = both.reshape(64, 64) / max(n, 1)
    p = both.diagonal()
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each starts at a bit with the strongest ties and takes the bits closest to it."""
    left, out = set(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        own = [max(left, key=lambda b: (sum(corr[b, c] for c in left if c != b), -b))]
        left.remove(own[0])
        while len(own) < size:
            b = max(left, key=lambda b: (sum(corr[b, c] for c in own), -b))
            own.append(b)
            left.remove(b)
        out.append(sorted(own))
    return out


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    key = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        key |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return key


def allocate(parts: list[list[int]], n: int, sample: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds of the partitions, -1 for none, whose (t + 1) add up to total, at the least estimated cost."""
    pairs = max(len(sample) * (len(sample) - 1) / 2, 1)
    cost = []
    for bits in parts:
        key, w = project(sample, bits), len(bits)
        found = np.zeros(3)
        for i in range(1, len(key)):
            d = np.bitwise_count(key[i:] ^ key[:-i])
            found += [(d <= t).sum() for t in range(3)]
        uniform = np.cumsum([1, w, w * (w - 1) / 2]) / 2.0**w
        share = np.maximum(found / pairs, uniform)
        rows = [1, 1 + w / 2, 1 + w / 2 + w * (w - 1) / 4]
        cost.append({-1: 0.0} | {t: n * rows[t] * ROW_COST + n * n / 2 * share[t] * PAIR_COST for t in range(3)})
    best = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (spent, chosen) in best.items():
            for t, x in c.items():
                k = have + t + 1
                if k <= total and (k not in step or spent + x < step[k][0]):
                    step[k] = (spent + x, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(classes: DataFrame, n: int, most_bits: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    corr = bit_correlation(classes, n)
    sample = np.array([r["fp"] for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    options = []
    for m in range(2, most_bits + 2):
        parts = group_bits(corr, m)
        cost, chosen = allocate(parts, n, sample, most_bits + 1)
        options.append((cost, m, [(b, t) for b, t in zip(parts, chosen) if t >= 0]))
    return min(options)[2]


def _probe_rows(parts: list[tuple[list[int], int]]):
    """Rows (p, key, probe, fp): each fingerprint under its own key, and under the keys within the threshold.

    Of two keys that differ, the one with a 0 at the lowest differing bit comes to the other, so a pair meets once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            for lo in range(0, len(fps), 2048):
                fp = fps[lo : lo + 2048]
                for p, (bits, t) in enumerate(parts):
                    key = project(fp, bits)
                    keys, own, probe = [key], [fp], [np.zeros(len(fp), np.int8)]
                    for size in range(1, t + 1):
                        for flips in itertools.combinations(range(len(bits)), size):
                            goes = (key >> np.uint64(flips[0])) & np.uint64(1) == 0
                            keys.append(key[goes] ^ np.uint64(sum(1 << f for f in flips)))
                            own.append(fp[goes])
                            probe.append(np.ones(len(own[-1]), np.int8))
                    key, own = np.concatenate(keys), np.concatenate(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), pa.array(key.view(np.int64)), pa.array(np.concatenate(probe)), pa.array(own.view(np.int64))], names=["p", "key", "probe", "fp"])

    return rows


def _search(own: np.ndarray, most_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that span every component of one large bucket: at most one an element, without comparing what is linked already."""
    left, right = [], []
    rest = np.unique(own)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            x, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ x) <= most_bits
            if near.any():
                hits, rest = rest[near], rest[~near]
                left.append(np.full(len(hits), x))
                right.append(hits)
                front = np.concatenate([front, hits])
    return left, right


def _verified(most_bits: int):
    """Edges between verified fingerprints of each bucket, from rows sorted by bucket, stored fingerprints before probes."""

    def bucket_edges(group: np.ndarray, probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        cut = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(group)]])
        size = np.repeat(ends - starts, ends - starts)
        for k in range(1, SHIFTS):
            i = np.flatnonzero((size[:-k] > k) & (size[:-k] <= SHIFTS) & (probe[:-k] == 0) & (group[:-k] == group[k:])) if len(fp) > k else []
            if not len(i):
                continue
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= most_bits]
            left.append(fp[i])
            right.append(fp[i + k])
        for a, b in zip(starts, ends):
            if b - a > SHIFTS and probe[a] == 0:
                x, y = _search(fp[a:b], most_bits)
                left += x
                right += y
        u = np.concatenate(left) if left else np.zeros(0, np.uint64)
        v = np.concatenate(right) if right else np.zeros(0, np.uint64)
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(v[keep].view(np.int64))], names=["u", "v"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(i)) for i in range(5)]
            held.append((np.stack(cols[:3]), cols[3], cols[4].astype(np.int64).view(np.uint64)))
            keys = held[-1][0]
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if not len(change) or sum(len(h[2]) for h in held) < 50_000:
                continue
            at = change[-1] + 1  # the last bucket may go on in the next batch
            tail = tuple(x[..., at:] for x in held[-1])
            held[-1] = tuple(x[..., :at] for x in held[-1])
            yield bucket_edges(*_joined(held))
            held = [tail]
        if held:
            yield bucket_edges(*_joined(held))

    def _joined(held):
        keys = np.concatenate([h[0] for h in held], axis=1)
        group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        return group, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

    return edges


def fingerprint_edges(classes: DataFrame, n: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Edges (u, v) of distinct fingerprints (column fp) whose components are those of all links at most_bits or fewer bits."""
    parts = plan(classes, n, most_bits)
    rows = classes.select("fp").mapInArrow(lean(_probe_rows(parts)), "p int, key long, probe byte, fp long")
    sizes = rows.groupBy("p", "key").agg(F.count("*").alias("size")).where(F.col("size") > BUCKET)
    hot = small_side(written(sizes, "hot-buckets").select(F.col("p").alias("hp"), F.col("key").alias("hkey"), F.ceil(F.col("size") / BUCKET).cast("int").alias("blocks")), 100_000)
    # A hot bucket becomes all pairs (i, j), i <= j, of its blocks; a row goes to the pairs that its own block is part of.
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    to = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(block, j).cast("long") * F.col("blocks") + F.greatest(block, j)))
    dealt = rows.join(hot, (F.col("p") == F.col("hp")) & (F.col("key") == F.col("hkey")), "left").select("p", "key", F.explode(to).alias("part"), "probe", "fp")
    placed = dealt.repartition("p", "key", "part").sortWithinPartitions("p", "key", "part", "probe")
    return placed.select(F.col("p").cast("long"), "key", "part", "probe", "fp").mapInArrow(lean(_verified(most_bits)), "u long, v long")


def near_groups(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to, itself included) of every row of docs.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one class, whatever the number
    of copies; only distinct ones are probed. Repeated rows give repeated results; a null doc_id is larger than any other;
    an empty table gives an empty result; columns besides doc_id and text are not read.
    """
    fps = written(fingerprints(docs), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("tl_n")), "classes")
    sizes = classes.agg(F.count("*").alias("n"), F.sum("tl_n").alias("rows")).first()
    if sizes["n"] < 2:
        return fps.join(F.broadcast(classes), "fp").select("doc_id", "fp", F.col("rep").alias("component_id"))  # one row at most
    roots = components(fingerprint_edges(classes, sizes["n"], most_bits)).withColumnRenamed("node", "fp")
    rooted = written(classes.join(roots, "fp", "left").select("fp", "rep", "tl_n", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("tl_n")), "least")
    ids = written(spread(rooted.select("fp", "root", F.col("tl_n").alias("copies")), least, "root", sizes["n"]).select("fp", "component_id", F.col("copies").alias("tl_n")), "ids")
    discard(classes, rooted, least)
    return spread(fps, ids, "fp", sizes["rows"]).select("doc_id", "fp", "component_id")


#: Dropped documents up to which their ids are broadcast; beyond, the anti join is by shuffle.
MOST_DROPPED = 200_000


def drop_near(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, all columns as they were.

    doc_id is the key: rows that share one are judged together, and of those that stay the one of the least text stays, then of
    the least row as JSON; rows without a doc_id are one such group, and go if their group has a doc_id. Null and empty texts
    are one group. An empty table gives an empty one.
    """
    groups = written(near_groups(docs, most_bits), "near-groups")
    dropped = groups.where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("tl_drop"))
    twice = groups.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("tl_twice")).agg(F.count("*").alias("n")).where("n > 1").select("tl_twice")
    left = packed(docs).join(small_side(written(dropped.distinct(), "dropped"), MOST_DROPPED), row("doc_id").eqNullSafe(F.col("tl_drop")), "left_anti")
    twice = written(twice, "repeated")
    if twice.isEmpty():
        return unpacked(left, docs.columns)
    again = small_side(twice, MOST_DROPPED)
    repeated = row("doc_id").eqNullSafe(F.col("tl_twice"))
    order = F.struct(row("text").alias("tl_text"), F.to_json("tl_row").alias("tl_json"))  # rows may hold maps, which have no order
    first = left.join(again, repeated, "left_semi").groupBy(row("doc_id").alias("tl_id")).agg(F.min_by("tl_row", order).alias("tl_row"))
    return unpacked(left.join(again, repeated, "left_anti").unionByName(first.select("tl_row")), docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; the cases of near_groups hold."""
    out = near_groups(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), "component_id")
