"""Document fingerprints by context-triggered piecewise hashing (operator 5).

A rolling hash over seven bytes sets chunk boundaries where it hits a residue of the block size; each chunk gives one
character, so an edit changes the characters of the chunks it touches and no others. A fingerprint holds the signatures at a
block size and its double; two fingerprints are compared by edit distance where they share a block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, modest_batches, ship, table

ship(__name__)

WINDOW = 7
MIN_BLOCK = 3
SIGNATURE = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte, a hash of it and the six before it."""
    x = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    plain, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):
        part = x[WINDOW - 1 - k : WINDOW - 1 - k + n]
        plain += part
        weighted += part * np.uint32(WINDOW - k)
        if 5 * k < 32:
            shifted ^= part << np.uint32(5 * k)
    return plain + weighted + shifted


def _signature(prefix: np.ndarray, down: np.ndarray, cuts: np.ndarray, most: int) -> str:
    """A character for each chunk that ends at a cut, and for what follows; the last takes in all chunks beyond most."""
    n = len(prefix) - 1
    ends = np.concatenate([cuts[: most - 1], [n]]) if not len(cuts) or cuts[: most - 1][-1] != n else cuts[: most - 1]
    starts = np.concatenate([[0], ends[:-1]])
    value = (prefix[ends] - prefix[starts]) * down[starts]
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return "".join(ALPHABET[i] for i in (value >> np.uint64(58)).tolist())


def fingerprint(text: str) -> str:
    """block size:signature:signature at twice the block size; equal texts have equal ones, and the empty text 3::."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{MIN_BLOCK}::"
    hashed = rolling(data) + np.uint32(1)
    block = MIN_BLOCK
    while block * SIGNATURE < n:
        block *= 2

    def cuts(size: int) -> np.ndarray:  # ends of chunks: hash + 1 is a multiple of 3 * 2**k
        at = np.flatnonzero((hashed & np.uint32(size // MIN_BLOCK - 1)) == 0)
        return at[hashed[at] % MIN_BLOCK == 0] + 1

    found = cuts(block)
    while len(found) < SIGNATURE // 2 - 1 and block > MIN_BLOCK:
        block //= 2
        found = cuts(block)
    up, down = _power(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    return f"{block}:{_signature(prefix, down, found, SIGNATURE)}:{_signature(prefix, down, cuts(2 * block), SIGNATURE // 2)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _squeezed(s: str) -> str:
    """Runs of one character shortened to three: long runs say little."""
    out = s[:3]
    for c in s[3:]:
        if not c == out[-1] == out[-2] == out[-3]:
            out += c
    return out


def _like(a: str, b: str) -> float:
    """1 less the edit distance (insertions and deletions) over the summed length; 0 without a common run of WINDOW."""
    a, b = _squeezed(a), _squeezed(b)
    k = min(WINDOW, len(a), len(b))
    if not k or not {a[i : i + k] for i in range(len(a) - k + 1)} & {b[i : i + k] for i in range(len(b) - k + 1)}:
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """From 0 to 1; 0 if the block sizes have no signature in common, 1 for equal fingerprints."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        return max(_like(x1, y1), _like(x2, y2))
    if bx == 2 * by:
        return _like(x1, y2)
    return _like(x2, y1) if by == 2 * bx else 0.0


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _deal_rows(bounds: list[int], halo: dict[int, int]):
    """(bucket, halo, place, tie, packed text): rows by range of doc_id, and the first of each bucket also to the one above it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        edges = np.array(bounds, np.int64)
        for b in batches:
            out: list[tuple] = []
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                place = -(1 << 63) if doc_id is None else doc_id
                row = (doc_id, place, hashlib.blake2b(raw, digest_size=8).digest(), pack(raw))
                out.append((int(np.searchsorted(edges, place)), 0, *row))
                if place in halo:
                    out.append((halo[place], 1, *row))
            kinds = (pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "halo", "doc_id", "place", "tie", "packed"])

    return rows


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside the one after it, from rows sorted by bucket, with the bucket's halo last."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held = None  # bucket, doc_id, text, fingerprint
    for b in batches:
        out = []
        for bucket, halo, doc_id, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            if held is None and halo:
                continue
            text = unpack(packed.as_py()).decode("utf-8", "surrogatepass")
            fp = fingerprint(text)
            if held is not None and held[0] == bucket:
                other = edited(held[2], text)
                other_fp = fingerprint(other)
                sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[1], len(held[2]), sha, held[3], other_fp, likeness(held[3], other_fp), likeness(held[3], fp)))
            held = None if halo else (bucket, doc_id, text, fp)
        cols = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, that of the edited text, its hash, and the likeness to it and to the next document's.

    The next document is the one of the next smaller doc_id, and the first after the last. Texts are dealt out once, by ranges
    of doc_id; of each range the document that the range above needs is sent there too. Null texts count as empty, a null
    doc_id comes last, repeated doc_ids follow each other by a hash of their texts, a single row is its own next one, and an
    empty table gives an empty one. Columns besides doc_id and text are not read. doc_id is an integer, and the key: the rows of
    one doc_id, or without any, are in one range.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = own.agg(F.percentile_approx(place, [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q")).first()["q"] or []
    bounds = sorted(set(cuts))
    # One row a range: at most as many as there are shuffle partitions.
    bucket = F.lit(0)
    if bounds:
        bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < place))
    # The planner's own partition of a bucket is the bucket: none shares a task with another.
    most = [(r["bucket"], r["top"]) for r in own.groupBy(bucket.alias("bucket")).agg(F.max(place).alias("top")).orderBy("bucket").collect()]
    halo = {top: most[(i + 1) % len(most)][0] for i, (_, top) in enumerate(most)}
    rows = own.mapInArrow(lean(_deal_rows(bounds, halo)), "bucket int, halo byte, doc_id long, place long, tie binary, packed binary")
    placed = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "halo", F.desc("place"), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select("bucket", "halo", "doc_id", "packed").mapInArrow(lean(_fingerprint_rows), schema)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside its edited text and the next; the cases of neighbours hold."""
    return neighbours(table(spark, sf_dir, "documents"))
