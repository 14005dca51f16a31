"""Language ID with language-bitmask n-gram filters (operator 10).

For each language, the n-grams that are typical of it go into a Bloom filter. The filters are bit-sliced: one table of
bitmasks, a bit a language, so that the conjunction of an n-gram's few slots gives all languages that hold it at once.
Popcounts per language over a text's n-grams, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, modest_batches, ship, table, written

ship(__name__)

#: Code points in an n-gram; words are set apart by one space.
NGRAM = 4
#: Least slots of the table, a power of two; it has SPARE or more for each n-gram of the largest filter. Slots of an n-gram.
SLOTS, SPARE, HASHES = 1 << 20, 16, 2
#: About the most labelled documents a language that the filters learn from, whole, in the order of a hash of doc_id: the
#: documented bound of the fit.
TRAIN_DOCS = 2_000
#: An n-gram is typical of the languages in which its share is at least this part of its largest share.
TYPICAL = 0.2

SLOT_A, SLOT_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(text: str) -> np.ndarray:
    """A 64-bit code of each n-gram of the lower-cased text; runs of anything but letters count as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(points)
    kept = np.where(letter, points, 32)
    run = ~letter
    kept = kept[~(run & np.concatenate([[False], run[:-1]]))] if len(kept) else kept
    kept = np.concatenate([[32], kept, [32]]).astype(np.uint64)
    if len(kept) < NGRAM + 1 and not letter.any():
        return np.zeros(0, np.uint64)
    if len(kept) < NGRAM:
        kept = np.concatenate([kept, np.full(NGRAM - len(kept), 32, np.uint64)])
    code = np.zeros(len(kept) - NGRAM + 1, np.uint64)
    for i in range(NGRAM):
        code = (code * np.uint64(0x100000001B3)) ^ kept[i : len(kept) - NGRAM + 1 + i]
    return code


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    low = ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90))
    high = points > 127
    if high.any():
        own, at = np.unique(points[high], return_inverse=True)
        low[high] = np.array([chr(c).isalpha() for c in own.tolist()])[at]
    return low


def slots(code: np.ndarray, size: int) -> list[np.ndarray]:
    """The HASHES slots of each n-gram in a table of size slots, a power of two."""
    mixed = code ^ (code >> np.uint64(29))
    return [((mixed * (SLOT_A if i == 0 else SLOT_B)) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64) for i in range(HASHES)]


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): a task's counts, summed before the shuffle."""
    held: dict[str, list[np.ndarray]] = {}

    def counted():
        for lang, parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    size = 0
    for b in batches:
        for lang, x in zip(b.column(0), b.column(1)):
            code = grams(x.as_py())
            size += len(code)
            held.setdefault(lang.as_py(), []).append(code)
        if size > 5_000_000:
            yield from counted()
            size = 0
    yield from counted()


def training_docs(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(lang, text) of a bounded sample, about TRAIN_DOCS documents a language at most, and the labelled documents of each.

    Which ones is decided by the smallest hashes of doc_id. Each language's bound is found on a histogram of 4096 hash
    ranges, so no language is gathered in one task.
    """
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(1 << 40)).alias("h"))
    width = (1 << 40) // 4096
    hist: dict[str, list[tuple[int, int]]] = {}
    for r in own.groupBy("lang", (F.col("h") / width).cast("int").alias("cell")).agg(F.count("*").alias("n")).orderBy("lang", "cell").collect():
        hist.setdefault(r["lang"], []).append((r["cell"], r["n"]))
    bound = []
    for lang, cells in hist.items():
        left, end = TRAIN_DOCS, 0
        for cell, n in cells:
            end = cell * width + (width if n <= left else width * left // n)
            left -= n
            if left <= 0:
                break
        bound.append((lang, end))
    sizes = {lang: sum(n for _, n in cells) for lang, cells in hist.items()}
    if not bound:
        return own.select("lang", "text").limit(0), sizes
    limits = F.broadcast(docs.sparkSession.createDataFrame(bound, "b_lang string, bound long"))  # a row a language
    return own.join(limits, (F.col("lang") == F.col("b_lang")) & (F.col("h") < F.col("bound"))).select("lang", "text"), sizes


class Filters:
    """The bit-sliced table, the languages in the order of their bits, and each filter's false-positive rate."""

    def __init__(self, langs: list[str], chosen: list[np.ndarray]):
        self.langs = langs
        self.words = max(1, (len(langs) + 63) // 64)
        size = max(SLOTS, 1 << (SPARE * max(map(len, chosen), default=1) - 1).bit_length())
        self.table = np.zeros((size, self.words), np.uint64)
        for i, code in enumerate(chosen):
            for s in slots(code, size):
                np.bitwise_or.at(self.table[:, i // 64], s, np.uint64(1 << (i % 64)))
        fill = np.array([((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false_rate = fill**HASHES
        self.share = np.ones(len(langs))
        self.first = 0

    def state(self) -> tuple:
        """Plain data for the workers: languages, table, false-positive rates, the share of n-grams that a filter covers, and
        the place of the language of most labelled documents."""
        return self.langs, self.table, self.false_rate, self.share, self.first

    def predict(self, text: str | None) -> tuple[str, float]:
        return decide(self.state(), text)


def popcounts(state: tuple, code: np.ndarray) -> np.ndarray:
    """n-grams of the text that each language holds, corrected for false positives."""
    langs, table_, false_rate = state[:3]
    held, *more = (table_[s] for s in slots(code, len(table_)))
    for x in more:
        held &= x
    out = np.zeros(len(langs))
    if table_.shape[1] == 1:  # by the distinct masks
        mask, n = np.unique(held[:, 0], return_counts=True)
        for i in range(len(langs)):
            out[i] = n[(mask >> np.uint64(i)) & np.uint64(1) == 1].sum()
    else:
        for i in range(len(langs)):
            out[i] = ((held[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).sum()
    return np.maximum((out - len(code) * false_rate) / (1 - false_rate), 0)


def decide(state: tuple, text: str | None) -> tuple[str, float]:
    """The language of the largest corrected popcount for its filter's coverage, and its part of the sum of all.

    Ties go to the first in alphabetical order. Without any known n-gram the language of most labelled documents is named, with
    score 0.
    """
    langs, share, first = state[0], state[3], state[4]
    code = grams(text) if text else np.zeros(0, np.uint64)
    if not len(code) or not langs:
        return "und", 0.0
    part = popcounts(state, code) / share
    best = int(np.argmax(part))
    total = part.sum()
    return (langs[best], float(part[best] / total)) if total > 0 else (langs[first], 0.0)


def fit(docs: DataFrame) -> Filters:
    """Filters from the (doc_id, text, lang) rows of docs with neither text nor language null.

    All counting is in Spark. The typical n-grams of the bounded sample reach the driver, all of them, and no others. A language
    whose texts have no letter is not learned.
    """
    modest_batches(docs.sparkSession)
    sample, sizes = training_docs(docs)
    counts = sample.mapInArrow(lean(_gram_rows), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))  # a row a language
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    typical = rate.join(top, "gram").where(F.col("rate") >= TYPICAL * F.col("top"))
    rows = typical.select("lang", "gram", "rate").orderBy("lang", "gram").toPandas()
    discard(counts)
    langs = sorted(rows["lang"].unique())
    out = Filters(langs, [rows.loc[rows["lang"] == x, "gram"].to_numpy(np.int64).view(np.uint64) for x in langs])
    out.share = np.array([max(rows.loc[rows["lang"] == x, "rate"].sum(), 1e-9) for x in langs])
    out.first = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i), default=0)
    return out


def _predict_rows(filters):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filters.value
        for b in batches:
            found = [decide(own, x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned; letters without a
    known n-gram get the language of most labelled documents with score 0. Repeated rows give repeated results, an empty table
    an empty one; columns besides doc_id and text are not read.
    """
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters.state())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_predict_rows(sent)), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; the cases of predict hold, and those without a doc_id are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
