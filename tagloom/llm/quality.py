"""Quality rules with thresholds learned from mergeable quantile sketches (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, modest_batches, packed, row, ship, small_side, table, unpacked, written

ship(__name__)

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_punct long, n_digits long"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())

#: The rates that get learned cutoffs: (name, SQL expression, whether small values are judged too).
METRICS = (
    ("symbol_rate", "n_symbols / greatest(word_chars, 1)", False),
    ("punct_rate", "n_punct / greatest(word_chars, 1)", True),
    ("digit_rate", "n_digits / greatest(word_chars, 1)", False),
    ("upper_rate", "n_upper / greatest(word_chars, 1)", False),
    ("dup_line_rate", "n_dup_lines / greatest(n_lines, 1)", False),
    ("repeat_rate", "n_repeat_words / greatest(n_words, 1)", False),
    ("word_length", "word_chars / greatest(n_words, 1)", True),
)
#: A sketch bin holds values within this share of each other; so is the relative error of its quantiles.
ACCURACY = 0.02
#: A value is far out if it lies this many distances of the quartiles beyond one of them, all on a logarithmic scale.
FENCE = 3.0
#: Values above this quantile of a large group are out in any case: bounded rates can lie in no far fence.
TAIL = 0.998
#: Fewer non-zero values than this leave the thresholds to the next coarser sketch; if that has too few, there are none.
LEAST_DOCS = 40


def _repeated(words: list[bytes]) -> int:
    """Words in windows that occur twice or more. Codes of 1, 2, 4 and 8 words are ranked exactly, by doubling."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while span < WINDOW:
        code = code[:-span] * (int(code.max()) + 1) + code[span:]
        _, code, counts = np.unique(code, return_inverse=True, return_counts=True)
        if len(counts) == len(code):
            return 0
        span *= 2
    twice = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[code] > 1)
    np.add.at(twice, starts, 1)
    np.add.at(twice, starts + WINDOW, -1)
    return int((np.cumsum(twice)[:n] > 0).sum())


def text_features(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at exactly U+0020 and U+0009 to U+000D
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, PUNCT)),
        len(raw) - len(raw.translate(None, DIGITS)),
    )


def _feature_rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        rows = np.array([text_features(x.as_py()) for x in batch], np.int64).reshape(-1, len(names))
        yield pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(names))], names=names)


def features(text: Column) -> Column:
    """A struct of counts over the whole text, Arrow batch by Arrow batch; a null text counts as empty.

    Called non-deterministic so that the planner computes it once, where it stands, and not again in each filter above.
    """
    from pyspark.sql.functions import arrow_udf

    return arrow_udf(f"struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>")(_each).asNondeterministic()(text)


def _each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from lean(_feature_rows)(batches)


_each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def base_failed(f: str = "") -> Column:
    return F.expr(f"{f}n_words < 20 OR 100 * {f}n_repeat_words > 30 * {f}n_words")


def sketches(rows: DataFrame) -> DataFrame:
    """Mergeable sketches of the non-zero values: counts by (lang, source, metric, bin) of logarithmic bins.

    Counts add up in any order, so partial sketches of tasks, days or tables merge exactly, and the result does not depend
    on the order of tasks. One sketch has at most about ln(range) / ACCURACY bins.
    """
    metric = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.expr(f"CAST({e} AS DOUBLE)").alias("v")) for n, e, _ in METRICS])).alias("m")
    bins = rows.select("lang", "source", metric).where("m.v > 0").select("lang", "source", "m.metric", F.ceil(F.log("m.v") / math.log(_gamma())).cast("long").alias("bin"))
    return bins.groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def _gamma() -> float:
    """The ratio of the bounds of a bin."""
    return (1 + ACCURACY) / (1 - ACCURACY)


def cutoffs(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, level, n, low, high) for each language and source, each language, and all documents (nulls).

    Both come from the sketch alone: high is the least of the far fence above the upper quartile and the TAIL quantile, low the
    far fence below the lower quartile. The distance of the quartiles counts as one bin where they share one. Values are the
    upper bounds of bins (the lower one for low), so that nothing is out for being rounded.
    """
    none = F.lit(None).cast("string")
    at = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("l"), source.alias("s"))
    levels = F.explode(F.array(at(2, F.col("lang"), F.col("source")), at(1, F.col("lang"), none), at(0, none, none))).alias("at")
    merged = sketch.select(levels, "metric", "bin", "n").groupBy("at.level", "at.l", "at.s", "metric", "bin").agg(F.sum("n").alias("n"))
    # A sketch has a bounded number of bins, whatever the number of documents: it is one short list.
    whole = merged.groupBy("level", "l", "s", "metric").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n"))

    def quantile(q: float) -> Column:
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["bin"].isNull() & (acc["seen"] + x["n"] >= F.col("n") * q), x["bin"]).otherwise(acc["bin"]).alias("bin"))
        zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
        return F.aggregate("bins", zero, step)["bin"]

    value = lambda bin_: F.pow(F.lit(_gamma()), bin_) * (1 + 1e-9)
    marks = whole.select("level", "l", "s", "metric", "n", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"), quantile(TAIL).alias("tail"))
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(1))
    low = F.pow(F.lit(_gamma()), F.col("q1") - 1 - reach) * (1 - 1e-9)
    return marks.select("level", "l", "s", "metric", "n", low.alias("low"), value(F.least(F.col("q3") + reach, F.col("tail"))).alias("high"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row (lang, source) -> map metric -> (low, high, level), from the finest sketch of at least LEAST_DOCS values."""
    sketch = written(sketches(rows), "sketches")
    cuts = written(cutoffs(sketch).where(F.col("n") >= LEAST_DOCS), "cutoffs")
    groups = rows.select("lang", "source").distinct()
    out = groups.select("lang", "source", F.explode(F.array(*[F.lit(n) for n, _, _ in METRICS])).alias("metric"))
    for level, on in ((2, ("l", "s")), (1, ("l",)), (0, ())):
        part = cuts.where(F.col("level") == level).select(F.col("l").alias(f"l{level}"), F.col("s").alias(f"s{level}"), F.col("metric").alias(f"m{level}"), F.struct("low", "high", "level").alias(f"c{level}"))
        cond = F.col("metric") == F.col(f"m{level}")
        for x, c in (("l", "lang"), ("s", "source")):
            if x in on:
                cond = cond & F.col(c).eqNullSafe(F.col(f"{x}{level}"))
        out = out.join(part, cond, "left").drop(f"l{level}", f"s{level}", f"m{level}")
    out = out.select("lang", "source", "metric", F.coalesce("c2", "c1", "c0").alias("cut")).where("cut IS NOT NULL")
    return out.groupBy(F.col("lang").alias("q_lang"), F.col("source").alias("q_source")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "cut"))).alias("q_cutoffs"))


def within(cutoffs_col: str = "q_cutoffs", f: str = "") -> Column:
    """True where every rate is at most its upper cutoff and, if it is not zero and small values are judged, at least its lower."""
    ok = F.lit(True)
    for name, expr, both in METRICS:
        for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_digits"):
            expr = expr.replace(x, f"{f}{x}") if f else expr
        rate, cut = F.expr(f"CAST({expr} AS DOUBLE)"), F.element_at(cutoffs_col, F.lit(name))
        ok = ok & (rate <= F.coalesce(cut["high"], F.lit(float("inf"))))
        if both:
            ok = ok & ((rate == 0) | (rate >= F.coalesce(cut["low"], F.lit(0.0))))
    return ok


#: Languages times sources that are joined by broadcast; beyond, the join is by shuffle.
MOST_GROUPS = 50_000


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the features, base_failed and kept of every document.

    Learns cutoffs from the documents that pass the base rule, per language and source (nulls are a group of their own; groups
    with few non-zero values fall back to the language, then to all documents, then to none), and joins them back. Null and
    empty texts have no words and so fail the base rule. A value equal to a cutoff is within. Repeated rows count and give
    repeated results, an empty table an empty one; further columns are not read.
    """
    modest_batches(docs.sparkSession)
    own = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), features(F.col("text")).alias("f")).select("doc_id", "lang", "source", "f.*")
    rows = written(own.withColumn("base_failed", base_failed()), "features")
    cuts = small_side(thresholds(rows.where(~F.col("base_failed"))), MOST_GROUPS)
    joined = rows.join(cuts, rows["lang"].eqNullSafe(F.col("q_lang")) & rows["source"].eqNullSafe(F.col("q_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within())


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that quality_rules keeps, all columns as they were; its cases hold.

    Rows are written once beside their features, which are computed once; texts are not shuffled.
    """
    modest_batches(docs.sparkSession)
    with_f = packed(docs).select("tl_row", features(row("text")).alias("tl_f"), row("lang").cast("string").alias("lang"), row("source").cast("string").alias("source"))
    rows = written(with_f.where(~base_failed("tl_f.")), "features")
    cuts = small_side(thresholds(rows.select("lang", "source", "tl_f.*")), MOST_GROUPS)
    joined = rows.join(cuts, F.col("lang").eqNullSafe(F.col("q_lang")) & F.col("source").eqNullSafe(F.col("q_source")), "left")
    return unpacked(joined.where(within(f="tl_f.")), docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdicts; the cases of quality_rules hold."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
