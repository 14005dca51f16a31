"""Vector and bit-string expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def valid_vector(v: Column, dimensions: int | Column) -> Column:
    """Whether v has the dimensions and only finite numbers."""
    return (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def parse_vector(text: Column) -> Column:
    """'[1,2.5]' as an array of floats."""
    return F.from_json(text, "array<float>")


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def median_bits(v: Column) -> Column:
    """A 63-bit hash of 64 numbers: without the first, bit 62 - i says whether number i is above the median of the 63."""
    rest = F.slice(v, 2, 63)
    bit = lambda mid: lambda x, i: F.when(x > mid, F.call_function("shiftleft", F.lit(1).cast("long"), 62 - i)).otherwise(F.lit(0).cast("long"))
    # An array of one element binds the median, which would else be sorted out anew for each number.
    of_median = F.transform(F.array(F.get(F.array_sort(rest), F.lit(31))), lambda mid: F.aggregate(F.transform(rest, bit(mid)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.get(of_median, F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _dct_matrix(n: int = 32, keep: int = 8) -> np.ndarray:
    k, i = np.arange(keep)[:, None], np.arange(n)[None, :]
    scale = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    return scale * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def dct_hash(gray: np.ndarray) -> int:
    """63 bits of a 32 x 32 grey image: the low 8 x 8 frequencies without the constant one, each against their median."""
    m = _dct_matrix(gray.shape[0])
    low = (m @ gray.astype(np.float64) @ m.T).ravel()[1:]
    mid = np.sort(low)[31]
    return sum(1 << (62 - i) for i, x in enumerate(low) if x > mid)


def image_hashes(images: DataFrame) -> DataFrame:
    """(id, phash) of rows (id, pixels): 1,024 grey bytes, row by row; null where there are more or fewer."""

    dct = _dct_matrix()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                raw = x.as_py()
                if raw is None or len(raw) != 1024:
                    out.append(None)
                    continue
                low = (dct @ np.frombuffer(raw, np.uint8).reshape(32, 32).astype(np.float64) @ dct.T).ravel()[1:]
                mid = np.sort(low)[31]
                out.append(sum(1 << (62 - i) for i, v in enumerate(low) if v > mid))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["id", "phash"])

    return images.select("id", "pixels").mapInArrow(rows, f"id {images.schema['id'].dataType.simpleString()}, phash long")
