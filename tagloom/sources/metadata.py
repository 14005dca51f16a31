"""Nested upstream metadata as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STATUS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
_TIMES = T.MapType(T.StringType(), T.StructType([T.StructField("time_imported", T.LongType())]))

SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("mime", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()), T.StructField("duration", T.LongType()), T.StructField("has_audio", T.BooleanType()),
    T.StructField("blurhash", T.StringType()), T.StructField("known_urls", T.ArrayType(T.StringType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StructType([T.StructField("storage_tags", _STATUS), T.StructField("display_tags", _STATUS)]))),
    T.StructField("file_services", T.StructType([T.StructField("current", _TIMES), T.StructField("deleted", _TIMES)])),
    T.StructField("notes", T.MapType(T.StringType(), T.StringType())),
])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON object a line, with the schema fixed so that nothing is inferred."""
    return spark.read.schema(SCHEMA).json(path)


def parse_metadata(raw: DataFrame, col: str = "value") -> DataFrame:
    """The same from a column of JSON text; rows that aren't objects are dropped."""
    return raw.select(F.from_json(col, SCHEMA).alias("m")).where("m.file_id IS NOT NULL").select("m.*")


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, hash) of search results: {file_ids: [...], hashes: [...]} objects, matched by place."""
    rows = spark.read.schema("file_ids array<long>, hashes array<string>").json(path)
    return rows.select(F.explode(F.arrays_zip("file_ids", "hashes")).alias("z")).select(F.col("z.file_ids").alias("file_id"), F.col("z.hashes").alias("hash"))


def array_relation(spark: SparkSession, names: list[str], *columns: list) -> DataFrame:
    """Arrays of equal length as a relation with their order in ord."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*columns, strict=True))], ["ord", *names])
