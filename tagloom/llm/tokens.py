"""Token counts by a separator scan over flat token files (operator 6).

A flat token file is a run of token ids, two bytes each, with an end-of-document id after each document and no index. It is
read by byte ranges: each block's search for the separator is one vectorised comparison, and a prefix scan over block summaries
(tokens before, separators before, place of the last separator) stitches the documents that cross block boundaries.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import helper_path, lean, modest_batches, plain_scan, ship, table, written

ship(__name__)

END = 50256
#: Tokens in a block, blocks that a task reads, and blocks whose summaries are scanned as one group.
BLOCK = 1 << 19
TASK_BLOCKS = 32
GROUP = 512


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def _token_rows(vocabulary, pattern: str):
    """The ids of each text as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value, pattern).encode_to_numpy
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(x.as_py() or "", disallowed_special=()).astype("<u2").tobytes() for x in b.column(0)], pa.binary())], names=["tokens"])

    return rows


def write_token_files(docs: DataFrame) -> tuple[str, DataFrame]:
    """The folder of flat token files that docs are written to, one file a task, and (part, ordinal, doc_id) of what each holds.

    Spark's text sink writes the bytes as they are, with the separator's two bytes as the line end, so that lost tasks are
    repeated and half-written files are never seen. Places are those of a second scan of doc_id alone: docs are written as a
    table first, whose files come in the same parts and order both times.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    path, pattern = default_ranks()
    with open(path, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    folder = helper_path(spark, "token-files")
    tokens = docs.select("text").mapInArrow(lean(_token_rows(vocabulary, pattern)), "tokens binary").select(F.col("tokens").cast("string"))
    tokens.write.option("lineSep", END.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return folder, docs.select(F.spark_partition_id().cast("long").alias("part"), place.alias("ordinal"), "doc_id")


def byte_ranges(spark: SparkSession, path: str, width: int, block: int) -> DataFrame:
    """(file, block, start, size) of all files under path but hidden ones, in as many tasks as their sizes ask for.

    A file's length must be a multiple of the token's width. The driver lists names and sizes, and holds nothing else.
    """
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(at, True), []
    while listed.hasNext():
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            files.append((f.getPath().toString(), f.getLen()))
            if f.getLen() % width:
                raise ValueError(f"{f.getPath().toString()}: {f.getLen()} bytes are no whole number of tokens of {width}")
    step = width * block
    tasks = max(1, -(-sum(n for _, n in files) // (step * TASK_BLOCKS)))
    starts = spark.createDataFrame(files, "file string, bytes long").where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("start"))
    return starts.select("file", (F.col("start") / step).cast("long").alias("block"), "start", F.least(F.lit(step), F.col("bytes") - F.col("start")).alias("size")).repartition(tasks, "file", "block")


def _range_rows(dtype: str, end: int):
    """(file, block, n, at) of byte ranges of files, read one at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for b in batches:
            for file, block, start, size in zip(*(b.column(i).to_pylist() for i in range(4))):
                store, inner = FileSystem.from_uri(file)
                with store.open_input_file(inner) as f:
                    tokens = np.frombuffer(f.read_at(size, start), dtype)
                if tokens.nbytes != size:
                    raise OSError(f"{file}: {size} bytes expected at {start}, {tokens.nbytes} read")
                at = np.flatnonzero(tokens == end).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([at], pa.list_(pa.int32()))], names=["file", "block", "n", "at"])

    return rows


def file_lengths(spark: SparkSession, path: str, *, dtype: str = "<u2", end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the flat token files under path, of any size, read by byte ranges.

    Files are read where they lie, by any of pyarrow's file systems. The cases of stitched hold.
    """
    ranges = byte_ranges(spark, path, np.dtype(dtype).itemsize, block)
    return stitched(ranges.mapInArrow(lean(_range_rows(dtype, end)), "file string, block long, n long, at array<int>"))


def _scan_rows(dtype: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(p.as_py(), dtype) for p in b.column(2)]
            at = [np.flatnonzero(t == end).astype(np.int32) for t in tokens]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in tokens], pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["file", "block", "n", "at"])

    return rows


def document_lengths(blocks: DataFrame, *, dtype: str = "<u2", end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of flat token files given as rows (file, block, payload); as stitched."""
    kind = blocks.schema["file"].dataType.simpleString()
    return stitched(blocks.select("file", "block", "payload").mapInArrow(lean(_scan_rows(dtype, end)), f"file {kind}, block long, n long, at array<int>"))


def stitched(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) from block summaries (file, block, n, at): tokens, and places of separators, of each block.

    n_tokens leaves out the separator. Tokens after a file's last separator are a document without one; a file that ends in a
    separator has none. Two separators in a row are an empty document. A document may span any number of blocks; blocks come
    in any order. No blocks, or empty files, give no documents.
    """
    scanned = written(scanned, "separators").withColumn("grp", F.floor(F.col("block") / GROUP))
    # Prefix scan in two levels: over the groups of a file, then over the blocks of a group.
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    local = scanned.withColumn("tokens_in", before("n", inside)).withColumn("seps_in", before(F.size("at"), inside))
    local = local.withColumn("last_in", F.max(F.when(F.size("at") > 0, F.col("tokens_in") + F.element_at("at", -1))).over(inside))
    # The last separator of a group, seen from its start, needs the offsets inside it.
    groups = local.groupBy("file", "grp").agg(F.sum("n").alias("g_n"), F.sum(F.size("at")).alias("g_seps"), F.max(F.when(F.size("at") > 0, F.col("tokens_in") + F.element_at("at", -1))).alias("g_last"))
    across = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("g_tokens", before("g_n", across)).withColumn("g_before", before("g_seps", across))
    groups = groups.withColumn("g_prev", F.max(F.col("g_tokens") + F.col("g_last")).over(across)).select("file", "grp", "g_tokens", "g_before", "g_prev")
    joined = local.join(groups, ["file", "grp"])
    offset = F.col("g_tokens") + F.col("tokens_in")
    prev = F.coalesce(F.col("g_tokens") + F.col("last_in"), F.col("g_prev"), F.lit(-1))
    placed = joined.select("file", "n", "at", offset.alias("offset"), (F.col("g_before") + F.col("seps_in")).alias("seps"), (prev - offset).alias("prev"))
    docs = placed.select("file", "seps", "prev", "at", F.posexplode("at").alias("i", "here"))
    ended = docs.select("file", (F.col("seps") + F.col("i")).alias("ordinal"), (F.col("here") - F.coalesce(F.get("at", F.col("i") - 1).cast("long"), F.col("prev")) - 1).alias("n_tokens"))
    last = placed.groupBy("file").agg(F.sum("n").alias("n"), F.max(F.col("seps") + F.size("at")).alias("ordinal"), F.max(F.col("offset") + F.coalesce(F.try_element_at("at", F.lit(-1)).cast("long"), F.col("prev"))).alias("end"))
    open_ = last.select("file", "ordinal", (F.col("n") - F.col("end") - 1).alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(open_)


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of every row, counted in the token files that the documents were written to.

    Null and empty texts have no tokens. Repeated rows give repeated results, an empty table an empty one; columns besides
    doc_id and text are not read.
    """
    own = docs.select("doc_id", "text")
    own = own if plain_scan(own) else written(own, "texts")
    folder, places = write_token_files(own)
    lengths = written(file_lengths(docs.sparkSession, folder), "lengths").withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    # A part's separators are its rows, or the second scan came in other parts.
    held = places.groupBy("part").agg(F.count("*").alias("rows"))
    counted = lengths.groupBy("part").agg(F.count("*").alias("seps"), F.max("ordinal").alias("last"))
    if not held.join(counted, "part", "full_outer").where("NOT (rows <=> seps AND last = rows - 1)").isEmpty():
        raise RuntimeError("token files and documents differ: the documents came in other parts the second time")
    return lengths.select("part", "ordinal", "n_tokens").join(places, ["part", "ordinal"]).select("doc_id", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens; the cases of token_counts hold."""
    return token_counts(table(spark, sf_dir, "documents"))
