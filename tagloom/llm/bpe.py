"""BPE encoding and decoding through a table of distinct words (operator 1).

Words are what white space parts: no token of the vocabulary and no special string spans it. Each task splits its documents in
chunks and notes every text as codes of its chunk's distinct words. The words go to the part of the word table that a hash
assigns them to, where each distinct word is encoded once; ids come back to the chunks and are joined to the codes by
position. A chunk sends a word once however often it holds it, so frequent words don't skew the exchange. Decoding looks ids
up in the table of pieces, which has as many rows as the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, modest_batches, plain_scan, ship, table, written

ship(__name__)

#: A chunk ends after this many distinct words or characters.
CHUNK_WORDS, CHUNK_CHARS = 150_000, 32_000_000
#: Parts of the word table for each shuffle partition.
PARTS = 1
#: Unicode's white space; Python's own split() takes four separators more.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
MORE = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_words(text: str | None) -> list[str]:
    """The words of the whole text, in order, as they stand."""
    if not text:
        return []
    if MORE.search(text):
        return [w for w in WHITE.split(text) if w]
    return text.split()


#: What a worker has built from a tokenizer file's JSON.
_built: dict[str, object] = {}


def encode_words(config: str, words: list[str]) -> list[list[int]]:
    """The ids of each word, by the tokenizer file whose JSON is config; no words give no ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if config not in _built:
        tokenizer = Tokenizer.from_str(config)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _built[config] = tokenizer
    return [e.ids for e in _built[config].encode_batch_fast(words, add_special_tokens=False)]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**24, byte plane by byte plane, compressed."""
    import zstandard

    flat = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(flat))


def _unpacked(packed: bytes, n: int = 1) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], 8 * n
    for size in np.frombuffer(raw, "<i8", n).tolist():
        planes = np.frombuffer(raw, np.uint8, 3 * size, at).reshape(3, size).astype(np.uint32)
        out.append((planes[0] | planes[1] << 8 | planes[2] << 16).astype(np.int64))
        at += 3 * size
    return out


class _Chunk:
    """Documents in a row, their distinct words, and a key that tells the same documents from others."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.docs: list[tuple] = []
        self.digest, self.chars = hashlib.blake2b(digest_size=16), 0

    def add(self, doc_id, text: str | None) -> None:
        index = self.index
        words = split_words(text)
        self.docs.append((doc_id, np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))))
        self.digest.update(f"{doc_id}\0{len(text or '')}\0".encode() + (text or "").encode("utf-8", "surrogatepass"))
        self.chars += len(text or "")

    def full(self) -> bool:
        return len(self.index) >= CHUNK_WORDS or self.chars >= CHUNK_CHARS

    def ranks(self) -> np.ndarray:
        """Of each word, its place by frequency in the chunk: frequent words get small codes."""
        counts = np.bincount(np.concatenate([c for _, c in self.docs]), minlength=len(self.index))
        out = np.empty(len(counts), np.int64)
        out[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for b in batches:
        for doc_id, text in zip(b.column(0), b.column(1)):
            chunk.add(doc_id.as_py(), text.as_py())
            if chunk.full():
                yield chunk
                chunk = _Chunk()
    if chunk.docs:
        yield chunk


def _word_rows(parts: int):
    """(part, chunk, ranks, words): the words of a chunk that belong to a part of the word table, by rank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for chunk in _chunks(batches):
            ranks, words = chunk.ranks(), list(chunk.index)
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            part = np.fromiter((zlib.crc32(w) % parts for w in raw), np.int64, len(raw))
            order = np.lexsort((ranks, part))
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            own = [x for x in np.split(order, cuts) if len(x)]
            pack = zstandard.ZstdCompressor(level=3).compress
            yield pa.RecordBatch.from_arrays([
                pa.array([int(part[x[0]]) for x in own], pa.int32()),
                pa.array([chunk.digest.digest()] * len(own), pa.binary()),
                pa.array([_packed(np.diff(ranks[x], prepend=0)) for x in own], pa.binary()),
                pa.array([pack(b" ".join([raw[i] for i in x.tolist()])) for x in own], pa.binary()),
            ], names=["part", "chunk", "ranks", "words"])

    return rows


def _id_rows(config: str):
    """(chunk, doc, place, payload) with the ids of each row's words, from rows in order of part.

    A part's table of distinct words lives while its rows pass, and each word in it is encoded once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        part, known = None, {}
        for b in batches:
            for at, chunk, ranks, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if at != part:
                    part, known = at, {}
                words = unpack(packed.as_py()).decode("utf-8", "surrogatepass").split(" ")
                new = [w for w in words if w not in known]
                for lo in range(0, len(new), 10_000):
                    known.update(zip(new[lo : lo + 10_000], encode_words(config, new[lo : lo + 10_000])))
                found = [known[w] for w in words]
                lens = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for x in found for i in x), np.int64, int(lens.sum()))
                payload = _packed(np.cumsum(_unpacked(ranks.as_py())[0]), lens, flat)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary()), pa.array([0], pa.int8()), pa.array([payload], pa.binary())], names=["chunk", "kind", "payload"])

    return rows


def _code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, doc_id, payload): the codes of each text by position."""
    for chunk in _chunks(batches):
        ranks, key = chunk.ranks(), chunk.digest.digest()
        for lo in range(0, len(chunk.docs), 1000):
            docs = chunk.docs[lo : lo + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(docs), pa.binary()), pa.array([1] * len(docs), pa.int8()), pa.array([_packed(ranks[c]) for _, c in docs], pa.binary()), pa.array([d for d, _ in docs])], names=["chunk", "kind", "payload", "doc_id"])


def _joined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) from rows in order of chunk, its ids before its codes."""
    key, lens, base, flats, size = None, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    flat = None
    for b in batches:
        ids, out = [], []
        for chunk, kind, packed, doc_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
            if chunk != key:
                key, lens, base, flats, size, flat = chunk, np.full(0, -1, np.int64), np.zeros(0, np.int64), [], 0, None
            if kind == 0:
                ranks, n, own = _unpacked(packed.as_py(), 3)
                if len(ranks) and ranks[-1] >= len(lens):
                    grown = max(int(ranks[-1]) + 1, 2 * len(lens))
                    lens = np.concatenate([lens, np.full(grown - len(lens), -1, np.int64)])
                    base = np.concatenate([base, np.zeros(grown - len(base), np.int64)])
                lens[ranks], base[ranks] = n, size + np.cumsum(n) - n
                flats.append(own.astype(np.int32))
                size += len(own)
                continue
            if flat is None:
                flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
            code = _unpacked(packed.as_py())[0]
            n = lens[code]
            if len(n) and n.min() < 0:
                raise RuntimeError("a chunk has words without ids: its documents came in another order the second time")
            ends = np.cumsum(n)
            ids.append(doc_id)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(base[code] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.int32))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(3).type), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                ids, out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(3).type), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def word_table(texts: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(word, ids) of every distinct word of the column text."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        config = f.read()
    own = texts.select(F.lit(0).cast("long").alias("doc_id"), "text")
    rows = own.mapInArrow(lean(_word_rows(64)), "part int, chunk binary, ranks binary, words binary").repartition("part").sortWithinPartitions("part")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, seen = None, set()
        for b in batches:
            for at, packed in zip(b.column(0).to_pylist(), b.column(3)):
                if at != part:
                    part, seen = at, set()
                new = [w for w in zstandard.ZstdDecompressor().decompress(packed.as_py()).decode("utf-8", "surrogatepass").split(" ") if w not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array(encode_words(config, new), pa.list_(pa.int32()))], names=["word", "ids"])

    return rows.mapInArrow(lean(words), "word string, ids array<int>")


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row: what the tokenizers library gives for the whole text, without special tokens added.

    Null and empty texts have no ids. Rows are never dropped or merged; repeated rows give repeated results; an empty table an
    empty one. Columns besides doc_id and text are not read. tokenizer: path of the file on the driver; workers get its text.
    The documents are read twice and must come in the same order; what isn't a plain scan is written first.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        config = f.read()
    modest_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    own = own if plain_scan(own) else written(own, "texts")
    kind = own.schema["doc_id"].dataType.simpleString()
    parts = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = own.mapInArrow(lean(_word_rows(parts)), "part int, chunk binary, ranks binary, words binary")
    ids = words.repartition("part").sortWithinPartitions("part").mapInArrow(lean(_id_rows(config)), "chunk binary, kind byte, payload binary")
    codes = own.mapInArrow(lean(_code_rows), f"chunk binary, kind byte, payload binary, doc_id {kind}")
    both = ids.withColumn("doc_id", F.lit(None).cast(kind)).unionByName(codes)
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(lean(_joined_rows), f"doc_id {kind}, ids array<int>")


def piece_table(config: str) -> list[str]:
    """The piece of each id."""
    spec = json.loads(config)
    pieces = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [""] * (max(pieces.values()) + 1)
    for piece, i in pieces.items():
        out[i] = piece
    return out


def _decode_rows(pieces):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces.value
        for b in batches:
            ids, starts = np.asarray(b.column(1).flatten()), np.cumsum([0, *np.asarray(b.column(1).value_lengths().fill_null(0))])
            out = [" ".join(map(table.__getitem__, ids[lo:hi].tolist())) for lo, hi in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    return rows


def decode(ids: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the pieces of the ids, joined by a space, as the vocabulary has no decoder.

    The table of pieces has as many rows as the vocabulary, a proven bound, and is joined by broadcast. Null ids count as none;
    repeated rows give repeated results, an empty table an empty one.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        pieces = ids.sparkSession.sparkContext.broadcast(piece_table(f.read()))
    return ids.select("doc_id", "ids").mapInArrow(lean(_decode_rows(pieces)), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the text of rows (doc_id, ids, text); null ids count as none."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    listed = F.array_join(ids.cast("array<string>"), " ")
    return decoded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text as digests; the cases of encode and decode hold."""
    return digests(decode(encode(table(spark, sf_dir, "documents"))))
