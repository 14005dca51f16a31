"""BPE and token files (operators 1 and 6)."""

from __future__ import annotations

import numpy as np
import pytest

from tagloom.llm import bpe, tokens

from . import cases


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe(spark):
    t = tokenizer()
    texts = [(r[0], r[1]) for r in cases.rows()] + [(500, "a<|endoftext|>B <|startoftext|> ΑΣ don't I'LL ＡＢ ½"), (501, "\u2003x\u3000y\u200bz")]
    docs = spark.createDataFrame([(*r, "n") for r in texts], "doc_id long, text string, ids string").repartition(3)
    ids = bpe.encode(docs)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in ids.collect())
    assert got == sorted((str(i), t.encode(x or "", add_special_tokens=False).ids) for i, x in texts)
    text = sorted((str(r["doc_id"]), r["text"]) for r in bpe.decode(ids).collect())
    assert text == sorted((i, t.decode(x, skip_special_tokens=False)) for i, x in got)
    rows = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(bpe.decode(ids)).collect())
    assert rows == sorted((i, len(x), cases.sha(" ".join(map(str, x))), cases.sha(t.decode(x, skip_special_tokens=False))) for i, x in got)
    assert bpe.encode(cases.empty_docs(spark)).count() == 0


def test_word_table_has_each_word_once(spark):
    docs = cases.edge_docs(spark)
    words = [r["word"] for r in bpe.word_table(docs).collect()]
    assert len(words) == len(set(words)) and set(words) == {w for r in cases.rows() for w in bpe.split_words(r[1])}


def test_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 5)
    t = tokenizer()
    texts = [(i, cases.prose(i, 30)) for i in range(60)]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in texts}


def brute(flat, end):
    out, n = [], 0
    for x in flat:
        if x == end:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + ([n] if n else [])


def test_separator_scan(spark, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 4)
    rng = np.random.default_rng(2)
    files = {f: rng.choice([7, 8, 9, 3], size=n, p=[0.4, 0.3, 0.25, 0.05]).astype("<u2") for f, n in ((0, 1000), (1, 64), (2, 1), (3, 640))}
    files[4], files[5], files[6] = np.full(300, 7, "<u2"), np.full(40, 3, "<u2"), np.array([3], "<u2")
    rows = [(f, b, bytearray(x[b * 16 : b * 16 + 16].tobytes())) for f, x in files.items() for b in range(-(-len(x) // 16))]
    df = spark.createDataFrame(rows, "file long, block long, payload binary").repartition(5)
    got = {}
    for r in tokens.document_lengths(df, end=3).orderBy("file", "ordinal").collect():
        got.setdefault(r["file"], []).append(r["n_tokens"])
    assert got == {f: brute(x.tolist(), 3) for f, x in files.items()}


def test_raw_files(spark, tmp_path):
    """Files of several lengths, by blocks of two and three tokens, whose borders fall on and beside separators."""
    rng = np.random.default_rng(5)
    files = {"a": np.array([5, 6, 3, 3, 7, 8, 9, 3, 1], "<u2"), "b": np.array([3], "<u2"), "c": np.zeros(0, "<u2"), "d": np.array([772, 3, 772, 1027], "<u2"), "e": rng.choice([3, 4, 771], 200).astype("<u2")}
    for name, x in files.items():
        (tmp_path / f"{name}.bin").write_bytes(x.tobytes())
    for block in (2, 3, 1 << 19):
        got = {}
        for r in tokens.file_lengths(spark, f"file://{tmp_path}", end=3, block=block).orderBy("file", "ordinal").collect():
            got.setdefault(r["file"].rsplit("/")[-1][0], []).append(r["n_tokens"])
        assert got == {f: brute(x.tolist(), 3) for f, x in files.items() if len(x)}
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError, match="whole number"):
        tokens.file_lengths(spark, f"file://{tmp_path}")


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """One sparse file larger than an array of the JVM, read in many tasks."""
    size, ends = 2_300_000_000, [0, 524_287, 524_288, 1_048_577, 1_149_999_999 - 7, 1_149_999_990 + 9]
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
        for at in ends:
            f.seek(2 * at)
            f.write(tokens.END.to_bytes(2, "little"))
    assert tokens.byte_ranges(spark, str(tmp_path), 2, tokens.BLOCK).rdd.getNumPartitions() > 60
    got = [r["n_tokens"] for r in tokens.file_lengths(spark, f"file://{tmp_path}").orderBy("ordinal").collect()]
    assert got == [b - a - 1 for a, b in zip([-1, *ends], ends)]


def test_token_counts(spark):
    path, pattern = tokens.default_ranks()
    with open(path, "rb") as f:
        enc = tokens._encoding(f.read(), pattern)
    docs = cases.edge_docs(spark)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokens.token_counts(docs).collect())
    assert got == sorted((str(r[0]), len(enc.encode_ordinary(r[1] or ""))) for r in cases.rows())
    assert tokens.token_counts(cases.empty_docs(spark)).count() == 0
