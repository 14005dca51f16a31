"""The pipeline on the smallest tables, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from tagloom.llm import bpe, quality, simhash

from . import cases


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        assert i == len(corpus_pipeline.STAGES) - 1 or after.columns == columns
        kept[name] = (docs, after)
        docs = after
    before, after = kept["quality rules"]
    good = {r["doc_id"] for r in quality.quality_rules(before).where("kept").collect()}
    assert good == {r["doc_id"] for r in after.collect()} and len(good) > 100
    before, after = kept["SimHash near-dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    left = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in after.collect()}
    assert all((a ^ b).bit_count() > 4 for i, a in left.items() for j, b in left.items() if i < j)
    for i, t in texts.items():  # every dropped document links, if through others, to one that stays
        assert i in left or any((simhash.fingerprint(t) ^ simhash.fingerprint(u)).bit_count() <= 4 for j, u in texts.items() if j != i)
    before, after = kept["PII"]
    assert after.count() == before.count() and not any(cases.pii_spans(r["text"]) for r in after.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = kept["mixing sources to target weights"]
    assert {(r["doc_id"], r["text"]) for r in after.collect()} <= {(r["doc_id"], r["text"]) for r in before.collect()}
    before, after = kept["BPE encoding and decoding"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    exp = [(r["doc_id"], ids := t.encode(r["text"], add_special_tokens=False).ids, t.decode(ids, skip_special_tokens=False)) for r in before.collect()]
    assert sorted((r["doc_id"], list(r["ids"]), r["text"]) for r in after.collect()) == sorted(exp)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_hard_cases(spark, tmp_path):
    """Null, empty and long texts, repeated rows, extra columns of clashing names; then none of it."""
    cases.edge_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept and kept <= {r[0] for r in cases.rows()} and all(r["ids"] for r in out)
    cases.empty_docs(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
