"""The pipeline's stages against brute force on the smallest tables."""

import re

import corpus_pipeline
from test_operators import brute, check_packed


def plain(text):
    return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r.text for r in docs.collect()} if docs.columns == columns else None)
        out = stage(spark, docs, sf)
        assert out.columns == columns or name == "packing"
        docs = spark.createDataFrame(out.collect(), out.schema)
    start, good, unique, clean, kept = inputs
    assert len(start) > len(clean) > 0 and set(kept) < set(start)
    classes = brute(list(unique.items()))
    assert set(clean) == {c for _, c in classes.values()}
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(kept) == {i for i, t in clean.items() if not any(x in plain(t) for x in items)}
    packed = docs.toPandas()
    check_packed(packed, 4096)
    assert set(packed.doc_id) == set(kept) and packed.groupby("doc_id").length.sum().eq(
        packed.groupby("doc_id").doc_tokens.first()).all()
