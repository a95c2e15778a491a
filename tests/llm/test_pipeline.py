"""The pipeline's stages: each decision takes effect on what its predecessor kept."""

import hashlib

import corpus_pipeline
from loomline.llm import decontam, near_dup

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DIR).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "bpe":
            assert docs.columns == columns and docs.schema == before.schema
        if name == "near_duplicates":
            assert near_dup.classes(docs).where("doc_id <> class_id").count() == 0
        if name == "suffix_dedup":
            assert docs.count() == before.count() and docs.selectExpr("sum(length(text))").first()[0] < before.selectExpr("sum(length(text))").first()[0]
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "benchmark_decontamination":
            assert decontam.scan(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.columns == ["doc_id", "ids", "decoded"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "benchmark_decontamination", "bpe"]
    again = corpus_pipeline.run(spark, DIR)
    digest = lambda df: hashlib.sha256("".join(sorted(f"{r.doc_id}{r.decoded}" for r in df.collect())).encode()).hexdigest()
    assert digest(again) == digest(docs)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing columns and empty tables: defined results, no failure."""
    item = " ".join(f"word{i}" for i in range(30))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0), (3, 0), (None, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, score string, value string, carried string"
    extra = ("fr", None, 3, "i", "h", "s", "v", "c")
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, other, *extra), (2, other, *extra), (2, other, *extra), (3, None, *extra), (4, "", *extra), (None, other, *extra), (None, None, *extra), (5, item, *extra), (6, "x " * 20000, *extra)]
    docs = spark.createDataFrame(rows, schema)
    for made, want in ((docs, {1, 3, 6, None}), (docs.limit(0), set())):
        out = made
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
            assert name == "bpe" or out.columns == docs.columns
        assert {r.doc_id for r in out.collect()} == want
