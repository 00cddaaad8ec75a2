"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from cuespan.llm import jaccard, pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(ids) < docs.count() and out.where("n_tokens <> size(ids)").count() == 0
    first = corpus_pipeline.quality(spark, docs, SF)
    assert first.columns == docs.columns
    kept = docs.where(docs.doc_id.isin(sorted(ids)))
    assert jaccard.classes(kept).where("component <> id").count() == 0
    assert pii.report(corpus_pipeline.personal_data(spark, kept, SF)).where("n_email + n_ip + n_card + n_phone > 0").count() == 0


def test_defined_cases(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, a long text and clashing columns through all stages; then no rows."""
    from tokenizers import Tokenizer

    from cuespan.llm.common import local_file

    given = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    good = corpus_pipeline.quality(spark, given, SF).orderBy("doc_id").limit(3).collect()
    rows = [(r.doc_id, r.text, None, None, None) for r in good]
    rows += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, None, None, None, None), rows[0], (1002, " ".join(r.text for r in good) * 20, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "t", "th", "row", "spans", "comp", "key"):
        docs = docs.withColumn(name, docs.lang)
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, f"{tmp_path}/some")
        assert staged.columns == docs.columns, name
    kept = [(r.doc_id, r.text) for r in staged.collect()]
    plain = Tokenizer.from_file(local_file("word_bpe_49k.json"))
    plain.no_truncation(), plain.no_padding()
    out = [(r.doc_id, r.ids) for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()]
    assert sorted(out) == sorted((k, plain.encode(t, add_special_tokens=False).ids) for k, t in kept)
    ids = [k for k, _ in kept]
    assert ids.count(good[0].doc_id) == 2 and {good[1].doc_id, good[2].doc_id} <= set(ids) and not {1000, 1001, None} & set(ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
