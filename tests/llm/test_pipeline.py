import corpus_pipeline
from helpers import DOCS
from test_jaccard import brute

from tickloom.llm import decontam, line_crf, packing, quality_rules


def one_of_each(docs):
    """The first of each group of brute-force Jaccard similarity, by doc_id."""
    held = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    tops = brute([t for _, t in held])
    return docs.where(docs.doc_id.isin([held[i][0] for i in sorted(set(tops))]))


def test_stages_keep_the_columns_and_equal_the_operators(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    want = {
        "quality rules": lambda d: quality_rules.quality_rules(d, labels).where("kept"),
        "quality classifier": lambda d: line_crf.score(d, line_crf.train(docs, labels)).where("predicted = 1"),
        # the stage takes five words and a similarity of 0.8, not the 2 bits of op10's query
        "SimHash near-dedup": one_of_each,
        "benchmark decontamination": lambda d: d.join(decontam.contaminated(d, bench), "doc_id", "left_anti"),
    }
    for name, operator in want.items():
        out = stages[name](spark, kept, sf_dir).cache()
        assert out.columns == docs.columns and ids(out) == ids(operator(kept))
        assert 0 < out.count() <= kept.count()
        kept = out
    packed = stages["best-fit packing"](spark, kept, sf_dir)
    assert ids(packed.where("piece = 0")) == ids(kept)
    assert corpus_pipeline.run(spark, sf_dir).count() == packing.pack(kept).count()


def test_classifier_rejects_what_rules_would_have(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").select(docs.columns)
    bad = docs.join(labels.where("quality = 0"), "doc_id", "left_semi").select(docs.columns)
    stage = dict(corpus_pipeline.STAGES)["quality classifier"]
    assert stage(spark, good, sf_dir).count() >= 0.95 * good.count()
    assert stage(spark, bad, sf_dir).count() <= 0.1 * bad.count()


def test_stages_take_empty_and_awkward_tables(spark):
    from helpers import awkward

    sf_dir = "/root/testdata/sf0.001"
    for docs in (spark.createDataFrame([], DOCS), awkward(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
            stage(spark, docs, sf_dir).count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.columns == packing.PIECES.replace(" long", "").replace(" int", "").split(", ")[:5] + ["sequence_id", "offset"]
        assert packed.where("piece = 0").count() == docs.count()
