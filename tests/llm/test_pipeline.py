import corpus_pipeline
from rejoinder.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert [n.split("_")[0] for n in names] == ["toxicity", "simhash", "benchmark", "source", "token"]
    seen = [ids]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(kept) <= seen[-1] and len(kept) > 0.5 * len(seen[-1])
        assert name == "source_mixing" or len(kept) == len(set(kept))
        seen.append(set(kept))
    assert seen[-1] == seen[-2]  # mixing loses nothing
    assert len(seen[3]) < len(seen[0])
    tokens = corpus_pipeline.write_tokens(spark, docs, FOLDER).orderBy("start").collect()
    assert len(tokens) == docs.count()
    assert [t["start"] for t in tokens] == [0, *[t["start"] + t["n_tokens"] for t in tokens][:-1]]


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.count() > 0


def test_empty_documents(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
