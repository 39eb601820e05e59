"""Documents of a corpus are dealt to all cores, however few bytes their files have."""

from memweave.operators import corpus


def test_documents_are_dealt_to_all_cores(spark, monkeypatch):
    files, real = {}, corpus.materialize

    def keep(df, label):
        out = real(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(corpus, "materialize", keep)
    docs = spark.range(0, 200, 1, 1).selectExpr("'c' AS corpus_id", "concat('m', id, '.py') AS filename", "'import os' AS content")
    none = spark.createDataFrame([], "uuid string, content string, node_type string, user_id string, weight double, document_id string")
    corpus.ingest_corpus(docs, spark.createDataFrame([], "uuid string, content_hash string"), none, answers={})
    assert files["documents-to-do"] >= spark.sparkContext.defaultParallelism
