"""The pipeline's stages on a small table."""

import corpus_pipeline
from placeweave.llm.queries import ORACLES, QUERIES


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    passage = " ".join(f"bench{i}" for i in range(20))
    base = " ".join(f"word{i}" for i in range(60))
    texts = [
        base, base + " x", "other text of some words " + passage, "token = ownownownown77 and some more words here",
        None, "", "clean and short",
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append(sorted(r.doc_id for r in docs.collect()))
    assert left == [[0, 1, 2, 3, 4, 5, 6], [0, 2, 3, 4, 5, 6], [0, 3, 4, 5, 6], [0, 3, 4, 5, 6]]
    assert {r.doc_id: r.text for r in docs.collect()}[3] == "<secret> and some more words here"
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == left[-1]
