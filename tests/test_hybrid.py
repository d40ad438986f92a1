"""The hybrid ranks documents and questions that have no vector."""

import pytest

from rankloom.plans import catalogue


@pytest.mark.parametrize("name", ["rrf_hybrid", "candidate_limit"])
def test_bm25_sees_every_document_and_question(spark, tmp_path, name):
    docs = [(0, "apple pear"), (1, "plum cherry"), (2, "quince medlar"), (3, "grape melon"), (4, "fig date")]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "apple medlar"), (7, "grape")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (9, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.chunk_id): r.score for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    # Question 0: dense 0, 1; BM25 0, 2. Question 7 has no vector; document 9 is only a vector.
    want = {(0, 0): 2 / 61, (0, 1): 1 / 62, (0, 2): 1 / 62, (7, 3): 1 / 61}
    assert got == pytest.approx(want, abs=1e-8)
