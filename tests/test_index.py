"""The corpus index is rebuilt when its input or its parameters change."""
from simcheck import params as P
from simcheck.plans import index as IX
from simcheck.session import scratch_dir


def test_location_follows_files_and_parameters(spark, monkeypatch):
    sf = scratch_dir(spark, "test-index")
    rows = lambda n: spark.createDataFrame([(n, " ".join(["word"] * 12) + ".", "en", "s", 60)],
                                           "doc_id long, text string, lang string, source string, n_chars long")
    rows(1).write.parquet(f"{sf}/documents.parquet")
    first = IX.corpus_index_path(spark, sf)
    assert IX.corpus_index_path(spark, sf) == first
    assert [r.doc_id for r in IX.corpus_sentences(spark, sf).collect()] == [1]
    rows(2).write.mode("append").parquet(f"{sf}/documents.parquet")
    assert IX.corpus_index_path(spark, sf) != first
    assert sorted(r.doc_id for r in IX.corpus_sentences(spark, sf).collect()) == [1, 2]
    now = IX.corpus_index_path(spark, sf)
    monkeypatch.setattr(P, "MIN_SENTENCE_WORDS", 20)
    assert IX.corpus_index_path(spark, sf) != now


def test_sentences_alone_write_no_vectors(spark):
    sf = scratch_dir(spark, "test-index")
    text = " ".join(["word"] * 12) + ". " + " ".join(["other"] * 11) + "."
    spark.createDataFrame([(n, text, "en", "s", 60) for n in (5, 3, 4)], "doc_id long, text string, lang string, source string, "
                          "n_chars long").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    got = IX.corpus_sentences(spark, sf)
    assert not IX._exists(spark, IX.corpus_index_path(spark, sf))
    assert got.columns == ["doc_id", "sentence_index", "sentence"] and got.count() == 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, IX.corpus_table(spark, sf).select(got.columns).collect()))


def test_matches_need_no_stored_vectors(spark):
    """F16: matching a text encodes the sentences where they are scored, so no vector of the corpus is written."""
    from simcheck.plans import check as C
    from simcheck.plans.q_pairs import doc_best
    sf = scratch_dir(spark, "test-index")
    text = " ".join(f"word{i}" for i in range(12)) + "."
    spark.createDataFrame([(n, text, "en", "s", 60) for n in (5, 3)], "doc_id long, text string, lang string, source string, "
                          "n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, text.upper()), (2, text.replace("word", "x"))], "item_id long, text string").write.parquet(
        f"{sf}/benchmark.parquet")
    assert [tuple(r) for r in C.hits(spark, sf).collect()] == [(1, 0, 3, 0, 1.0)]
    assert sorted((r.item_id, r.doc_id, r.score) for r in doc_best(spark, sf).collect()) == [(1, 3, 1.0), (1, 5, 1.0)]
    assert not IX._exists(spark, IX.corpus_index_path(spark, sf))
