"""Approximate search recall against the exact kernels (SURVEY 5(c))."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.operators import ann as A
from simcheck.operators.similarity import nearest
from simcheck.session import scratch_dir
from simcheck.sources.tables import load

SMOKE = "/root/testdata/sf0.001"


def test_ids_of_long_documents_stay_apart(spark):
    """Keys are (document, index); no packed number can make two of them meet."""
    rows = [(9_500_000_123, 999_999, [1.0, 0.0]), (9_500_000_124, 0, [1.0, 0.0]), (1, 1_000_000, [0.0, 1.0]), (2, 0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "doc_id long, sentence_index int, vec array<float>")
    got = {tuple(r)[:4] for r in A.lsh_pairs(df, "doc_id", "sentence_index", 0.9).collect()}
    assert got == {(9_500_000_123, 999_999, 9_500_000_124, 0), (1, 1_000_000, 2, 0)}


@pytest.fixture(scope="module")
def stored(spark):
    rows = load(spark, SMOKE, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    store = A.VectorStore(spark, scratch_dir(spark, "vectors"), "vec_id")
    store.train(rows.where("vec_id % 3 > 0"), nlist=64)
    store.add(0, rows.where("vec_id % 3 > 0"))
    store.add(1, rows.where("vec_id % 3 = 0"))
    return rows, store


def test_ivf_recall_in_a_quarter_of_the_cells(spark):
    from simcheck.plans import q_ml
    found = q_ml.ann_recall(spark, SMOKE).first()
    assert found["recall"] >= 0.9 and found["n_exact"] > 0


def test_every_vector_is_stored_once_in_its_nearest_cell(stored):
    rows, store = stored
    centers = np.array(store.centroids())
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    got = store.read().collect()
    assert sorted(r["vec_id"] for r in got) == sorted(r["vec_id"] for r in rows.collect())
    assert all(r["cell"] == int(np.argmax(centers @ np.array(r["vec"], float))) for r in got)


def test_all_cells_give_the_exact_result(stored):
    rows, store = stored
    q = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = store.search(q, "query_id", nprobe=64).select("query_id", "vec_id", "score", "rank").collect()
    want = nearest(q, rows, ["query_id"], ["vec_id"], k=P.SEARCH_TOP_K).select("query_id", "vec_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_only_probed_cells_are_read_and_nothing_is_trained(stored, monkeypatch):
    rows, store = stored
    monkeypatch.setattr(A, "KMeans", None)
    q = rows.where("vec_id = 50").withColumnRenamed("vec_id", "query_id")
    found = store.search(q, "query_id", nprobe=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:80]
    few = store.read([1, 2, 3])
    assert {r["cell"] for r in few.collect()} <= {1, 2, 3} and few.count() > 0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "IN (1,2,3)" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Filter " not in plan.replace("PartitionFilters", "")


def test_batches_versions_and_crashes(spark, stored):
    rows, store = stored
    n = store.read().count()
    store.add(1, rows)                                              # committed before: left as it is
    assert store.read().count() == n
    store._at(1)._write(rows.withColumn("cell", F.lit(0)), "vectors", 7, by="cell")      # no commit
    assert store.read().count() == n
    assert store.train(rows, nlist=8) == 2 and store.version() == 2
    store.add(0, rows)
    assert store.read().count() == rows.count() and len(store.centroids()) <= 8 and store.read(version=1).count() == n


def test_vectors_without_a_direction_are_stored(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)] + [(9, [0.0, 0.0]), (10, None)], "vec_id long, vec array<float>")
    store = A.VectorStore(spark, scratch_dir(spark, "vectors"), "vec_id")
    store.train(df, nlist=3)
    store.add(0, df)
    assert {r["vec_id"] for r in store.read().collect()} == set(range(10))


def test_ingest_skips_known_and_duplicate_names(spark):
    from simcheck.operators import ingest as IG
    docs = spark.createDataFrame(
        [(1, "same text", "a"), (2, "same text", "b"), (3, "other", "a"), (4, "known", "c")],
        "doc_id long, text string, source string")
    listing = IG.file_listing(docs)
    stored = IG.file_listing(docs.where("doc_id = 4")).select("filename")
    new = {(r.doc_id, r.file_path.split("/")[0]) for r in IG.new_files(listing, stored).collect()}
    assert new == {(1, "a"), (3, "a")}


def test_file_names_hold_the_whole_hash(spark):
    from simcheck.operators import ingest as IG
    docs = spark.createDataFrame([(1, "some text", "a")], "doc_id long, text string, source string")
    assert IG.file_listing(docs).first()["filename"] == "h_552e21cd4cd9918678e3c1a0df491bc3.pdf"
