"""Percent, rounding, ntile and band semantics."""
from pyspark.sql import functions as F

from simcheck.functions.ordering import global_row_number, ntile_from_position
from simcheck.operators import sparse as SP
from simcheck.plans.q_pairs import band_of


def test_percent_truncation_forms(spark):
    df = spark.createDataFrame([(29, 100), (29, 50), (0, 7), (7, 7)], "m long, n long")
    rows = df.select((F.col("m") / F.col("n") * 100).cast("int").alias("a"),
                     (F.bround(F.col("m") / F.col("n"), 2) * 100).cast("int").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(int(29 / 100 * 100), int(round(29 / 100, 2) * 100)),
                                                (int(29 / 50 * 100), int(round(29 / 50, 2) * 100)),
                                                (0, 0), (100, 100)]
    assert rows[0]["b"] == 28 and rows[1]["a"] == 57


def test_ntile_23_rows_10_parts(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    n = global_row_number(df, [F.col("k")], "pos")
    got = n.select(ntile_from_position("pos", 23, 10).alias("p")).groupBy("p").count() \
        .orderBy("p").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_global_row_number_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    rows = global_row_number(df, [F.col("k")], "rn").orderBy("rn").collect()
    assert [r["rn"] for r in rows] == list(range(1, 1001))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_bands(spark):
    df = spark.createDataFrame([(30.0,), (30.5,), (60.0,), (90.0,), (95.0,)], "p double")
    got = [r[0] for r in df.select(band_of(F.col("p"))).collect()]
    assert got == [30, 60, 60, 90, None]


def test_weights_beyond_the_broadcast_guard(spark):
    """The join form and the in-row form give the same weights."""
    from simcheck.operators import sparse as SP
    rows = [(1, 0, "a b b c"), (1, 1, "a a d"), (2, 0, "c d e"), (2, 1, "once only"), (3, 0, "a b c d")]
    s = spark.createDataFrame(rows, "doc_id long, sentence_index int, sentence string")
    idf = SP.idf_table(SP.token_stats(s), len(rows))
    pick = spark.createDataFrame([("a",), ("d",), ("zz",)], "token string")
    keys = ["doc_id", "sentence_index"]
    for only in (None, pick):
        got = [sorted((r.doc_id, r.sentence_index, r.token, round(r.weight, 9)) for r in SP.weighted_tokens(
            s, keys, idf, only=only, guard_bytes=g).collect()) for g in (0, 1 << 20)]
        assert got[0] == got[1] and got[0]
    assert {r.token for r in idf.collect()} == {"a", "b", "c", "d"}


def test_evaluation_documents_hold_their_share(spark):
    """The parts recover the label: corpus and near-copy sentences make the share, the rest is new."""
    from simcheck.plans import q_eval as E
    sf = "/root/testdata/sf0.001"
    lists = {p: {r.sentence for r in df.collect()} for p, df in E.eval_lists(spark, sf).items()}
    assert not lists["in"] & lists["fresh"]
    for avg in (40, 400):
        for r in E.build_eval_docs(spark, sf, avg).collect():
            want = {p: min(len(lists[p]), E.part_size(p, r.share, avg)) for p in E.PARTS}
            assert (r.n_in, r.n_near, r.n_fresh) == (want["in"], want["near"], want["fresh"])
    docs = E.build_eval_docs(spark, sf, 40).collect()
    assert len(docs) == 30 and len({r.text for r in docs}) == 30
    n = len(lists["in"])
    assert len({(7 + k * E._step(n)) % n for k in range(n)}) == n


def test_word_vectors_are_stored_and_looked_up(spark, monkeypatch):
    """A trained table is published, read without training and asked for words; versions stand beside each other."""
    from simcheck.operators import word_vectors as W
    from simcheck.session import scratch_dir
    docs = spark.createDataFrame([(1, "red green blue red"), (2, "green blue sky"), (3, "other words")], "d long, text string")
    store = W.WordVectorStore(spark, scratch_dir(spark, "test-w2v"))
    words = spark.createDataFrame([("green",), ("absent",)], "word string")
    assert store.version() is None and store.lookup(words).where("vec is not null").count() == 0
    assert store.publish(W.train(docs.where("d < 3"))) == 1
    monkeypatch.setattr(W, "Word2Vec", None)
    first = {r["word"]: r["vec"] for r in store.lookup(words).collect()}
    assert len(first["green"]) == 100 and first["absent"] is None
    table = {r["word"]: r["vec"] for r in store.vectors().collect()}
    assert set(table) == {"red", "green", "blue", "sky"} and first["green"] == table["green"]
    means = {r["d"]: r["dv"] for r in store.document_vectors(docs, "d").collect()}
    want = [sum(x) / 4 for x in zip(*[table[w] for w in ("red", "green", "blue", "red")])]
    assert set(means) == {1, 2} and max(abs(x - y) for x, y in zip(means[1], want)) < 1e-12
    store._write(store.vectors(), "vectors", 2)                     # no commit
    assert store.version() == 1
    assert store.publish(spark.createDataFrame([("green", [1.0, 2.0])], "word string, vec array<double>")) == 2
    assert {r["word"]: r["vec"] for r in store.lookup(words).collect()}["green"] == [1.0, 2.0]
    assert len(store.lookup(words, 1).where("word = 'green'").first()["vec"]) == 100


def test_word_vectors_are_trained_once_per_corpus(spark, monkeypatch):
    from simcheck.operators import word_vectors as W
    from simcheck.plans import index as IX
    sf = "/root/testdata/sf0.001"
    IX.word_vectors(spark, sf)
    monkeypatch.setattr(W, "Word2Vec", None)
    assert IX.word_vectors(spark, sf).version() == 1


KEYS = ["doc_id", "sentence_index"]


def test_large_dictionaries_meet_blocks_of_sentences(spark, monkeypatch):
    far = 1 << 60
    rows = [(None, 0, "red fox red"), (far + 1, 0, "blue fox sky"), (far + 1, 1, "sky"), (far + 1, 1, "sky red odd"),
            (far + 2, 0, "none"), (far + 3, 0, "")]
    cs = spark.createDataFrame(rows, "doc_id long, sentence_index int, sentence string").coalesce(1)
    vocabulary = spark.createDataFrame([("red",), ("fox",), ("sky",)], "token string")
    want = {(None, 0, "red", 2), (None, 0, "fox", 1), (far + 1, 0, "fox", 1), (far + 1, 0, "sky", 1), (far + 1, 1, "sky", 2),
            (far + 1, 1, "red", 1)}
    monkeypatch.setattr(SP, "BLOCK_ROWS", 2)
    for guard in (0, 1 << 20):
        bow = SP.bag_of_words(cs, KEYS, vocabulary, guard_bytes=guard)
        assert sorted(map(tuple, bow.collect()), key=str) == sorted(want, key=str)
        plan = bow._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan        # counted in the rows, not in a shuffle by sentence and token


def test_likely_sentences_are_all_that_can_reach_the_threshold(spark):
    import random
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i % 50, i // 50, " ".join(rng.choices(words[:12] if i % 3 else words, k=rng.randint(1, 6)))) for i in range(400)]
    rows += [(7, 3, "w1 w2"), (None, 0, "w3 w4 w5")]
    cs = spark.createDataFrame(rows, "doc_id long, sentence_index int, sentence string")
    idf = SP.materialize(SP.idf_table(SP.token_stats(cs), cs.count()))
    qs = cs.where("doc_id < 5").selectExpr("doc_id as item_id", "sentence_index as q_index", "sentence")
    qw = SP.materialize(SP.weighted_tokens(qs, ["item_id", "q_index"], idf).withColumnRenamed("weight", "qw"))
    near = SP.likely(cs, KEYS, idf, qw, ["item_id", "q_index"], 0.9)

    def found(some):
        s = (SP.weighted_tokens(some, KEYS, idf).join(qw, "token").groupBy("item_id", "q_index", *KEYS)
             .agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score")).where("score >= 0.9"))
        return sorted(map(str, s.collect()))
    assert found(near) == found(cs) != []
    assert near.count() < cs.count() / 2
