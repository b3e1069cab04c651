"""Vector kernels against brute force (SURVEY 5(c)), encoder equivalence, ties."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from simcheck.functions import vectors as V
from simcheck.operators.similarity import best_per_group, nearest


def _frame(spark, mat, prefix, extra=None):
    rows = []
    for i, v in enumerate(mat):
        row = (i // 3, i, [float(x) for x in v]) + ((extra[i],) if extra is not None else ())
        rows.append(row)
    schema = f"{prefix}_doc long, {prefix}_idx int, vec array<float>" + (", lab int" if extra is not None else "")
    return spark.createDataFrame(rows, schema)


def _cos(a, b):
    a = a.astype(np.float64)
    b = b.astype(np.float64)
    s = (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    return np.round(s, 6)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    c = rng.standard_normal((60, 16)).astype(np.float32)
    c[10] = c[3]          # exact copies: ties broken by key
    c[40] = c[3]
    q = np.vstack([c[3], c[5] + 0.01, rng.standard_normal((8, 16))]).astype(np.float32)
    return q, c


def _brute_topk(q, c, k):
    s = _cos(q, c)
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-s[i, j], j // 3, j))
        out[i] = [(j // 3, j, s[i, j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_nearest_equals_brute_force(spark, data, parts):
    q, c = data
    qdf = _frame(spark, q, "q")
    cdf = _frame(spark, c, "c")
    got = nearest(qdf, cdf, ["q_idx"], ["c_doc", "c_idx"], k=3, parts=parts).collect()
    want = _brute_topk(q, c, 3)
    by_q = {}
    for r in got:
        by_q.setdefault(r["q_idx"], []).append((r["rank"], r["c_doc"], r["c_idx"], r["score"]))
    for i, rows in by_q.items():
        rows.sort()
        assert [(d, j) for _, d, j, _ in rows] == [(d, j) for d, j, _ in want[i]]
        assert np.allclose([s for *_, s in rows], [s for *_, s in want[i]])


def test_nearest_threshold_and_filter(spark, data):
    q, c = data
    labels_c = [i % 2 for i in range(len(c))]
    labels_q = [i % 2 for i in range(len(q))]
    qdf = _frame(spark, q, "q", labels_q).withColumnRenamed("lab", "ql")
    cdf = _frame(spark, c, "c", labels_c)
    got = nearest(qdf, cdf, ["q_idx"], ["c_idx"], k=2, threshold=0.5,
                  q_filter="ql", c_filter="lab").collect()
    s = _cos(q, c)
    for r in got:
        assert labels_c[r["c_idx"]] == labels_q[r["q_idx"]]
        assert r["score"] >= 0.5 and abs(s[r["q_idx"], r["c_idx"]] - r["score"]) < 1e-9


def test_top_k_emits_k_rows_per_query_and_partition(spark, data, monkeypatch):
    """Whatever the number of batches and chunks, a partition yields its running top-k once."""
    from simcheck.operators import similarity as M
    seen = []
    monkeypatch.setattr(M, "_final_top_k", lambda partial, *a: seen.append(partial) or partial)
    monkeypatch.setattr(M, "MAX_MATRIX_ENTRIES", 20)
    q, c = data
    nearest(_frame(spark, q, "q"), _frame(spark, c, "c").repartition(3), ["q_idx"], ["c_idx"], k=2)
    rows = seen[0].withColumn("p", F.spark_partition_id()).groupBy("p", "q_idx").count().collect()
    assert rows and max(r["count"] for r in rows) <= 2


def test_query_parts_are_held_one_at_a_time(spark, data, monkeypatch):
    """Five parts: a part is collected and sent only after the one before it is written and dropped."""
    q, c = data
    qdf, cdf = _frame(spark, q, "q"), _frame(spark, c, "c")
    whole = sorted(map(tuple, nearest(qdf, cdf, ["q_idx"], ["c_idx"], k=3).collect()))
    context, held, most = type(spark.sparkContext), [], []
    send = context.broadcast

    def counted(self, value):
        sent = send(self, value)
        drop = sent.destroy
        held.append(sent)
        most.append(len(held))
        sent.destroy = lambda *a: (held.remove(sent), drop(*a))
        return sent
    monkeypatch.setattr(context, "broadcast", counted)
    assert sorted(map(tuple, nearest(qdf, cdf, ["q_idx"], ["c_idx"], k=3, parts=5).collect())) == whole
    best_per_group(qdf, cdf, ["q_idx"], "c_doc", "c_idx", 0.3, parts=5).collect()
    assert len(most) == 10 and max(most) == 1 and not held


@pytest.mark.parametrize("guard", [64 << 20, 2000])
def test_best_per_group_first_argmax(spark, data, guard):
    q, c = data
    qdf = _frame(spark, q, "q")
    cdf = _frame(spark, c, "c")
    got = {(r["q_idx"], r["c_doc"]): (r["score"], r["arg"])
           for r in best_per_group(qdf, cdf, ["q_idx"], "c_doc", "c_idx", 0.3,
                                   guard_bytes=guard).collect()}
    s = _cos(q, c)
    for i in range(len(q)):
        for d in range(len(c) // 3):
            cols = [j for j in range(len(c)) if j // 3 == d]
            best = max(s[i, j] for j in cols)
            if best >= 0.3:
                arg = min(j for j in cols if s[i, j] == best)
                assert got[(i, d)] == (best, arg)


def test_udf_encoder_equals_expression_encoder(spark):
    rows = [("The cat sat on the mat the end",), ("Ünïcode Straße déjà vu",), ("one",)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(V.hashed_vector("s").alias("a"), V.hashed_vector_expr("s").alias("b")).collect()
    for r in got:
        assert r["a"] == r["b"]
        assert abs(sum(x * x for x in r["a"]) - 1) < 1e-5


def test_cosine_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 2.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine("a", "b").alias("c")).first()["c"]
    assert abs(got - 10 / 14) < 1e-12


@pytest.mark.parametrize("parts", [1, 3])
def test_sentences_as_corpus_match_like_their_vectors(spark, monkeypatch, parts):
    """Encoded by the tasks: the same vectors bit by bit, the same rows, whatever the size of a piece."""
    import random

    from simcheck.operators import similarity as SIM
    from simcheck.operators.sentences import encode
    rng = random.Random(3)
    words = ["Straße", "ÉTÉ", "a", "", "the", "x_y", "日本", "İ", *[f"w{i}" for i in range(40)]]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(120)]
    near = [" ".join(t.split(" ")[:-1] + ["other"]).upper() for t in texts[:20]]
    rows = [(i // 4, i % 4, t) for i, t in enumerate(texts + texts[:5] + near + ["", " "])]
    c = spark.createDataFrame(rows, "doc long, idx int, sentence string").repartition(3)
    q = encode(spark.createDataFrame(list(enumerate(texts[:30] + [""])), "q int, sentence string"))
    cv = encode(c)
    both = cv.select("vec", F.lower("sentence").cast("binary").alias("low")).collect()
    own = V.hashed_matrix([bytes(r.low) for r in both], {})
    assert np.array_equal(own, np.array([r.vec for r in both], np.float32))
    monkeypatch.setattr(SIM, "ENCODE_ROWS", 7)
    for limit in (0.8, 0.9, 1.0):
        for fn, keys in ((lambda s, **k: nearest(q, s, ["q"], ["doc", "idx"], k=2, threshold=limit, parts=parts, **k), 5),
                         (lambda s, **k: best_per_group(q, s, ["q"], "doc", "idx", limit, parts=parts, **k), 4)):
            want, got = sorted(map(tuple, fn(cv).collect())), sorted(map(tuple, fn(c, c_text="sentence").collect()))
            assert got == want and len(got) > 30 and len(got[0]) == keys
    with pytest.raises(ValueError):
        nearest(q, c, ["q"], ["doc", "idx"], c_text="sentence")
