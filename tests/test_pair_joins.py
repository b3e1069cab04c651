"""Threshold joins (J8, J9, J11) against the dense matrix."""
import math
from collections import Counter

import numpy as np
import pytest

from simcheck.operators import ann
from simcheck.operators import bit_sampling as BS
from simcheck.operators import prefix_join as J
from simcheck.operators import similarity as M
from simcheck.plans import check as C
from simcheck.sources.tables import load

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "doc long, idx int, vec array<float>"


def token_rows(seed=1, n=220, dim=24):
    """Sparse counts with near copies, exact copies, dominated, dense, negative, zero and null vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = np.zeros(dim)
        np.add.at(v, rng.choice(dim, rng.integers(3, 12), p=np.arange(1, dim + 1) / (dim * (dim + 1) / 2)), 1)
        rows.append(v)
        if i % 3 == 0:
            w = v.copy()
            w[rng.integers(dim)] += 1
            rows += [w, v * rng.integers(1, 4)]
    rows += [np.eye(dim)[j % 3] * 50 + np.eye(dim)[j % dim] for j in range(12)]
    rows += [rng.normal(size=dim) + 3 * (j % 2) for j in range(20)] + [np.zeros(dim)] * 2
    rows += [-rows[0], rows[5]] + [rows[7]] * 9
    out = [(int(d), i, [float(x) for x in np.float32(v)]) for i, (d, v) in
           enumerate(zip(rng.integers(0, len(rows) // 5, len(rows)), rows))]
    return out + [(3, 9000, None), (4, 9001, None)]


def brute(rows, threshold, strict=False):
    live = [(d, i, np.array(v, np.float64)) for d, i, v in rows if v is not None and any(v)]
    m = np.array([v for _, _, v in live])
    s = np.round((m @ m.T) / (np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(m, axis=1)), 6)
    ok = s > threshold if strict else s >= threshold
    return {(live[a][0], live[a][1], live[b][0], live[b][1], float(s[a, b])) for a, b in zip(*np.nonzero(ok))
            if live[a][0] < live[b][0]}


def pairs_of(df):
    return sorted((r["doc_a"], r["idx_a"], r["doc_b"], r["idx_b"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("threshold,most,block,strict", [
    (0.9, 1, None, False), (0.9, 2, None, False), (0.9, 3, 7, False), (0.6, 1, 16, False), (0.6, 2, 5, True),
    (1.0, 2, None, False), (1.0, 2, None, True), (0.3, 3, None, False)])
def test_prefix_join_equals_the_dense_matrix(spark, monkeypatch, threshold, most, block, strict):
    monkeypatch.setattr(J, "PACK", 5)
    monkeypatch.setattr(J, "CHUNK", 6)
    monkeypatch.setattr(J, "MAX_KEYS", 30)
    rows = token_rows()
    found = J.vector_classes(spark.createDataFrame(rows, SCHEMA).repartition(3), ["doc", "idx"])
    links = J.class_links(found, threshold, strict, most=most, block=block)
    assert links.count() == links.select("id_a", "id_b").distinct().count()
    got = pairs_of(J.expand(links, found, own_links=threshold < 1 or not strict))
    assert got == sorted(brute(rows, threshold, strict)) and (got or strict)


@pytest.mark.parametrize("strict", [False, True])
def test_document_counts_equal_counted_pairs(spark, strict):
    rows = token_rows(2)
    want = Counter((a, c) for a, c, _ in {(a, c, d) for a, _, c, d, _ in brute(rows, 0.8, strict)})
    got = M.pair_matches(spark.createDataFrame(rows, SCHEMA), "doc", "idx", 0.8, strict=strict).collect()
    assert {(r["doc1"], r["doc2"]): r["matches"] for r in got} == dict(want)


def test_strict_differs_at_the_threshold(spark):
    """cos((1, 0), (9, sqrt 19) / 10) = 0.9 after rounding: a match for >=, none for >."""
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [9.0, math.sqrt(19)]), (3, 0, [9.1, math.sqrt(19)])]
    df = spark.createDataFrame(rows, "doc long, idx int, vec array<double>")
    at = {(r["doc1"], r["doc2"]) for r in M.pair_matches(df, "doc", "idx", 0.9).collect()}
    above = {(r["doc1"], r["doc2"]) for r in M.pair_matches(df, "doc", "idx", 0.9, strict=True).collect()}
    assert at == {(1, 2), (1, 3), (2, 3)} and above == {(1, 3), (2, 3)}


def test_copies_are_not_paired(spark):
    """200 copies of a sentence in 2 documents are one class: no link, two held rows."""
    rows = [(i % 2, i, [1.0, 2.0, 0.0]) for i in range(200)] + [(2, 0, [1.0, 2.0, 0.1])]
    found = J.vector_classes(spark.createDataFrame(rows, SCHEMA), ["doc", "idx"])
    links = J.class_links(found, 0.9)
    assert links.count() == 1 and found.classes.count() == 2
    got = {(r["doc1"], r["doc2"]): r["matches"] for r in J.document_matches(links, found).collect()}
    assert got == {(0, 1): 100, (0, 2): 1, (1, 2): 1}


@pytest.mark.parametrize("rows", [[], [(1, 0, [0.0, 0.0])], [(1, 0, None)], [(1, 0, [1.0, 0.0])]])
def test_few_or_no_vectors(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert M.similar_pairs(df, "doc", "idx", 0.9).collect() == []
    assert ann.lsh_pairs(df, "doc", "idx", 0.9).collect() == []


def test_no_quadratic_plan(spark):
    rows = spark.createDataFrame(token_rows(), SCHEMA)
    plan = M.pair_matches(rows, "doc", "idx", 0.9)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sampled_links_equal_the_exact_join(spark):
    cv = C.corpus_vectors(load(spark, SMOKE, "documents"))
    want = pairs_of(M.similar_pairs(cv, "doc_id", "sentence_index", 0.9))
    assert pairs_of(ann.lsh_pairs(cv, "doc_id", "sentence_index", 0.9)) == want and want


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_sampled_links_of_odd_vectors(spark, threshold):
    rows = token_rows(5)
    assert pairs_of(ann.lsh_pairs(spark.createDataFrame(rows, SCHEMA), "doc", "idx", threshold)) == sorted(brute(rows, threshold))


@pytest.mark.parametrize("k", [6, 12, 16])
def test_tables_keep_the_miss_bound(k):
    """The stated chance against drawn agreements, at a bound that can be measured."""
    tables, least = BS.shape(0.9, k, miss=0.05)
    p = 1 - math.acos(0.9) / math.pi
    rng = np.random.default_rng(k)
    sampled = np.stack([rng.choice(BS.BITS, k, replace=False) for _ in range(tables)])
    agree = rng.random((2000, BS.BITS)) < p
    lost = (agree.sum(1) < least) | ~np.array([row[sampled].all(axis=1).any() for row in agree])
    assert lost.mean() < 0.075
    more, _ = BS.shape(0.9, k, miss=1e-9)
    assert more > tables
