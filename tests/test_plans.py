"""Plan assertions: no cross products, filters and pruning reach the scan."""
import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
NO_NESTED_LOOP = ["top1_match", "topk_search_filtered", "pair_similarity", "tfidf_top1",
                  "locate_sentences", "merge_rects", "context_window", "doc_vs_corpus",
                  "ingest_sentences", "lsh_pairs", "ivf_topk", "requests_missing"]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", NO_NESTED_LOOP)
def test_no_cartesian_or_nested_loop(spark, key):
    plan = _plan(E.queries()[key](spark, SMOKE))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark):
    plan = E.queries()["filter_boilerplate"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_lookup_filter_reaches_scan(spark):
    plan = E.queries()["document_sentences"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan


def test_topk_prelimits_before_shuffle(spark):
    from simcheck.plans import check as C
    inp = C.Inputs.read(spark, SMOKE)
    df = C.top1_hits(C.query_vectors(inp.benchmark), C.corpus_vectors(inp.documents))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
