"""Streaming ingest/check and the store: availableNow runs, replay safety."""
import pytest

from simcheck.operators.ingest import CorpusStore
from simcheck.plans import index as IX
from simcheck.session import scratch_dir
from simcheck.sources.tables import load, table_path
from simcheck.streaming.jobs import check_stream, ingest_stream

SMOKE = "/root/testdata/sf0.001"
PICK = ["filename", "pdf_id", "first_sentence_id", "total_sentences"]


def _rows(store, table, cols):
    return sorted(tuple(r) for r in store.read(table).select(*cols).collect())


def _consistent(store):
    docs, sent = _rows(store, "documents", PICK), _rows(store, "sentences", ["sentence_id", "pdf_id", "sentence_index"])
    assert [s[0] for s in sent] == list(range(1, len(sent) + 1))
    assert sent == [(first + i, pdf, i) for _, pdf, first, n in sorted(docs, key=lambda d: d[1]) for i in range(n)]
    assert [d[1] for d in sorted(docs, key=lambda d: d[1])] == list(range(1, len(docs) + 1))
    assert sent == _rows(store, "vectors", ["sentence_id", "pdf_id", "sentence_index"])
    return docs


def test_ingest_stream_is_replay_safe(spark):
    out = scratch_dir(spark, "test-stream")
    first = _consistent(ingest_stream(spark, table_path(SMOKE, "documents"), out))
    # a second run over the same source and checkpoint must not add anything
    assert _consistent(ingest_stream(spark, table_path(SMOKE, "documents"), out)) == first
    names = [f[0] for f in first]
    assert len(names) == len(set(names)) > 0


def test_store_skips_known_files_and_continues_ids(spark):
    docs = load(spark, SMOKE, "documents")
    store = CorpusStore(spark, scratch_dir(spark, "test-store"))
    store.append(0, docs.where("doc_id % 2 = 0"))
    half = _consistent(store)
    store.append(1, docs)
    both = _consistent(store)
    assert set(half) <= set(both)
    store.append(1, docs.limit(0))          # committed: left as it is
    assert _consistent(store) == both
    whole = CorpusStore(spark, scratch_dir(spark, "test-store"))
    whole.append(0, docs)
    assert {d[0] for d in _consistent(whole)} == {d[0] for d in both}


@pytest.mark.parametrize("dies_at", ["documents", "sentences", "vectors", "commits"])
def test_a_batch_lands_in_all_tables_or_in_none(spark, monkeypatch, dies_at):
    docs = load(spark, SMOKE, "documents").where("doc_id < 20")
    store = CorpusStore(spark, scratch_dir(spark, "test-store"))
    store.append(0, docs.where("doc_id < 10"))
    before = _consistent(store)
    write = CorpusStore._write

    def dying(self, rows, table, batch):
        if table == dies_at:
            raise RuntimeError("lost")
        return write(self, rows, table, batch)
    monkeypatch.setattr(CorpusStore, "_write", dying)
    with pytest.raises(RuntimeError):
        store.append(1, docs)
    monkeypatch.undo()
    assert _consistent(store) == before
    store.append(1, docs)
    assert len(_consistent(store)) > len(before)


def test_check_stream_matches_batch(spark):
    import __spark_entry__ as E
    out = check_stream(spark, table_path(SMOKE, "benchmark"), IX.corpus_table(spark, SMOKE))
    streamed = {(r.item_id, r.doc_id, r.n_matches) for r in spark.read.parquet(f"{out}/results")
                .where("doc_id IS NOT NULL").collect()}
    batch = {(r.item_id, r.doc_id, r.n_matches) for r in E.queries()["top5_documents"](spark, SMOKE).collect()}
    assert streamed == batch
