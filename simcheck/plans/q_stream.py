"""Registered queries: streaming ingest and check."""

from __future__ import annotations

from simcheck.plans import index as IX
from simcheck.plans import sql as Q
from simcheck.plans.catalog import register
from simcheck.sources.tables import table_path
from simcheck.plans.q_reports import _REPORT_SQL
from simcheck.streaming.jobs import check_stream, ingest_stream, read_reports

_INGEST = (
    f"WITH cs AS ({Q.kept_sentences('documents', 'doc_id')}), "
    "cnt AS (SELECT doc_id, count(*) AS n FROM cs GROUP BY doc_id), "
    "lst AS (SELECT doc_id, 'h_' || md5(text) || '.pdf' AS filename, "
    "source || '/' || 'h_' || md5(text) || '.pdf' AS file_path FROM documents), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY file_path, doc_id) AS rn "
    "FROM lst) WHERE rn = 1) "
    "SELECT row_number() OVER (ORDER BY f.filename) AS pdf_id, f.filename, f.file_path, "
    "cnt.n::INTEGER AS total_sentences FROM f JOIN cnt ON cnt.doc_id = f.doc_id")

_CHECK = (
    f"WITH {Q.base_ctes()}, {Q.top1_cte()}, {Q.per_doc_cte()}, "
    "top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_matches DESC, first_q)::INTEGER AS rank FROM mpd), "
    "md AS (SELECT h.item_id, count(DISTINCT q.sentence) AS n FROM hits h JOIN qs q ON q.item_id = h.item_id "
    "AND q.q_index = h.q_index GROUP BY h.item_id) "
    "SELECT qt.item_id, qt.n_sentences, trunc((coalesce(md.n, 0) / qt.n_sentences) * 100)::INTEGER AS total_percent, "
    "coalesce(top.rank, 0) AS rank, coalesce(top.doc_id, -1) AS doc_id, coalesce(top.n_matches, 0) AS n_matches FROM qt LEFT JOIN md ON md.item_id = qt.item_id "
    "LEFT JOIN top ON top.item_id = qt.item_id AND top.rank <= 5")


@register("stream_ingest", sql=_INGEST)
def stream_ingest(spark, sf_dir):
    """Documents arrive as a file stream; each micro-batch is de-duplicated
    by file name and appended to the document, sentence and vector tables."""
    store = ingest_stream(spark, table_path(sf_dir, "documents"))
    return store.read("documents").select("pdf_id", "filename", "file_path", "total_sentences")


@register("stream_check", sql=_CHECK)
def stream_check(spark, sf_dir):
    """R2: submissions arrive as a file stream and are checked against the corpus index.

    A submission without any match has rank 0, doc_id -1 and no matches.
    """
    out = check_stream(spark, table_path(sf_dir, "benchmark"), IX.corpus_table(spark, sf_dir))
    return spark.read.parquet(f"{out}/results").drop("batch_id").fillna({"rank": 0, "doc_id": -1, "n_matches": 0})


@register("stream_reports", sql=_REPORT_SQL)
def stream_reports(spark, sf_dir):
    """R2/K4: the nested reports that the check stream writes, with a clock that stands still."""
    out = check_stream(spark, table_path(sf_dir, "benchmark"), IX.corpus_table(spark, sf_dir), clock=lambda: 0.0)
    return read_reports(spark, out)
