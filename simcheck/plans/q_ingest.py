"""Registered queries: incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from simcheck.operators import ingest as IG
from simcheck.plans import index as IX
from simcheck.plans import sql as Q
from simcheck.plans.catalog import register
from simcheck.sources.tables import load

# The store before this batch: documents that have a registry row (``labels``).
# Their ids and sentence ids are taken; the batch continues after them.

_LIST = ("lst AS (SELECT doc_id, text, 'h_' || md5(text) || '.pdf' AS filename, "
         "source || '/' || 'h_' || md5(text) || '.pdf' AS file_path FROM documents), "
         "stored AS (SELECT DISTINCT filename FROM lst WHERE doc_id IN (SELECT doc_id FROM labels)), "
         "firstf AS (SELECT filename, file_path, doc_id FROM (SELECT *, row_number() OVER "
         "(PARTITION BY filename ORDER BY file_path, doc_id) AS rn FROM lst) WHERE rn = 1), "
         "newf AS (SELECT * FROM firstf WHERE filename NOT IN (SELECT filename FROM stored)), "
         f"cs AS ({Q.kept_sentences('documents', 'doc_id')}), "
         "cnt AS (SELECT doc_id, count(*) AS total_sentences FROM cs GROUP BY doc_id), "
         "base AS (SELECT (SELECT coalesce(max(doc_id), -1) + 1 FROM labels WHERE doc_id IN "
         "(SELECT doc_id FROM documents)) AS first_doc, (SELECT count(*) FROM cs WHERE doc_id IN "
         "(SELECT doc_id FROM labels)) + 1 AS first_sent), "
         "newdocs AS (SELECT (row_number() OVER (ORDER BY n.filename) + (SELECT first_doc FROM base) - 1) AS pdf_id, "
         "n.doc_id, n.filename, n.file_path, c.total_sentences::INTEGER AS total_sentences FROM newf n "
         "JOIN cnt c ON c.doc_id = n.doc_id), "
         "newsent AS (SELECT (row_number() OVER (ORDER BY d.pdf_id, s.sentence_index) + "
         "(SELECT first_sent FROM base) - 1) AS sentence_id, d.pdf_id, s.sentence_index, s.sentence "
         "FROM newdocs d JOIN cs s ON s.doc_id = d.doc_id) ")


def _batch(spark, sf_dir):
    """Document rows of the new files and their sentences; totals of the store come from the corpus index."""
    docs = load(spark, sf_dir, "documents")
    reg = load(spark, sf_dir, "labels").select("doc_id")
    listing = IG.file_listing(docs)
    new = IG.new_files(listing, IG.stored_names(listing, reg))
    last = docs.select("doc_id").join(reg, "doc_id", "left_semi").agg(F.max("doc_id")).first()[0]
    corpus = IX.corpus_sentences(spark, sf_dir)
    stored = corpus.select("doc_id").join(reg, "doc_id", "left_semi").count()
    sent = corpus.join(new.select("doc_id"), "doc_id", "left_semi")
    return IG.documents_rows(new, sent, (-1 if last is None else last) + 1, stored + 1), sent


@register("ingest_new_files", sql="WITH " + _LIST + "SELECT filename, file_path, doc_id FROM newf")
def ingest_new_files(spark, sf_dir):
    """Files of the batch not yet stored, one per base name (lowest path)."""
    docs = load(spark, sf_dir, "documents")
    reg = load(spark, sf_dir, "labels").select("doc_id")
    listing = IG.file_listing(docs)
    return IG.new_files(listing, IG.stored_names(listing, reg)).select("filename", "file_path", "doc_id")


@register("ingest_documents", sql="WITH " + _LIST + "SELECT * FROM newdocs")
def ingest_documents(spark, sf_dir):
    """K1: document rows with generated ids and sentence totals."""
    return _batch(spark, sf_dir)[0].drop("first_sentence_id")


@register("ingest_sentences", sql="WITH " + _LIST + "SELECT * FROM newsent")
def ingest_sentences(spark, sf_dir):
    """K2: sentence rows with generated ids, position among kept sentences."""
    return IG.sentence_rows(*_batch(spark, sf_dir))


@register("ingest_vectors", sql="WITH " + _LIST + (
    f", nv AS ({Q.encode('SELECT sentence_id, pdf_id, sentence_index, sentence FROM newsent')}) "
    "SELECT sentence_id, pdf_id, (d - 1)::INTEGER AS dim, round(w::DOUBLE, 6) AS weight FROM ("
    "SELECT sentence_id, pdf_id, unnest(vec) AS w, unnest(range(1, len(vec) + 1)) AS d FROM nv) WHERE w <> 0"))
def ingest_vectors(spark, sf_dir):
    """K3: float32 vectors keyed by the new sentence ids, as their non-zero dimensions."""
    v = IG.vector_rows(IG.sentence_rows(*_batch(spark, sf_dir)))
    return (v.select("sentence_id", "pdf_id", F.posexplode("sentence_vector").alias("dim", "w")).where("w <> 0")
            .select("sentence_id", "pdf_id", "dim", F.round(F.col("w").cast("double"), 6).alias("weight")))
