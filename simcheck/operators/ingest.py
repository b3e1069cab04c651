"""Incremental corpus ingest.

Known files are skipped by an anti-join on the base file name; duplicates
inside the batch keep the lowest path (a partial min-aggregate, safe for a
hot file name).  Ids are dense: documents are numbered in file-name order, and
a sentence's id is the running sum of ``total_sentences`` before its document
plus its position, so only document rows are sorted, never sentences.

``CorpusStore`` holds the three tables.  A batch writes its rows to a folder
of its own in each table and then one commit marker; readers see only batches
with a marker, so a batch lands in all three tables or in none, and a batch
that is repeated after a crash overwrites what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcheck.functions.ordering import global_running_sum
from simcheck.operators import sentences as S
from simcheck.session import materialize
from simcheck.sources.store import BatchStore


def file_listing(documents: DataFrame) -> DataFrame:
    """Files as an ingest source sees them: content-addressed name inside a source folder."""
    name = F.concat(F.lit("h_"), F.md5("text"), F.lit(".pdf"))
    return documents.select("doc_id", "text", name.alias("filename"),
                            F.concat_ws("/", "source", name).alias("file_path"))


def new_files(incoming: DataFrame, stored_names: DataFrame) -> DataFrame:
    """One row per base name (lowest path wins), minus names already stored."""
    first = (incoming.groupBy("filename")
             .agg(F.min(F.struct("file_path", "doc_id")).alias("f"))
             .select("filename", F.col("f.file_path").alias("file_path"), F.col("f.doc_id").alias("doc_id")))
    return first.join(stored_names.select("filename"), "filename", "left_anti")


def documents_rows(files: DataFrame, sent: DataFrame, first_id: int, first_sentence: int) -> DataFrame:
    """K1: document rows for files with at least one kept sentence, ids first_id, first_id+1, ...

    ``sent`` holds (doc_id, sentence_index, sentence).  Ids follow the
    file-name order; ``first_sentence_id`` is the id of the document's first
    sentence.  Neither needs a single-task window.
    """
    counts = sent.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_sentences"))
    numbered = global_running_sum(files.join(counts, "doc_id"), [F.col("filename")], "total_sentences", "rn", "before")
    return numbered.select((F.col("rn") + first_id - 1).alias("pdf_id"), "doc_id", "filename",
                           "file_path", F.col("total_sentences").cast("int").alias("total_sentences"),
                           (F.col("before") + first_sentence).alias("first_sentence_id"))


def sentence_rows(docs_rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Sentence rows of the new documents, ids in (pdf_id, sentence_index) order."""
    return (docs_rows.select("pdf_id", "doc_id", "first_sentence_id").join(sent, "doc_id")
            .select((F.col("first_sentence_id") + F.col("sentence_index")).alias("sentence_id"), "pdf_id",
                    "sentence_index", "sentence"))


def vector_rows(sent_rows: DataFrame, encoder=None) -> DataFrame:
    """K3: float32 vectors aligned with the sentence rows."""
    return S.encode(sent_rows, encoder=encoder).select(
        "sentence_id", "pdf_id", F.col("sentence_index").cast("bigint").alias("sentence_index"),
        F.col("vec").cast("array<float>").alias("sentence_vector"))


def stored_names(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Names of files already in the store (documents with a registry row)."""
    return listing.join(registry.select("doc_id"), "doc_id", "left_semi").select("filename").distinct()


class CorpusStore(BatchStore):
    """Document, sentence and vector tables under one folder, one commit marker per batch."""

    SCHEMAS = {
        "documents": "pdf_id long, filename string, file_path string, total_sentences int, "
                     "first_sentence_id long, created_at timestamp",
        "sentences": "sentence_id long, pdf_id long, sentence_index int, sentence string",
        "vectors": "sentence_id long, pdf_id long, sentence_index long, sentence_vector array<float>",
    }

    def append(self, batch: int, docs: DataFrame, encoder=None) -> None:
        """Add the new files among ``docs`` (doc_id, text, source); a committed batch is left as it is."""
        if batch in self.batches():
            return
        stored = self.read("documents")
        last = stored.agg(F.max("pdf_id").alias("pdf"), F.sum("total_sentences").alias("sentences")).first()
        new = new_files(file_listing(docs), stored)
        sent = materialize(S.kept_sentences(docs.select("doc_id", "text").join(new.select("doc_id"), "doc_id", "left_semi"),
                                            "doc_id"))
        rows = self._write(documents_rows(new, sent, (last["pdf"] or 0) + 1, (last["sentences"] or 0) + 1)
                           .withColumn("created_at", F.current_timestamp()), "documents", batch)
        srows = self._write(sentence_rows(rows, sent), "sentences", batch)
        self._write(vector_rows(srows, encoder), "vectors", batch)
        self._commit(batch)
