"""Registered queries: sources, lookups and corpus statistics
(S1, S3, S5, S8, P15-P18, A18-A20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import text as TX
from simcheck.operators import ingest as IG
from simcheck.operators import sentences as S
from simcheck.plans import check as C
from simcheck.plans import sql as Q
from simcheck.plans import index as IX
from simcheck.plans.catalog import register
from simcheck.session import scratch_dir
from simcheck.sources import files as FS
from simcheck.sources.tables import load

_CS = f"cs AS ({Q.kept_sentences('documents', 'doc_id')})"


def _cs(spark, sf_dir):
    return IX.corpus_sentences(spark, sf_dir)


# ------------------------------------------------------------ requests

def requests(benchmark):
    """Check requests built from submissions: one for every item's PDF, and a
    second one (a .docx that was never uploaded) for every even item."""
    b = benchmark.select("item_id")
    subj = F.concat(F.lit("subj_"), (F.col("item_id") % 7).cast("string"))
    pdf = b.select(F.concat(F.lit("chk_"), F.col("item_id").cast("string")).alias("file_check_id"),
                   subj.alias("subject_id"),
                   F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".pdf")).alias("file_name"))
    docx = b.where(F.col("item_id") % 2 == 0).select(
        F.concat(F.lit("chk_"), F.col("item_id").cast("string"), F.lit("_b")).alias("file_check_id"),
        subj.alias("subject_id"),
        F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".docx")).alias("file_name"))
    return pdf.unionByName(docx)


def object_listing(benchmark):
    """Object keys present in the store: checker/{subject}/{file} for every uploaded item."""
    subj = F.concat(F.lit("subj_"), (F.col("item_id") % 7).cast("string"))
    name = F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".pdf"))
    return benchmark.select(F.concat_ws("/", F.lit("checker"), subj, name).alias("key"))


def _req_key():
    return F.concat_ws("/", F.lit("checker"), F.col("subject_id"), F.col("file_name"))


_REQ_SQL = (
    "WITH req AS (SELECT 'chk_' || item_id::VARCHAR AS file_check_id, 'subj_' || (item_id % 7)::VARCHAR AS subject_id, "
    "'item_' || item_id::VARCHAR || '.pdf' AS file_name FROM benchmark UNION ALL "
    "SELECT 'chk_' || item_id::VARCHAR || '_b', 'subj_' || (item_id % 7)::VARCHAR, 'item_' || item_id::VARCHAR || '.docx' "
    "FROM benchmark WHERE item_id % 2 = 0), "
    "lst AS (SELECT 'checker/subj_' || (item_id % 7)::VARCHAR || '/item_' || item_id::VARCHAR || '.pdf' AS key FROM benchmark) "
    "SELECT * FROM req WHERE {neg} EXISTS (SELECT 1 FROM lst WHERE lst.key = 'checker/' || req.subject_id || '/' || req.file_name)")


@register("requests_found", sql=_REQ_SQL.format(neg=""))
def requests_found(spark, sf_dir):
    """Requests whose object exists (left semi-join with the listing)."""
    b = load(spark, sf_dir, "benchmark")
    r = requests(b).withColumn("key", _req_key())
    return r.join(object_listing(b), "key", "left_semi").drop("key")


@register("requests_missing", sql=_REQ_SQL.format(neg="NOT"))
def requests_missing(spark, sf_dir):
    """Requests whose object is missing (left anti-join) -> the 404 path."""
    b = load(spark, sf_dir, "benchmark")
    r = requests(b).withColumn("key", _req_key())
    return r.join(object_listing(b), "key", "left_anti").drop("key")


# ------------------------------------------------------------ file sources

@register("scan_files")
def scan_files(spark, sf_dir):
    """Recursive glob scan of the table folder (bytes not read)."""
    df = FS.scan_files(spark, sf_dir, glob="*.parquet")
    return df.select(TX.basename("path").alias("name"), "length")


@register("expand_archives")
def expand_archives(spark, sf_dir):
    """S3: documents packed into one zip per source folder, then expanded back
    on the executors; one row per member."""
    docs = load(spark, sf_dir, "documents").select(
        "source", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    out = scratch_dir(spark, "archives")
    FS.write_zip_archives(docs, "source", "name", "text", out)
    arch = FS.scan_files(spark, out, glob="*.zip")
    return FS.expand_archives(arch).select(TX.basename("archive").alias("archive"), "member", "size")


@register("load_sentence_list", sql=f"WITH {_CS} SELECT sentence_index AS pos, sentence FROM cs")
def load_sentence_list(spark, sf_dir):
    """Per-document sentence lists written as JSON arrays, read back as rows."""
    cs = _cs(spark, sf_dir)
    lists = cs.groupBy("doc_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("sentence_index", "sentence"))),
                              lambda x: x["sentence"])).alias("value"))
    out = scratch_dir(spark, "sentence-lists")
    lists.select("value").write.mode("overwrite").text(out)
    return FS.load_sentence_list(spark, out).select("pos", "sentence")


# --------------------------------------------------------------- statistics

@register("table_counts", sql=(
    f"WITH {_CS} SELECT 'documents' AS table_name, count(*) AS n FROM documents "
    "UNION ALL SELECT 'sentences', count(*) FROM cs "
    "UNION ALL SELECT 'vectors', count(*) FROM cs"))
def table_counts(spark, sf_dir):
    """Sizes of the document, sentence and vector tables (one scan each)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cs = IX.corpus_sentences(spark, sf_dir)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("table_name"), "n")
    n_sent = cs.agg(F.count(F.lit(1)).alias("n"))
    return n_docs.unionByName(n_sent.select(F.lit("sentences").alias("table_name"), "n")) \
        .unionByName(IX.corpus_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit("vectors").alias("table_name"), "n"))


@register("corpus_totals", sql=(
    f"WITH {_CS} SELECT count(DISTINCT doc_id) AS n_files, count(*) AS n_sentences FROM cs"))
def corpus_totals(spark, sf_dir):
    """Files with at least one kept sentence, and all kept sentences."""
    return _cs(spark, sf_dir).agg(F.countDistinct("doc_id").alias("n_files"),
                                  F.count(F.lit(1)).alias("n_sentences"))


@register("category_stats", sql=(
    f"WITH {_CS}, per AS (SELECT d.source, c.doc_id, count(*) AS n FROM cs c JOIN documents d "
    "ON d.doc_id = c.doc_id GROUP BY d.source, c.doc_id) "
    "SELECT source, count(*) AS n_files, floor(avg(n))::BIGINT AS mean_sentences FROM per GROUP BY source"))
def category_stats(spark, sf_dir):
    """Files per source and truncated mean sentences per file."""
    docs = load(spark, sf_dir, "documents")
    per = (IX.corpus_sentences(spark, sf_dir).groupBy("doc_id")
           .agg(F.count(F.lit(1)).alias("n")).join(docs.select("doc_id", "source"), "doc_id"))
    return per.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"),
                                     F.floor(F.avg("n")).cast("bigint").alias("mean_sentences"))


# ------------------------------------------------------------------ lookups

@register("lookup_sentences", sql=(
    f"WITH {Q.base_ctes()}, {Q.top1_cte()} SELECT c.doc_id, c.sentence_index, c.sentence "
    "FROM cs c WHERE EXISTS (SELECT 1 FROM hits h "
    "WHERE h.doc_id = c.doc_id AND h.sentence_index = c.sentence_index)"))
def lookup_sentences(spark, sf_dir):
    """P15 batched: sentence rows for every key hit by a check (left semi-join)."""
    keys = ["doc_id", "sentence_index"]
    return (_cs(spark, sf_dir).join(C.hits(spark, sf_dir).select(*keys), keys, "left_semi")
            .select(*keys, "sentence"))


@register("lookup_document", sql=(
    "WITH lst AS (SELECT doc_id, n_chars, 'h_' || md5(text) || '.pdf' AS filename FROM documents), "
    "want AS (SELECT DISTINCT l.filename FROM lst l JOIN labels b ON b.doc_id = l.doc_id WHERE b.quality = 1) "
    "SELECT l.doc_id, l.filename, l.n_chars FROM lst l JOIN want w ON w.filename = l.filename"))
def lookup_document(spark, sf_dir):
    """P16 batched: documents by file name (names of the quality-1 registry rows)."""
    docs = load(spark, sf_dir, "documents")
    lst = IG.file_listing(docs).join(docs.select("doc_id", "n_chars"), "doc_id")
    want = (lst.join(load(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id"), "doc_id")
            .select("filename").distinct())
    return lst.join(want, "filename").select("doc_id", "filename", "n_chars")


@register("document_sentences", sql=(
    f"WITH {_CS} SELECT doc_id, sentence_index, sentence FROM cs "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id, sentence_index"))
def document_sentences(spark, sf_dir):
    """All sentences of the requested documents, in order."""
    want = load(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    return (_cs(spark, sf_dir).join(want, "doc_id", "left_semi")
            .orderBy("doc_id", "sentence_index"))


RANGE_START, RANGE_END = 2, 5


@register("document_range", sql=(
    f"WITH {_CS} SELECT doc_id, sentence_index, sentence FROM cs WHERE doc_id IN (SELECT doc_id FROM labels) "
    f"AND sentence_index BETWEEN {RANGE_START} AND {RANGE_END} ORDER BY doc_id, sentence_index"))
def document_range(spark, sf_dir, start: int | None = RANGE_START, end: int | None = RANGE_END):
    """Sentences of the requested documents; the index range applies only
    when both bounds are given (inclusive)."""
    want = load(spark, sf_dir, "labels").select("doc_id")
    s = _cs(spark, sf_dir).join(want, "doc_id", "left_semi")
    if start is not None and end is not None:
        s = s.where(F.col("sentence_index").between(start, end))
    return s.orderBy("doc_id", "sentence_index")
