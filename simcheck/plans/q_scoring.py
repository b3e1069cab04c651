"""Registered queries: the check report numbers (J5, A1-A4, T1, flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from simcheck.plans import check as C
from simcheck.plans import sql as Q
from simcheck.plans.catalog import register
from simcheck.sources.tables import load

_BASE = f"WITH {Q.base_ctes()}, {Q.top1_cte()}, {Q.per_doc_cte()} "


@register("matches_per_doc", sql=_BASE + "SELECT item_id, doc_id, n_matches, first_q FROM mpd")
def matches_per_doc(spark, sf_dir):
    return C.matches_per_doc(C.hits(spark, sf_dir))


_TOTAL = (
    "SELECT qt.item_id, qt.n_sentences, coalesce(m.n_distinct, 0)::BIGINT AS n_matched, {expr} AS {name} "
    "FROM qt LEFT JOIN (SELECT h.item_id, count(DISTINCT qs.sentence) AS n_distinct FROM hits h "
    "JOIN qs ON qs.item_id = h.item_id AND qs.q_index = h.q_index GROUP BY h.item_id) m "
    "ON m.item_id = qt.item_id")


@register("total_percent", sql=_BASE + _TOTAL.format(
    expr="trunc(coalesce(m.n_distinct, 0) / qt.n_sentences * 100)::INTEGER", name="total_percent"))
def total_percent(spark, sf_dir):
    """A2: int(distinct matched texts / kept sentences * 100)."""
    inp = C.Inputs.read(spark, sf_dir)
    return C.total_percent(C.hits(spark, sf_dir), inp.benchmark)


@register("total_percent_float", sql=_BASE + _TOTAL.format(
    expr="coalesce(m.n_distinct, 0) / qt.n_sentences * 100", name="total_percent_float"))
def total_percent_float(spark, sf_dir):
    """A3: the same share without truncation."""
    inp = C.Inputs.read(spark, sf_dir)
    return C.total_percent(C.hits(spark, sf_dir), inp.benchmark, as_float=True)


@register("doc_similarity", sql=_BASE + (
    "SELECT m.item_id, m.doc_id, m.n_matches, qt.n_sentences, "
    "CASE WHEN qt.n_sentences > 0 THEN least(trunc(m.n_matches / qt.n_sentences * 100)::INTEGER, 100) "
    "ELSE 0 END AS similarity_value FROM mpd m JOIN qt ON qt.item_id = m.item_id"))
def doc_similarity(spark, sf_dir):
    """A4: per (submission, document) percent, capped at 100."""
    inp = C.Inputs.read(spark, sf_dir)
    return C.doc_similarity(C.hits(spark, sf_dir), inp.benchmark)


_TOP5 = ("top AS (SELECT *, row_number() OVER (PARTITION BY item_id "
         "ORDER BY n_matches DESC, first_q)::INTEGER AS rank FROM mpd) ")


@register("top5_documents", sql=_BASE + ", " + _TOP5 +
          "SELECT item_id, doc_id, n_matches, first_q, rank FROM top WHERE rank <= 5")
def top5_documents(spark, sf_dir):
    """Five documents with most matches; ties keep first-match order."""
    return C.top_documents(C.hits(spark, sf_dir))


@register("check_summary", sql=_BASE + ", " + _TOP5 + (
    ", tp AS (" + _TOTAL.format(expr="trunc(coalesce(m.n_distinct, 0) / qt.n_sentences * 100)::INTEGER",
                                name="total_percent") + ") "
    "SELECT t.item_id, t.rank, t.doc_id, t.n_matches, "
    "least(trunc(t.n_matches / tp.n_sentences * 100)::INTEGER, 100) AS similarity_value, tp.total_percent "
    "FROM top t JOIN tp ON tp.item_id = t.item_id WHERE t.rank <= 5"))
def check_summary(spark, sf_dir):
    """Flagship: top-5 source documents per submission with both percents."""
    return C.check_summary(spark, sf_dir)


def _filename(col):
    return F.concat(F.lit("doc_"), col.cast("string"), F.lit(".pdf"))


@register("hits_with_document", sql=_BASE + (
    "SELECT h.item_id, h.q_index, h.doc_id, 'doc_' || d.doc_id::VARCHAR || '.pdf' AS filename, "
    "d.source, h.score FROM hits h JOIN documents d ON d.doc_id = h.doc_id"))
def hits_with_document(spark, sf_dir):
    """One equi-join replaces the per-hit document lookup."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    h = C.hits(spark, sf_dir)
    return h.join(docs, "doc_id").select(
        "item_id", "q_index", "doc_id", _filename(F.col("doc_id")).alias("filename"),
        "source", "score")


@register("dangling_hits", sql=_BASE + (
    "SELECT h.item_id, h.q_index, h.doc_id FROM hits h "
    "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = h.doc_id)"))
def dangling_hits(spark, sf_dir):
    """J5 failure side: hits whose document has no registry row (``labels``)."""
    reg = load(spark, sf_dir, "labels").select("doc_id")
    return C.hits(spark, sf_dir).join(reg, "doc_id", "left_anti").select("item_id", "q_index", "doc_id")
