"""Registered queries: page assembly, sentence location and rectangles
(S6, S7, J16, L1, L2, G1, G2, G4, A16)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import text as TX
from simcheck.operators import pages as PG
from simcheck.operators import sentences as S
from simcheck.plans import check as C
from simcheck.plans import q_pairs as QP
from simcheck.plans import sql as Q
from simcheck.plans import index as IX
from simcheck.plans.catalog import register
from simcheck.session import materialize
from simcheck.sources.tables import load

LPP = PG.LINES_PER_PAGE


def _pl_sql(table: str, id_col: str, name: str) -> str:
    return (
        f"{name}0 AS (SELECT {id_col}, (i // {LPP})::INTEGER AS page_num, (i % {LPP})::INTEGER AS line_no, "
        f"{Q.clean('line')} AS t FROM (SELECT {id_col}, unnest(ls) AS line, unnest(range(len(ls))) AS i "
        f"FROM (SELECT {id_col}, string_split(text, chr(10)) AS ls FROM {table}))), "
        f"{name} AS (SELECT {id_col}, page_num, line_no, t AS text, ls AS line_start, "
        f"(ls + length(t))::INTEGER AS line_end, {PG.X0} AS x0, {PG.Y0} + {PG.LINE_H} * line_no AS y0, "
        f"{PG.X0} + {PG.CHAR_W} * length(t) AS x1, {PG.Y0} + {PG.LINE_H} * line_no + {PG.BOX_H} AS y1 FROM ("
        f"SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY {id_col}, page_num ORDER BY line_no "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS ls FROM {name}0 WHERE t <> '')), "
        f"{name}_pt AS (SELECT {id_col}, page_num, string_agg(text, ' ' ORDER BY line_no) AS text "
        f"FROM {name} GROUP BY {id_col}, page_num)")


def _spans_sql(located: str, pt: str, id_col: str) -> str:
    """SQL: every row of ``located`` with (occurrence, s_start, s_end) on its page."""
    return (f"SELECT * EXCLUDE (starts), unnest(starts) AS s_start, unnest(starts) + length(sentence) AS s_end, "
            f"unnest(range(len(starts)))::INTEGER AS occurrence FROM (SELECT l.*, list_transform(range(len(parts) - 1), "
            f"lambda k: (list_sum(list_transform(parts[1:k + 1], lambda x: length(x))) + k * length(l.sentence))::INTEGER) "
            f"AS starts FROM (SELECT l0.*, string_split(p.text, l0.sentence) AS parts FROM {located} l0 JOIN {pt} p "
            f"ON p.{id_col} = l0.{id_col} AND p.page_num = l0.page_num) l)")


def _rects_sql(located: str, pt: str, pl: str, id_col: str, idx: str) -> str:
    """SQL for L1 over a located relation with (id, idx, sentence, page_num)."""
    return (
        f"SELECT sp.{id_col}, sp.{idx}, sp.page_num, sp.occurrence, ln.line_no, "
        f"{PG.X0} + {PG.CHAR_W} * (greatest(sp.s_start, ln.line_start) - ln.line_start) AS x0, ln.y0, "
        f"{PG.X0} + {PG.CHAR_W} * (least(sp.s_end, ln.line_end) - ln.line_start) AS x1, ln.y1 "
        f"FROM ({_spans_sql(located, pt, id_col)}) sp "
        f"JOIN {pl} ln ON ln.{id_col} = sp.{id_col} AND ln.page_num = sp.page_num "
        f"AND sp.s_start < ln.line_end AND sp.s_end > ln.line_start")


_DOC_BASE = (f"WITH cs AS ({Q.kept_sentences('documents', 'doc_id')}), {_pl_sql('documents', 'doc_id', 'pl')}, "
             "loc AS (SELECT s.doc_id, s.sentence_index, min(p.page_num) AS page_num FROM cs s "
             "JOIN pl_pt p ON p.doc_id = s.doc_id WHERE contains(p.text, s.sentence) "
             "GROUP BY s.doc_id, s.sentence_index), "
             "locs AS (SELECT l.*, c.sentence FROM loc l JOIN cs c ON c.doc_id = l.doc_id "
             "AND c.sentence_index = l.sentence_index), "
             f"rects AS ({_rects_sql('locs', 'pl_pt', 'pl', 'doc_id', 'sentence_index')}) ")


def _doc_frames(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cs = IX.corpus_sentences(spark, sf_dir)
    pt = PG.page_text(docs, "doc_id")
    pl = PG.page_lines(docs, "doc_id")
    loc = PG.locate(cs, pt, "doc_id", "sentence_index")
    locs = loc.join(cs, ["doc_id", "sentence_index"])
    return cs, pt, pl, locs


@register("locate_sentences", sql=_DOC_BASE + "SELECT * FROM loc")
def locate_sentences(spark, sf_dir):
    """First page of its document whose text contains each corpus sentence."""
    _, _, _, locs = _doc_frames(spark, sf_dir)
    return locs.select("doc_id", "sentence_index", "page_num")


@register("sentence_rects", sql=_DOC_BASE + "SELECT * FROM rects")
def sentence_rects(spark, sf_dir):
    """L1: line boxes covered by each located sentence on its page."""
    _, pt, pl, locs = _doc_frames(spark, sf_dir)
    return PG.sentence_rects(locs, pt, pl, "doc_id", "sentence_index")


@register("merge_rects", sql=_DOC_BASE + (
    ", ys AS (SELECT DISTINCT doc_id, sentence_index, page_num, y0 AS y FROM rects), "
    "yr AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sentence_index, page_num ORDER BY y) - 1)::INTEGER "
    "AS box_no FROM ys) "
    "SELECT yr.doc_id, yr.sentence_index, yr.page_num, yr.box_no, min(r.x0) AS x0, min(r.y0) AS y0, "
    "max(r.x1) AS x1, max(r.y1) AS y1 FROM yr JOIN rects r ON r.doc_id = yr.doc_id "
    "AND r.sentence_index = yr.sentence_index AND r.page_num = yr.page_num "
    f"AND abs(r.y0 - yr.y) < {P.RECT_Y0_TOLERANCE} GROUP BY yr.doc_id, yr.sentence_index, yr.page_num, yr.box_no"))
def merge_rects(spark, sf_dir):
    """G1: production merge of each sentence's line boxes."""
    _, pt, pl, locs = _doc_frames(spark, sf_dir)
    r = PG.sentence_rects(locs, pt, pl, "doc_id", "sentence_index")
    return PG.merge_rects(r, ["doc_id", "sentence_index", "page_num"])


@register("merge_lines_islands", sql=_DOC_BASE + (
    ", fl AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL THEN 1 "
    f"WHEN abs(y1 - lag(y1) OVER w) < {P.RECT_Y1_GAP} THEN 0 ELSE 1 END AS nw FROM rects "
    "WINDOW w AS (PARTITION BY doc_id, sentence_index, page_num ORDER BY y1, x0)), "
    "isl AS (SELECT *, (sum(nw) OVER (PARTITION BY doc_id, sentence_index, page_num ORDER BY y1, x0 "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::INTEGER AS island FROM fl) "
    "SELECT doc_id, sentence_index, page_num, island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, "
    "max(y1) AS y1 FROM isl GROUP BY doc_id, sentence_index, page_num, island"))
def merge_lines_islands(spark, sf_dir):
    """Paper merge as gaps-and-islands over y1."""
    _, pt, pl, locs = _doc_frames(spark, sf_dir)
    r = PG.sentence_rects(locs, pt, pl, "doc_id", "sentence_index")
    return PG.merge_islands(r, ["doc_id", "sentence_index", "page_num"])


# ----------------------------------------------------- check-report pages

_ITEM_PAGES = _pl_sql("benchmark", "item_id", "bl")


@register("page_report", sql=(
    f"WITH {Q.base_ctes()}, {Q.top1_cte()}, {Q.per_doc_cte()}, {_ITEM_PAGES}, "
    "top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n_matches DESC, first_q) AS rank FROM mpd), "
    "ms AS (SELECT DISTINCT h.item_id, h.doc_id, q.sentence FROM hits h JOIN top t ON t.item_id = h.item_id "
    "AND t.doc_id = h.doc_id AND t.rank <= 5 JOIN qs q ON q.item_id = h.item_id AND q.q_index = h.q_index), "
    "loc AS (SELECT m.item_id, m.doc_id, m.sentence, min(p.page_num) AS page_num FROM ms m "
    "JOIN bl_pt p ON p.item_id = m.item_id WHERE contains(p.text, m.sentence) "
    "GROUP BY m.item_id, m.doc_id, m.sentence), "
    f"sp AS ({_spans_sql('loc', 'bl_pt', 'item_id')}) "
    "SELECT sp.item_id, sp.doc_id, sp.page_num, sp.sentence, count(DISTINCT ln.y0) AS n_boxes FROM sp "
    "JOIN bl ln ON ln.item_id = sp.item_id AND ln.page_num = sp.page_num AND sp.s_start < ln.line_end "
    "AND sp.s_end > ln.line_start GROUP BY sp.item_id, sp.doc_id, sp.page_num, sp.sentence"))
def page_report(spark, sf_dir):
    """A16/L2 flat form: per (submission, top document, page) each matched sentence
    once, with the number of merged boxes (G1) it covers."""
    boxes = report_boxes(spark, sf_dir)
    return (boxes.groupBy("item_id", "doc_id", "page_num", "sentence")
            .agg(F.count(F.lit(1)).alias("n_boxes")))


def report_boxes(spark, sf_dir, hits=None):
    """Merged boxes of the matched sentences of every submission's top-5 documents."""
    return boxes_of(C.Inputs.read(spark, sf_dir).benchmark, C.hits(spark, sf_dir) if hits is None else hits)


def boxes_of(benchmark, h):
    """(item_id, doc_id, page_num, sentence, q_index, box_no, x0, y0, x1, y1) for the matches ``h`` of submissions."""
    qs = S.query_sentences(benchmark)
    top = C.top_documents(h).select("item_id", "doc_id")
    ms = (h.join(top, ["item_id", "doc_id"]).join(qs, ["item_id", "q_index"])
          .groupBy("item_id", "doc_id", "sentence").agg(F.min("q_index").alias("q_index")))
    bench = benchmark.select("item_id", "text")
    pt = PG.page_text(bench, "item_id")
    pl = PG.page_lines(bench, "item_id")
    # the sentence key carries doc_id, so one sentence is located once per document
    ms_k = ms.withColumn("sk", F.struct("doc_id", "sentence", "q_index"))
    loc = PG.locate(ms_k, pt, "item_id", "sk")
    loc = loc.select("item_id", "page_num", "sk", F.col("sk.sentence").alias("sentence"))
    rects = PG.sentence_rects(loc, pt, pl, "item_id", "sk")
    boxes = PG.merge_rects(rects, ["item_id", "sk", "page_num"])
    return boxes.select("item_id", F.col("sk.doc_id").alias("doc_id"), "page_num",
                        F.col("sk.sentence").alias("sentence"), F.col("sk.q_index").alias("q_index"),
                        "box_no", "x0", "y0", "x1", "y1")


@register("highlight_assign", sql=(
    QP._PAPER + ", " + QP._TOP5P + ", " + _ITEM_PAGES + ", "
    "ms AS (SELECT DISTINCT t.item_id, t.doc_id, t.rank, q.sentence FROM top t JOIN best b "
    "ON b.item_id = t.item_id AND b.doc_id = t.doc_id JOIN qs q ON q.item_id = b.item_id "
    "AND q.q_index = b.q_index WHERE t.rank <= 5), "
    "onp AS (SELECT m.item_id, p.page_num, m.sentence, m.doc_id, m.rank FROM ms m JOIN bl_pt p "
    "ON p.item_id = m.item_id WHERE contains(p.text, m.sentence)), "
    "own AS (SELECT item_id, page_num, sentence, sentence AS sk, doc_id, (rank - 1)::INTEGER AS color FROM ("
    "SELECT *, row_number() OVER (PARTITION BY item_id, page_num, sentence ORDER BY rank) AS rn FROM onp) "
    f"WHERE rn = 1), rects AS ({_rects_sql('own', 'bl_pt', 'bl', 'item_id', 'sk')}), "
    "fl AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL THEN 1 "
    f"WHEN abs(y1 - lag(y1) OVER w) < {P.RECT_Y1_GAP} THEN 0 ELSE 1 END AS nw FROM rects "
    "WINDOW w AS (PARTITION BY item_id, sk, page_num ORDER BY y1, x0)), "
    "isl AS (SELECT *, (sum(nw) OVER (PARTITION BY item_id, sk, page_num ORDER BY y1, x0 "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1)::INTEGER AS box_no FROM fl), "
    "box AS (SELECT item_id, page_num, sk, box_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 "
    "FROM isl GROUP BY item_id, page_num, sk, box_no) "
    "SELECT o.item_id, o.page_num, o.sentence, o.doc_id, o.color, b.box_no, b.x0, b.y0, b.x1, b.y1 FROM own o "
    "JOIN box b ON b.item_id = o.item_id AND b.page_num = o.page_num AND b.sk = o.sk"))
def highlight_assign(spark, sf_dir):
    """On every page, each matched sentence is coloured by the first
    top document (in rank order) that owns it; colour = rank - 1.  Its boxes
    are the line boxes of all its occurrences there, merged as in G2."""
    inp = C.Inputs.read(spark, sf_dir)
    best = QP.doc_best(spark, sf_dir)
    top = QP._top5_percent(spark, sf_dir, best).select("item_id", "doc_id", "rank")
    qs = S.query_sentences(inp.benchmark)
    ms = (top.join(best, ["item_id", "doc_id"]).join(qs, ["item_id", "q_index"])
          .select("item_id", "doc_id", "rank", "sentence").distinct())
    bench = inp.benchmark.select("item_id", "text")
    pt = PG.page_text(bench, "item_id")
    onp = (PG.locate(ms.withColumn("of", F.struct("doc_id", "rank")), pt, "item_id", "of", first_only=False)
           .select("item_id", "page_num", "sentence", "of.doc_id", "of.rank"))
    w = Window.partitionBy("item_id", "page_num", "sentence").orderBy("rank")
    own = materialize(onp.withColumn("rn", F.row_number().over(w)).where("rn = 1")
                      .select("item_id", "page_num", "sentence", F.col("sentence").alias("sk"), "doc_id",
                              (F.col("rank") - 1).alias("color")))
    rects = PG.sentence_rects(own, pt, PG.page_lines(bench, "item_id"), "item_id", "sk")
    boxes = PG.merge_islands(rects, ["item_id", "sk", "page_num"]).withColumnRenamed("island", "box_no")
    return own.join(boxes, ["item_id", "page_num", "sk"]).drop("sk")


# ------------------------------------------------------------- assembly

_ASSEMBLE_SQL = ("SELECT conv_id, {trim}(string_agg({txt}, '{sep}' ORDER BY turn)) AS text, "
                 "count(*)::INTEGER AS n_pages FROM conversations GROUP BY conv_id")


@register("assemble_document", sql=_ASSEMBLE_SQL.format(trim="trim", txt=Q.clean("text"), sep=" "))
def assemble_document(spark, sf_dir):
    """Pages (conversation turns) cleaned, ordered and joined with one space."""
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return PG.assemble(conv, "conv_id", "turn", "text")


@register("assemble_document_raw", sql=_ASSEMBLE_SQL.format(trim="", txt="text", sep=""))
def assemble_document_raw(spark, sf_dir):
    """Pages concatenated without separator."""
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return PG.assemble(conv, "conv_id", "turn", "text", raw=True)


@register("assemble_status", sql=(
    f"WITH p AS (SELECT conv_id, turn, {Q.clean('text')} AS t, text IS NOT NULL AND {Q.clean('text')} <> '' "
    "AND role = 'user' AS ok FROM conversations) "
    "SELECT conv_id, coalesce(trim(string_agg(t, ' ' ORDER BY turn) FILTER (ok)), '') AS text, count(*)::INTEGER AS n_pages, "
    "(count(*) FILTER (NOT ok))::INTEGER AS n_failed, "
    "CASE WHEN bool_and(ok) THEN 'ok' WHEN bool_or(ok) THEN 'partial' ELSE 'error' END AS status "
    "FROM p GROUP BY conv_id"))
def assemble_status(spark, sf_dir):
    """Conversation turns as pages; those without text or not by the user stand for pages that failed."""
    conv = load(spark, sf_dir, "conversations")
    ok = F.coalesce((TX.clean_text("text") != "") & (F.col("role") == "user"), F.lit(False))
    pages = conv.select("conv_id", "turn", "text", F.when(ok, "ok").otherwise("error: no text").alias("status"))
    return PG.assemble_with_status(pages, "conv_id", "turn", "text", "status").drop("failed_pages")
