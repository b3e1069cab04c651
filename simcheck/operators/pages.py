"""Page layout and location.

A document row carries its whole text, so its page layout (lines, offsets,
page texts) is computed inside that row with higher-order functions — no
shuffle.  Only locating sentences on pages joins: an equi-join on the document
key and words of the sentence, then on the page, never a cross product.

Layout rule (a stand-in for a PDF extractor): lines are the text split on
newline; 40 lines per page, pages 0-based; a line box is
``x0=72, x1=72+6*len, y0=72+14*line, y1=y0+12``; line spans are character
offsets in the cleaned page text (non-empty cleaned lines joined by one space).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import text as TX

LINES_PER_PAGE = 40
X0, CHAR_W, Y0, LINE_H, BOX_H = 72.0, 6.0, 72.0, 14.0, 12.0
#: Words in a row by which sentences meet pages.
GRAM = 6


def _clean_lines(text) -> F.Column:
    return F.transform(F.split(text, "\n"), lambda l: TX.clean_text(l))


def page_lines(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, page_num, line_no, text, line_start, line_end, x0, y0, x1, y1); empty lines skipped."""
    cl = df.select(id_col, _clean_lines(F.col(text_col)).alias("__cl"))
    z = (cl.select(id_col, F.posexplode(_page_slices("__cl")).alias("page_num", "__ls"))
         .select(id_col, "page_num", F.posexplode(F.arrays_zip(F.col("__ls").alias("t"), _offsets("__ls").alias("o")))
                 .alias("line_no", "z")))
    n = F.length("z.t")
    line = F.col("line_no")
    return (z.where(n > 0).select(
        id_col, "page_num", "line_no",
        F.col("z.t").alias("text"),
        F.col("z.o").alias("line_start"),
        (F.col("z.o") + n).alias("line_end"),
        F.lit(X0).alias("x0"),
        (F.lit(Y0) + F.lit(LINE_H) * line).alias("y0"),
        (F.lit(X0) + F.lit(CHAR_W) * n).alias("x1"),
        (F.lit(Y0) + F.lit(LINE_H) * line + F.lit(BOX_H)).alias("y1")))


def _page_slices(lines: str) -> F.Column:
    """The lines cut into pages."""
    n_pages = F.ceil(F.size(lines) / F.lit(LINES_PER_PAGE)).cast("int")
    return F.transform(F.sequence(F.lit(0), n_pages - 1), lambda p: F.slice(lines, p * LINES_PER_PAGE + 1, LINES_PER_PAGE))


def _offsets(lines: str) -> F.Column:
    """Start of each line in its page's text; a fold over one page, so its cost is bounded."""
    zero = F.struct(F.array().cast("array<int>").alias("offs"), F.lit(0).alias("cur"))

    def step(acc, t):
        after = F.when(F.length(t) > 0, acc["cur"] + F.length(t) + 1).otherwise(acc["cur"])
        return F.struct(F.array_append(acc["offs"], acc["cur"]).alias("offs"), after.alias("cur"))

    return F.aggregate(F.col(lines), zero, step, lambda acc: acc["offs"])


def page_text(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, page_num, text): non-empty cleaned lines of each page joined by a space."""
    cl = df.select(id_col, _clean_lines(F.col(text_col)).alias("__cl"))
    pages = F.transform(_page_slices("__cl"), lambda ls, p: F.struct(
        p.alias("page_num"), F.array_join(F.filter(ls, lambda x: x != ""), " ").alias("text")))
    return (cl.select(id_col, F.explode(pages).alias("p"))
            .select(id_col, "p.page_num", "p.text").where(F.col("text") != ""))


def page_sizes(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, width, height) of the first page: A4, or as far as its lines and the margins reach.

    A document whose first page has no line has no row and takes A4.
    """
    return (lines.where("page_num = 0").groupBy(id_col)
            .agg(F.greatest(F.lit(P.PAGE_WIDTH), F.max("x1") + X0).alias("width"),
                 F.greatest(F.lit(P.PAGE_HEIGHT), F.max("y1") + Y0).alias("height")))


def _gram(words: str, at) -> F.Column:
    return F.xxhash64(F.array_join(F.slice(F.col(words), at, GRAM), " "))


def locate(sentences: DataFrame, pages: DataFrame, id_col: str, index_col: str,
           first_only: bool = True) -> DataFrame:
    """Pages whose text contains the sentence; the first one when ``first_only``.

    A page that contains a sentence has the words behind its first one in a row
    (the first and the last may be parts of longer words there), so sentences
    meet pages on the document and the hash of ``GRAM`` such words, and
    ``contains`` confirms.  Sentences are not set against all pages of their
    document; only those too short for that are.  A sentence split across two
    pages is found on neither (it still counts elsewhere).
    """
    # explode keeps the words one column; as an expression they would be cut anew for every word
    cut = lambda df, col: df.withColumn("__w", F.explode(F.array(F.split(col, " "))))
    words = cut(sentences.select(id_col, index_col, "sentence"), "sentence")
    held = cut(pages.select(id_col, "page_num", "text"), "text").where(F.size("__w") >= GRAM)
    grams = F.transform(F.sequence(F.lit(1), F.size("__w") - GRAM + 1), lambda i: _gram("__w", i))
    held = held.select(id_col, "page_num", F.explode(F.array_distinct(grams)).alias("__g"))
    long = F.size("__w") >= GRAM + 2
    met = (words.where(long).select(id_col, index_col, "sentence", _gram("__w", F.lit(2)).alias("__g"))
           .join(held, [id_col, "__g"]).select(id_col, index_col, "sentence", "page_num"))
    texts = pages.select(id_col, "page_num", F.col("text").alias("page_text"))
    short = words.where(~long).drop("__w").join(texts, id_col)
    j = (met.join(texts, [id_col, "page_num"]).select(short.columns).unionByName(short)
         .where(F.col("page_text").contains(F.col("sentence"))))
    if not first_only:
        return j.select(id_col, index_col, "sentence", "page_num", "page_text")
    return j.groupBy(id_col, index_col).agg(F.min("page_num").alias("page_num"))


def occurrences(text: str, part: str) -> F.Column:
    """0-based starts of the non-overlapping occurrences of one column's text in another's."""
    # the text between occurrences, the part taken literally
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col(part), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    gaps = F.split(F.col(text), quoted, -1)
    lengths = F.transform(gaps, F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc, n):
        start = acc["at"] + n
        return F.struct((start + F.length(part)).alias("at"), F.array_append(acc["starts"], start).alias("starts"))

    return F.aggregate(F.slice(lengths, 1, F.size(lengths) - 1), zero, step, lambda acc: acc["starts"])


def sentence_rects(located: DataFrame, pages: DataFrame, lines: DataFrame,
                   id_col: str, index_col: str) -> DataFrame:
    """L1: for every occurrence of the sentence on its page one box per line it overlaps.

    ``located`` holds (id, index, sentence, page_num).  Occurrences are found
    from left to right and do not overlap; they are numbered from 0.
    """
    pt = pages.withColumnRenamed("text", "page_text")
    span = (located.join(pt, [id_col, "page_num"])
            .select(id_col, index_col, "page_num", F.length("sentence").alias("s_len"),
                    F.posexplode(occurrences("page_text", "sentence")).alias("occurrence", "s_start"))
            .withColumn("s_end", F.col("s_start") + F.col("s_len"))
            .select(id_col, index_col, "page_num", "occurrence", "s_start", "s_end"))
    ln = lines.select(id_col, "page_num", "line_no", "line_start", "line_end", "y0", "y1")
    j = span.join(ln, [id_col, "page_num"]).where(
        (F.col("s_start") < F.col("line_end")) & (F.col("s_end") > F.col("line_start")))
    return j.select(
        id_col, index_col, "page_num", "occurrence", "line_no",
        (F.lit(X0) + F.lit(CHAR_W) * (F.greatest("s_start", "line_start") - F.col("line_start"))).alias("x0"),
        "y0",
        (F.lit(X0) + F.lit(CHAR_W) * (F.least("s_end", "line_end") - F.col("line_start"))).alias("x1"),
        "y1")


def merge_rects(rects: DataFrame, keys: list[str], tol: float = P.RECT_Y0_TOLERANCE) -> DataFrame:
    """G1: for each distinct y0 (ascending) one box around all rects within ``tol``.

    Distinct y0 values closer than ``tol`` yield repeated/overlapping boxes, as
    in the production merge.  Higher-order functions over each sentence's
    (short) rect list; grouping keys include the page so the join's
    partitioning is reused.
    """
    g = rects.groupBy(*keys).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("r"))
    ys = F.array_sort(F.array_distinct(F.transform("r", lambda r: r["y0"])))

    def box(y):
        grp = F.filter("r", lambda r: F.abs(r["y0"] - y) < tol)
        return F.struct(
            F.array_min(F.transform(grp, lambda r: r["x0"])).alias("x0"),
            F.array_min(F.transform(grp, lambda r: r["y0"])).alias("y0"),
            F.array_max(F.transform(grp, lambda r: r["x1"])).alias("x1"),
            F.array_max(F.transform(grp, lambda r: r["y1"])).alias("y1"))

    return (g.select(*keys, F.posexplode(F.transform(ys, box)).alias("box_no", "b"))
            .select(*keys, "box_no", "b.x0", "b.y0", "b.x1", "b.y1"))


def merge_islands(rects: DataFrame, keys: list[str], gap: float = P.RECT_Y1_GAP) -> DataFrame:
    """Rects sorted by (y1, x0); a new box starts when y1 moves by >= gap."""
    w = Window.partitionBy(*keys).orderBy("y1", "x0")
    flagged = rects.withColumn(
        "__new", F.when(F.lag("y1").over(w).isNull(), 1)
        .when(F.abs(F.col("y1") - F.lag("y1").over(w)) < gap, 0).otherwise(1))
    isl = flagged.withColumn("island", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
                             .cast("int"))
    return isl.groupBy(*keys, "island").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def assemble(pages: DataFrame, doc_col: str, page_col: str, text_col: str, raw: bool = False) -> DataFrame:
    """Page texts -> document text, pages in order.

    Clean mode cleans each page and joins with one space (then strips); raw
    mode concatenates as is.  One group-by on the document key; the page list
    is sorted inside the group.
    """
    txt = F.col(text_col) if raw else TX.clean_text(text_col)
    g = pages.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct(F.col(page_col).alias("p"), txt.alias("t"))))
                                   .alias("pp"))
    joined = F.array_join(F.transform("pp", lambda x: x["t"]), "" if raw else " ")
    return g.select(doc_col, (joined if raw else F.trim(joined)).alias("text"),
                    F.size("pp").alias("n_pages"))


def assemble_with_status(pages: DataFrame, doc_col: str, page_col: str, text_col: str, status_col: str) -> DataFrame:
    """Clean-mode assembly that carries failed pages: (doc, text, n_pages, n_failed, failed_pages, status).

    A failed page (status other than ``ok``) adds no text and stays counted; the
    document is ``ok``, ``partial`` or, with no page left, ``error``.
    """
    ok = F.coalesce(F.col(status_col) == "ok", F.lit(False))
    rows = pages.select(doc_col, F.struct(F.col(page_col).alias("p"), F.when(ok, TX.clean_text(text_col)).alias("t"),
                                          ok.alias("ok")).alias("page"))
    g = rows.groupBy(doc_col).agg(F.sort_array(F.collect_list("page")).alias("pp"))
    good, bad = F.filter("pp", lambda x: x["ok"]), F.filter("pp", lambda x: ~x["ok"])
    n_bad = F.size(bad)
    return g.select(doc_col, F.trim(F.array_join(F.transform(good, lambda x: x["t"]), " ")).alias("text"),
                    F.size("pp").alias("n_pages"), n_bad.alias("n_failed"),
                    F.transform(bad, lambda x: x["p"]).alias("failed_pages"),
                    F.when(n_bad == 0, "ok").when(n_bad < F.size("pp"), "partial").otherwise("error").alias("status"))
