"""Page geometry: rectangle merges, page layout, context windows (FIXTURES D)."""
from simcheck.operators import pages as PG


def test_production_merge_repeats_close_boxes(spark):
    rects = spark.createDataFrame(
        [(1, 0.0, 10.0, 5.0, 20.0), (1, 1.0, 12.0, 6.0, 22.0), (1, 2.0, 30.0, 7.0, 40.0)],
        "k int, x0 double, y0 double, x1 double, y1 double")
    got = PG.merge_rects(rects, ["k"]).orderBy("box_no").collect()
    boxes = [(r.x0, r.y0, r.x1, r.y1) for r in got]
    assert len(boxes) == 3 and boxes[0] == boxes[1] == (0.0, 10.0, 6.0, 22.0)
    assert boxes[2] == (2.0, 30.0, 7.0, 40.0)


def test_paper_merge_islands(spark):
    rects = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 10.0), (1, 1.0, 0.0, 2.0, 11.0), (1, 2.0, 0.0, 3.0, 12.5), (1, 3.0, 0.0, 4.0, 20.0)],
        "k int, x0 double, y0 double, x1 double, y1 double")
    got = PG.merge_islands(rects, ["k"]).orderBy("island").collect()
    assert [(r.x0, r.x1, r.y1) for r in got] == [(0.0, 3.0, 12.5), (3.0, 4.0, 20.0)]


def test_page_layout_offsets(spark):
    text = "\n".join(["first  line", "", "second"] + [f"l{i}" for i in range(40)])
    df = spark.createDataFrame([(1, text)], "d long, text string")
    lines = PG.page_lines(df, "d").orderBy("page_num", "line_no").collect()
    pages = {r.page_num: r.text for r in PG.page_text(df, "d").collect()}
    assert pages[0].startswith("first line second l0")
    for r in lines:
        assert pages[r.page_num][r.line_start:r.line_end] == r.text
    assert lines[0].x1 == 72 + 6 * len("first line") and lines[1].y0 == 72 + 14 * 2


def test_locate_first_page_only(spark):
    text = "\n".join(["alpha beta"] + ["x"] * 39 + ["alpha beta", "gamma"])
    df = spark.createDataFrame([(1, text)], "d long, text string")
    sent = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "beta x"), (1, 2, "x alpha"),
                                  (1, 3, "beta gamma")], "d long, i int, sentence string")
    got = {r.i: r.page_num for r in PG.locate(sent, PG.page_text(df, "d"), "d", "i").collect()}
    # "alpha beta" is on both pages -> first; "x alpha" spans the page break -> not located
    assert got == {0: 0, 1: 0, 3: 1}


def test_every_occurrence_gets_boxes(spark):
    """A sentence that stands twice on a page, once over a line break, is boxed twice and merges on its line."""
    s = "a (b) \\E c+ d."
    text = f"{s} and {s}\nx y a (b)\n\\E c+ d. end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    located = spark.createDataFrame([(1, 0, s, 0)], "doc_id long, sentence_index int, sentence string, page_num int")
    pt, pl = PG.page_text(docs, "doc_id"), PG.page_lines(docs, "doc_id")
    rects = PG.sentence_rects(located, pt, pl, "doc_id", "sentence_index")
    n = len(s)
    got = sorted((r.occurrence, r.line_no, r.x0, r.x1) for r in rects.collect())
    x = lambda c: PG.X0 + PG.CHAR_W * c
    assert got == [(0, 0, x(0), x(n)), (1, 0, x(n + 5), x(2 * n + 5)), (2, 1, x(4), x(9)), (2, 2, x(0), x(8))]
    merged = PG.merge_rects(rects, ["doc_id", "sentence_index", "page_num"]).orderBy("box_no").collect()
    assert [(m.x0, m.x1) for m in merged] == [(x(0), x(2 * n + 5)), (x(4), x(9)), (x(0), x(8))]
    islands = PG.merge_islands(rects, ["doc_id", "sentence_index", "page_num"]).count()
    assert islands == 3 < len(got)
