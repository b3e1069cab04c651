"""File sources and sinks: object fetch by request, extractor hook, JSON lists."""
import os
import tempfile

from pyspark.sql import functions as F

from simcheck.functions import text as TX
from simcheck.sources import files as FS


def test_read_requested_objects_and_extractor(spark):
    root = tempfile.mkdtemp(prefix="simcheck-objs-")
    os.makedirs(f"{root}/checker/s1")
    for name, body in [("a.pdf", b"p1\fp2"), ("b.pdf", b"x"), ("bad.pdf", b"\x00bad")]:
        with open(f"{root}/checker/s1/{name}", "wb") as f:
            f.write(body)
    req = spark.createDataFrame([("c1", "s1", "a.pdf"), ("c2", "s1", "bad.pdf"), ("c3", "s1", "nope.pdf")],
                                "file_check_id string, subject_id string, file_name string")
    got = FS.read_requested_objects(spark, root, req)
    assert sorted(r.file_check_id for r in got.collect()) == ["c1", "c2"]

    def extractor(path, content):
        if content.startswith(b"\x00"):
            raise ValueError("not a document")
        return content.decode().split("\f")

    pages = FS.extract_pages(got, extractor).collect()
    ok = sorted((os.path.basename(r.path), r.page_num, r.text) for r in pages if r.status == "ok")
    assert ok == [("a.pdf", 0, "p1"), ("a.pdf", 1, "p2")]
    assert any(r.status.startswith("error") for r in pages)


def test_sentence_list_round_trip(spark):
    out = tempfile.mkdtemp(prefix="simcheck-lists-") + "/l"
    s = spark.createDataFrame([(1, 1, "b"), (1, 0, "a \"q\""), (2, 0, "c")], "d long, i int, sentence string")
    FS.write_sentence_list(s, out, "d", "i")
    back = sorted((r.pos, r.sentence) for r in FS.load_sentence_list(spark, out).collect())
    assert back == [(0, "a \"q\""), (0, "c"), (1, "b")]


def test_sentence_lists_of_any_layout(spark):
    """Indented arrays, one-line arrays and lists per line are read; what is no list is reported."""
    d = tempfile.mkdtemp(prefix="simcheck-lists-")
    for name, body in [("indented.json", '[\n    "a",\n    "b, c"\n]\n'), ("line.json", '["d"]\n'),
                       ("lines.json", '["e","f"]\n["g"]\n'), ("bad.json", '{"x": 1}'), ("none.json", "[]")]:
        with open(f"{d}/{name}", "w", encoding="utf-8") as f:
            f.write(body)
    rows = FS.load_sentence_list(spark, d).collect()
    got = sorted((os.path.basename(r.file), r.list_no, r.pos, r.sentence) for r in rows if r.status == "ok")
    assert got == [("indented.json", 0, 0, "a"), ("indented.json", 0, 1, "b, c"), ("line.json", 0, 0, "d"),
                   ("lines.json", 0, 0, "e"), ("lines.json", 0, 1, "f"), ("lines.json", 1, 0, "g")]
    assert [os.path.basename(r.file) for r in rows if r.status == "error"] == ["bad.json"]


def test_reports_of_earlier_runs_stay(spark):
    from simcheck.operators.report import write_reports
    out = tempfile.mkdtemp(prefix="simcheck-reports-") + "/r"
    one = lambda i: spark.createDataFrame([(f"chk_{i}", f'{{"n":{i}}}')], "file_check_id string, report_json string")
    write_reports(one(1), out, "a")
    write_reports(one(2), out, "b")
    write_reports(one(3), out, "b")          # the same run again
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"n":1}', '{"n":3}']


def test_time_stamps(spark):
    df = spark.createDataFrame([("2024-03-05 07:08:09",)], "t string").select(F.to_timestamp("t").alias("t"))
    r = df.select(TX.utc_iso("t").alias("a"), TX.job_id("t").alias("b")).first()
    assert (r.a, r.b) == ("2024-03-05T07:08:09Z", "20240305070809")


def test_word_count_map(spark):
    d = tempfile.mkdtemp(prefix="simcheck-wc-")
    with open(f"{d}/counts.json", "w", encoding="utf-8") as f:
        f.write('{\n  "và": 3,\n  "b": 0\n}\n')
    got = sorted((r.word, r.cnt) for r in FS.load_word_count_map(spark, d).collect())
    assert got == [("b", 0), ("và", 3)]


def test_a_bad_page_leaves_a_row(spark):
    """Pages that fail keep their number and error, later pages are read, and the document is marked."""
    from simcheck.operators import pages as PG
    files = spark.createDataFrame([("a", b"x|y|z"), ("b", b"x|!|z"), ("c", b"x|?|z"), ("d", b"?")], "path string, content binary")

    def extractor(path, content):
        for part in content.decode().split("|"):
            if part == "?":
                raise OSError("lost")
            yield ValueError("bad page") if part == "!" else f" {part}  {part} "

    pages = FS.extract_pages(files, extractor)
    assert sorted((r.path, r.page_num, r.status) for r in pages.collect() if r.status != "ok") == [
        ("b", 1, "error: ValueError"), ("c", 1, "error: OSError"), ("d", 0, "error: OSError")]
    got = {r.path: (r.text, r.n_pages, r.n_failed, r.failed_pages, r.status)
           for r in PG.assemble_with_status(pages, "path", "page_num", "text", "status").collect()}
    assert got == {"a": ("x x y y z z", 3, 0, [], "ok"), "b": ("x x z z", 3, 1, [1], "partial"),
                   "c": ("x x", 2, 1, [1], "partial"), "d": ("", 1, 1, [0], "error")}


def test_ten_files_one_per_part(spark):
    out = tempfile.mkdtemp(prefix="simcheck-parts-") + "/p"
    rows = [(i, i % 10 + 1, f"s {i} \"q\"") for i in range(203)]
    FS.write_parts(spark.createDataFrame(rows, "pos long, part int, sentence string").repartition(7), out, "part", "pos", per_line=4)
    files = {}
    for base, _, names in os.walk(out):
        files.update({os.path.basename(base): sum(n.startswith("part-") for n in names)} if "part=" in base else {})
    assert files == {f"part={k}": 1 for k in range(1, 11)}
    back = {}
    for r in FS.load_sentence_list(spark, f"{out}/part=*").orderBy("file", "list_no", "pos").collect():
        assert r.status == "ok"
        back.setdefault(int(r.file.split("part=")[1].split("/")[0]), []).append(r.sentence)
    assert back == {k: [s for _, p, s in rows if p == k] for k in range(1, 11)}


def test_word_counts_come_back(spark):
    out = tempfile.mkdtemp(prefix="simcheck-counts-") + "/c"
    FS.write_word_counts(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, cnt long"), out)
    assert [(r.word, r.cnt) for r in spark.read.json(out).orderBy(F.col("cnt").desc(), "word").collect()] == [("c", 9), ("a", 2), ("b", 2)]


def test_archives_are_packed_and_expanded_in_pieces(spark, monkeypatch):
    from simcheck.session import scratch_dir
    from simcheck.sources import files as FS
    rows = [(s, f"{s}_{i}.txt", None if i == 3 else f"é text {s} {i} " * i) for s in ("a", "b c", None) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, name string, text string").repartition(5)
    monkeypatch.setattr(FS, "MEMBER_BYTES", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = scratch_dir(spark, "zips")
        assert FS.write_zip_archives(df, "source", "name", "text", out) == 3
        want = sorted((f"{s}.zip", n, (t or "").encode()) for s, n, t in rows)
        for content in (False, True):
            got = FS.expand_archives(FS.scan_files(spark, out, glob="*.zip", with_content=content)).collect()
            assert sorted((r.archive.split("/")[-1], r.member, bytes(r.content)) for r in got) == want
            assert all(r.size == len(r.content) for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
