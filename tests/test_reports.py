"""Reports from the request stream, first-page sizes and location by word grams."""
import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from simcheck import params as P
from simcheck.functions import text as TX
from simcheck.operators import pages as PG
from simcheck.plans import index as IX
from simcheck.session import scratch_dir
from simcheck.sources.tables import load
from simcheck.streaming.jobs import check_stream, read_reports

SMOKE = "/root/testdata/sf0.001"


def reports(spark, out):
    return {r["file_check_id"]: r["report_json"] for r in read_reports(spark, out).collect()}


def test_streamed_reports_equal_the_batch_and_survive_a_replay(spark):
    folder = scratch_dir(spark, "requests")
    load(spark, SMOKE, "benchmark").repartition(2).write.parquet(f"{folder}/requests.parquet")
    corpus, out = IX.corpus_table(spark, SMOKE), scratch_dir(spark, "check")
    run = lambda: check_stream(spark, f"{folder}/requests.parquet/*.parquet", corpus, out, max_files=1, clock=lambda: 0.0)
    run()
    first = reports(spark, out)
    batch = {r["file_check_id"]: r["report_json"] for r in E.queries()["check_report_json"](spark, SMOKE).collect()}
    assert first == batch and len(batch) > 0
    runs = {f.split("run=")[1].split("/")[0] for f in spark.read.text(f"{out}/reports").inputFiles()}
    assert runs == {"0", "1"}
    run()                                           # nothing new: nothing is written twice
    assert reports(spark, out) == batch and read_reports(spark, out).count() == len(batch)


def test_report_carries_its_clock(spark):
    ticks = iter([1_700_000_000.0, 1_700_000_002.5])
    folder = scratch_dir(spark, "requests")
    load(spark, SMOKE, "benchmark").limit(3).coalesce(1).write.parquet(f"{folder}/requests.parquet")
    out = check_stream(spark, f"{folder}/requests.parquet/*.parquet", IX.corpus_table(spark, SMOKE), clock=lambda: next(ticks))
    for text in reports(spark, out).values():
        report = json.loads(text)
        assert report["create_at"] == "2023-11-14T22:13:20Z" and report["duration"] == 2.5
        assert set(report) == {"file_check_id", "data_result", "create_at", "total_similarity_percent", "height", "width", "duration"}
    stamp = spark.range(1).select(TX.job_id(F.timestamp_seconds(F.lit(1_700_000_000.0))).alias("j")).first()["j"]
    assert stamp == "20231114221320"


def test_first_page_sizes(spark):
    rows = [(1, "short"), (2, "x" * 200), (3, "\n".join(["l"] * 90)), (4, ""), (5, "\n" * 45 + "on page two")]
    lines = PG.page_lines(spark.createDataFrame(rows, "d long, text string"), "d")
    got = {r["d"]: (r["width"], r["height"]) for r in PG.page_sizes(lines, "d").collect()}
    assert got == {1: (P.PAGE_WIDTH, P.PAGE_HEIGHT), 2: (72 + 1200 + 72, P.PAGE_HEIGHT), 3: (P.PAGE_WIDTH, P.PAGE_HEIGHT)}


def test_location_equals_a_scan_of_all_pages(spark):
    rng = random.Random(2)
    words = ["a", "ab", "b", "cat", "scat", "dog.", "e"]
    docs, sentences = [], []
    for d in range(12):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 130))]
        docs.append((d, "\n".join(lines)))
        whole = " ".join(x for x in lines if x).split(" ")
        for i in range(40):
            at, n = rng.randrange(len(whole)), rng.choice([1, 3, 7, 8, 12, 30])
            s = " ".join(whole[at:at + n])
            if rng.random() < 0.3:
                s = s[1:-1] or s                    # begins or ends within a word
            sentences.append((d, i, s))
        sentences += [(d, 90, "no such words are on any page of this one"), (d, 91, "")]
    pt = PG.page_text(spark.createDataFrame(docs, "d long, text string"), "d")
    sent = spark.createDataFrame(sentences, "d long, i int, sentence string")
    texts = {}
    for r in pt.collect():
        texts.setdefault(r["d"], {})[r["page_num"]] = r["text"]
    want = {(d, i): sorted(p for p, t in texts.get(d, {}).items() if s in t) for d, i, s in sentences}
    every = {}
    for r in PG.locate(sent, pt, "d", "i", first_only=False).collect():
        every.setdefault((r["d"], r["i"]), []).append(r["page_num"])
    assert {k: sorted(v) for k, v in every.items()} == {k: v for k, v in want.items() if v}
    first = {(r["d"], r["i"]): r["page_num"] for r in PG.locate(sent, pt, "d", "i").collect()}
    assert first == {k: v[0] for k, v in want.items() if v}
    plan = PG.locate(sent, pt, "d", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains") >= 1 and "__g" in plan
