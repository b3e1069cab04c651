"""Nested report output (K4, K4b, A21, G3 report) with ``to_json``.

Rows are repartitioned once by the report key; every later group-by uses a
superset of that key, so the whole nesting runs without further shuffles.
Each report covers one submission, so no group grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simcheck import params as P


def nest_pages(rows: DataFrame, key: str, doc_col: str | None, page_col: str,
               item_fields: list[str], page_name: str, items_name: str) -> DataFrame:
    """Group (key[, doc], page, item...) rows into key[, doc] -> pages[] -> items[].

    Items of a page stand in the order of ``q_index``, that of the first match.
    """
    keys = [key] + ([doc_col] if doc_col else [])
    ordered = F.sort_array(F.collect_list(F.struct("q_index", F.struct(*item_fields).alias("item"))))
    pages = (rows.groupBy(*keys, page_col)
             .agg(F.transform(ordered, lambda x: x["item"]).alias(items_name)))
    return (pages.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(page_col).alias(page_name), items_name)))
                 .alias("page_result")))


def check_report(boxes: DataFrame, docs: DataFrame, totals: DataFrame, sizes: DataFrame, created_at: Column,
                 duration: float) -> DataFrame:
    """K4: one JSON report per file_check_id.

    ``boxes``: (item_id, doc_id, page_num, sentence, q_index, box_no, x0, y0, x1, y1)
    ``docs``: (item_id, doc_id, rank, similarity_value)
    ``totals``: (item_id, total_percent)
    ``sizes``: (item_id, width, height) of first pages; A4 where there is none
    """
    b = boxes.repartition("item_id")
    content = (b.groupBy("item_id", "doc_id", "page_num", "sentence", "q_index")
               .agg(F.sort_array(F.collect_list(F.struct("box_no", F.array("x0", "y0", "x1", "y1").alias("r"))))
                    .alias("bx"))
               .select("item_id", "doc_id", "page_num", "q_index", F.col("sentence").alias("content"),
                       F.transform("bx", lambda x: x["r"]).alias("rects")))
    pages = nest_pages(content, "item_id", "doc_id", "page_num", ["content", "rects"],
                       "pageNumber", "similarity_content")
    per_doc = docs.join(pages, ["item_id", "doc_id"], "left").select(
        "item_id", "rank", F.struct(
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_resource_id"),
            "similarity_value",
            F.coalesce("page_result", F.array().cast(pages.schema["page_result"].dataType)).alias("page_result"),
        ).alias("d"))
    data = (per_doc.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "d"))).alias("dd"))
            .select("item_id", F.transform("dd", lambda x: x["d"]).alias("data_result")))
    rep = totals.join(data, "item_id", "left").join(sizes, "item_id", "left").select(
        F.concat(F.lit("chk_"), F.col("item_id").cast("string")).alias("file_check_id"),
        F.struct(
            F.concat(F.lit("chk_"), F.col("item_id").cast("string")).alias("file_check_id"),
            F.coalesce("data_result", F.array().cast(data.schema["data_result"].dataType)).alias("data_result"),
            created_at.alias("create_at"),
            F.col("total_percent").alias("total_similarity_percent"),
            F.coalesce("height", F.lit(P.PAGE_HEIGHT)).alias("height"),
            F.coalesce("width", F.lit(P.PAGE_WIDTH)).alias("width"),
            F.lit(float(duration)).alias("duration"),
        ).alias("report"))
    return rep.select("file_check_id", F.to_json("report").alias("report_json"))


def write_reports(reports: DataFrame, path: str, run_id: str) -> None:
    """K4 sink: the reports of one run as JSON lines under ``run=<run_id>``.

    Only that partition is overwritten, so writing a run again is idempotent
    and the reports of other runs stay; a run is one folder, not one per check.
    """
    (reports.select(F.lit(run_id).alias("run"), F.col("report_json").alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").text(path))
