"""Check submitted texts against the corpus (the service's main question).

requests/benchmark -> sentences -> vectors -> exact top-1 (J1) -> >= 0.9
-> document lookup (J5) -> per-document counts (A1), percents (A2/A3/A4),
top-5 documents (T1).  Many submissions are checked in one job; every
per-submission step is a group-by on ``item_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.operators import sentences as S
from simcheck.operators.similarity import nearest
from simcheck.session import materialize
from simcheck.sources.tables import load


@dataclass
class Inputs:
    documents: DataFrame
    benchmark: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, sf_dir: str) -> "Inputs":
        return cls(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def corpus_vectors(documents: DataFrame) -> DataFrame:
    return S.encode(S.corpus_sentences(documents))


def query_vectors(benchmark: DataFrame) -> DataFrame:
    return S.encode(S.query_sentences(benchmark))


def top1_hits(qv: DataFrame, cv: DataFrame, threshold: float = P.MATCH_THRESHOLD,
              c_text: str | None = None) -> DataFrame:
    """Best corpus sentence per query sentence, kept when score >= threshold."""
    return (nearest(qv, cv, ["item_id", "q_index"], ["doc_id", "sentence_index"],
                    k=1, threshold=threshold, c_text=c_text)
            .drop("rank"))


def hits(spark: SparkSession, sf_dir: str, threshold: float = P.MATCH_THRESHOLD) -> DataFrame:
    """Top-1 hits, computed once (checkpointed: one row per query sentence at most)."""
    inp = Inputs.read(spark, sf_dir)
    from simcheck.plans.index import corpus_sentences
    return materialize(top1_hits(query_vectors(inp.benchmark), corpus_sentences(spark, sf_dir), threshold, "sentence"))


def query_totals(benchmark: DataFrame) -> DataFrame:
    """Kept sentences per submission (duplicates counted)."""
    return (S.query_sentences(benchmark).groupBy("item_id")
            .agg(F.count(F.lit(1)).alias("n_sentences")))


def matches_per_doc(h: DataFrame) -> DataFrame:
    """A1: matched query sentences per (submission, document), duplicates kept."""
    return (h.groupBy("item_id", "doc_id")
            .agg(F.count(F.lit(1)).alias("n_matches"), F.min("q_index").alias("first_q")))


def total_percent(h: DataFrame, benchmark: DataFrame, as_float: bool = False) -> DataFrame:
    """A2/A3: distinct matched sentence texts over all kept sentences."""
    qs = S.query_sentences(benchmark)
    matched = (h.select("item_id", "q_index").join(qs, ["item_id", "q_index"])
               .groupBy("item_id").agg(F.countDistinct("sentence").alias("n_distinct")))
    pct = (F.coalesce(F.col("n_distinct"), F.lit(0)) / F.col("n_sentences")) * 100
    out = query_totals(benchmark).join(matched, "item_id", "left")
    col = pct if as_float else pct.cast("int")
    name = "total_percent_float" if as_float else "total_percent"
    return out.select("item_id", "n_sentences",
                      F.coalesce(F.col("n_distinct"), F.lit(0)).cast("bigint").alias("n_matched"),
                      col.alias(name))


def doc_similarity(h: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A4: min(int(matches / total * 100), 100) per (submission, document)."""
    m = matches_per_doc(h).join(query_totals(benchmark), "item_id")
    val = F.when(F.col("n_sentences") > 0,
                 F.least((F.col("n_matches") / F.col("n_sentences") * 100).cast("int"), F.lit(100))
                 ).otherwise(F.lit(0))
    return m.select("item_id", "doc_id", "n_matches", "n_sentences", val.alias("similarity_value"))


def top_documents(h: DataFrame, n: int = P.TOP_DOCUMENTS) -> DataFrame:
    """Top-n documents per submission by match count; ties keep first-match order."""
    w = Window.partitionBy("item_id").orderBy(F.col("n_matches").desc(), F.col("first_q").asc())
    return (matches_per_doc(h).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n))


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per submission, its top-5 source documents with percents."""
    inp = Inputs.read(spark, sf_dir)
    h = hits(spark, sf_dir)
    top = top_documents(h)
    tot = total_percent(h, inp.benchmark)
    return (top.join(tot.select("item_id", "n_sentences", "total_percent"), "item_id")
            .select("item_id", "rank", "doc_id", "n_matches",
                    F.least((F.col("n_matches") / F.col("n_sentences") * 100).cast("int"),
                            F.lit(100)).alias("similarity_value"),
                    "total_percent"))
