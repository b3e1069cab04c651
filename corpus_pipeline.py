"""Prepares a training corpus from ``documents`` in five stages.

Each stage reads what its predecessor kept and writes Parquet to the shared
folder; a lost executor costs at most the tasks of the stage that runs.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcheck.llm import bpe, line_dedup, mixing, near_dedup, quality
from simcheck.llm.common import bound_batches, small_or_shuffled, table
from simcheck.llm.queries import tokenizer_path
from simcheck.session import drop_folders, materialize, materialized, ship_package

#: Least shingle similarity, in percent, at which the near-dedup stage links documents; op4's own contract is 85.
NEAR_PERCENT = 80

_DONE: list[str] = []


def stage(fn):
    """A stage: ships the package and first deletes the tables that earlier stages wrote in between.

    Every stage's result is written before the next stage is called, so
    nothing reads those tables any more; without this they would add up over
    the stages.
    """
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        drop_folders(spark, _DONE)
        _DONE.clear()
        with materialized() as made:
            out = fn(spark, docs, sf_dir)
        _DONE.extend(made)
        return out
    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.keep_good(docs, model)


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: the text is what is left of it, n_chars its new length."""
    other = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in other]) if other else F.lit(0)
    done = line_dedup.line_dedup(docs.select("doc_id", "text", row.alias("row")))
    cut = F.col("n_dropped") > 0
    new = {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    new |= {c: F.col("row")[c] for c in other}
    if "n_chars" in new:
        new["n_chars"] = F.when(cut, F.char_length("kept_text").cast("long")).otherwise(new["n_chars"])
    return done.select(*[new[c].alias(c) for c in docs.columns])


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup at similarity 0.8: the document with the smallest id of each component stays."""
    found = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=NEAR_PERCENT)
    gone = materialize(found.filter("not kept").select(F.coalesce("doc_id", F.lit(near_dedup.NO_ID)).alias("gone"))
                       .distinct())
    key = F.coalesce("row.doc_id", F.lit(near_dedup.NO_ID))
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(small_or_shuffled(gone, 24), key == F.col("gone"), "left_anti").select("row.*")


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Curriculum mix: documents in training order, once for each pass that takes them."""
    return mixing.assemble(docs, materialize(mixing.mix(docs)))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: token ids of each document, and digests of them and of the decoded text."""
    done = bpe.encode(docs, tokenizer_path(), with_text=True)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier and the shingle links are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = materialize(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
