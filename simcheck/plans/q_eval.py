"""Registered queries: evaluation-set construction."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import text as TX
from simcheck.functions.ordering import global_row_number, ntile_from_position
from simcheck.operators import pages as PG
from simcheck.operators import sentences as S
from simcheck.plans import sql as Q
from simcheck.plans import index as IX
from simcheck.plans.catalog import register
from simcheck.session import materialize, scratch_dir
from simcheck.sources.files import load_sentence_list, write_parts
from simcheck.sources.tables import load

SEED = "42"
# Sentences drawn per document; small enough that most documents have more
SAMPLE_PER_DOC = 10


def _cs(spark, sf_dir):
    return IX.corpus_sentences(spark, sf_dir)


def seeds(cs):
    """Paraphrase seeds: distinct corpus sentences that pass the P7 filter."""
    return cs.where(TX.is_clean_sentence("sentence", P.NOISE_SEEDS, True)).select("sentence").distinct()


_CS = f"WITH cs AS ({Q.kept_sentences('documents', 'doc_id')}) "
_SEEDS_SQL = (f", seeds AS (SELECT DISTINCT sentence FROM cs WHERE {Q.space_pieces('sentence')} > "
              f"{P.NOISE_MIN_PIECES} AND NOT {Q.contains_any('sentence', P.NOISE_SEEDS)} "
              "AND NOT regexp_matches(sentence, '[0-9]')) ")


@register("distinct_sentences", sql=_CS + "SELECT DISTINCT sentence FROM cs")
def distinct_sentences(spark, sf_dir):
    """The distinct union of sentences over all documents."""
    return _cs(spark, sf_dir).select("sentence").distinct()


@register("exclude_seeds", sql=_CS + _SEEDS_SQL + (
    "SELECT doc_id, sentence_index, sentence FROM cs WHERE sentence NOT IN (SELECT sentence FROM seeds)"))
def exclude_seeds(spark, sf_dir):
    """Corpus sentences minus the seeds (anti-join keeps duplicates, unlike EXCEPT)."""
    cs = _cs(spark, sf_dir)
    return cs.join(seeds(cs), "sentence", "left_anti").select("doc_id", "sentence_index", "sentence")


@register("split_parts", sql=_CS + _SEEDS_SQL + (
    f"SELECT sentence, ntile({P.SPLIT_PARTS}) OVER (ORDER BY sentence)::INTEGER AS part FROM seeds"))
def split_parts(spark, sf_dir):
    """Seeds in 10 contiguous balanced parts (exactly ntile(10)), no single-task window."""
    s = seeds(_cs(spark, sf_dir))
    numbered = global_row_number(s, [F.col("sentence")], "pos")
    total = numbered.count()
    return numbered.select("sentence", ntile_from_position("pos", total, P.SPLIT_PARTS).alias("part"))


@register("part_files", sql=_CS + _SEEDS_SQL + (
    f"SELECT sentence, ntile({P.SPLIT_PARTS}) OVER (ORDER BY sentence)::INTEGER AS part FROM seeds"))
def part_files(spark, sf_dir):
    """K6: the parts written as ten files and read back."""
    s = seeds(_cs(spark, sf_dir))
    numbered = global_row_number(s, [F.col("sentence")], "pos")
    total = numbered.count()
    out = scratch_dir(spark, "parts")
    write_parts(numbered.withColumn("part", ntile_from_position("pos", total, P.SPLIT_PARTS)), out, "part", "pos")
    return load_sentence_list(spark, f"{out}/part=*").select(
        "sentence", F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("int").alias("part"))


def _hash_key(*cols):
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.col(c).cast("string") for c in cols]))


@register("sample_sentences", sql=_CS + (
    "SELECT doc_id, sentence_index, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id "
    f"ORDER BY md5('{SEED}|' || doc_id::VARCHAR || '|' || sentence_index::VARCHAR)) AS rn FROM cs) "
    f"WHERE rn <= {SAMPLE_PER_DOC}"))
def sample_sentences(spark, sf_dir):
    """Seeded sample without replacement, exact size per document (md5 order).

    ``row_number() <= n`` is pre-limited per map partition (WindowGroupLimit),
    so even a very large document sends at most n rows per partition.
    """
    cs = _cs(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy(_hash_key("doc_id", "sentence_index"))
    return (cs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SAMPLE_PER_DOC)
            .select("doc_id", "sentence_index", "sentence"))


# K7 parts, in the order they stand in a document: untouched corpus sentences,
# near copies of paraphrase seeds, fresh sentences.
PARTS = ("in", "near", "fresh")
DOCS_PER_SHARE = 10


def part_size(part: str, share: int, avg: int) -> int:
    return int(avg * (100 - share) / 100) if part == "fresh" else int(avg * share / 100 / 2)


def _offset(eval_id: int, share: int, part: str) -> int:
    return int(hashlib.md5(f"{SEED}|{eval_id}|{share}|{part}".encode()).hexdigest()[:8], 16)


def _step(n: int) -> int:
    """A stride without a common factor with n, so that n strides visit every position once."""
    s = max(1, n * 618 // 1000)
    while math.gcd(s, n) != 1:
        s += 1
    return s


def near_copy(sentence: str = "sentence"):
    """Default stand-in for a paraphrase: the sentence without its first word."""
    return F.regexp_replace(sentence, "^[^ ]+ ", "")


def eval_lists(spark, sf_dir):
    """The three sentence lists, each numbered from 0 in text order.

    Lists meet the different corpus sentences, so a frequent one is a single row of its task.
    """
    cs = materialize(_cs(spark, sf_dir).select("sentence").distinct())
    seed = materialize(seeds(cs))
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    fresh = S.kept_sentences(PG.assemble(conv, "conv_id", "turn", "text"), "conv_id", min_words=1)
    lists = {"in": cs.join(seed, "sentence", "left_anti"), "near": seed,
             "fresh": fresh.select("sentence").distinct().join(cs, "sentence", "left_anti")}
    out = {p: global_row_number(df, [F.col("sentence")], "pos").withColumn("pos", F.col("pos") - 1)
           for p, df in lists.items()}
    return out | {"near": out["near"].withColumn("sentence", near_copy())}


def _parts_sql(avg: int) -> str:
    """The wanted (eval_id, share, part, part_no, k, n, offset) as a VALUES list with its sizes."""
    rows = [f"({e}, {share}, '{p}', {i}, {part_size(p, share, avg)}, {_offset(e, share, p)})"
            for share in P.EVAL_SHARES for e in range(DOCS_PER_SHARE) for i, p in enumerate(PARTS)]
    return ("want AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(eval_id, share, part, part_no, size, off))")


_FRESH_SQL = (
    f"conv AS (SELECT conv_id, trim(string_agg({Q.clean('text')}, ' ' ORDER BY turn)) AS text FROM conversations "
    "GROUP BY conv_id), "
    "fr AS (SELECT DISTINCT unnest(list_filter(" + Q.pieces(Q.clean("text")) +
    f", lambda s: s <> '' AND NOT {Q.boilerplate('s', None, 1)})) AS sentence FROM conv)")


@register("build_eval_docs", sql=_CS + _SEEDS_SQL + ", " + _FRESH_SQL + ", " + _parts_sql(P.EVAL_AVG_SENTENCES) + (
    ", lists AS ("
    "SELECT 'in' AS part, sentence, row_number() OVER (ORDER BY sentence) - 1 AS pos FROM (SELECT DISTINCT sentence "
    "FROM cs WHERE sentence NOT IN (SELECT sentence FROM seeds)) UNION ALL "
    "SELECT 'near', regexp_replace(sentence, '^[^ ]+ ', ''), row_number() OVER (ORDER BY sentence) - 1 FROM seeds "
    "UNION ALL SELECT 'fresh', sentence, row_number() OVER (ORDER BY sentence) - 1 FROM (SELECT sentence FROM fr "
    "WHERE sentence NOT IN (SELECT sentence FROM cs))), "
    "ln AS (SELECT part, count(*) AS n FROM lists GROUP BY part), "
    "st AS (SELECT part, n, list_filter(range(greatest(1, n * 618 // 1000), n + 2), lambda s: gcd(s, n) = 1)[1] AS step "
    "FROM ln), "
    "pick AS (SELECT w.eval_id, w.share, w.part, w.part_no, k, (w.off + k * st.step) % st.n AS pos FROM "
    "(SELECT want.*, unnest(range(size)) AS k FROM want) w JOIN st ON st.part = w.part WHERE k < st.n) "
    "SELECT p.eval_id::INTEGER AS eval_id, p.share::INTEGER AS share, "
    "count(*) FILTER (p.part = 'in') AS n_in, count(*) FILTER (p.part = 'near') AS n_near, "
    "count(*) FILTER (p.part = 'fresh') AS n_fresh, string_agg(l.sentence, ' ' ORDER BY p.part_no, p.k) AS text "
    "FROM pick p JOIN lists l ON l.part = p.part AND l.pos = p.pos GROUP BY p.eval_id, p.share"))
def build_eval_docs(spark, sf_dir, avg: int = P.EVAL_AVG_SENTENCES):
    """Labelled test documents with a known copy share (30/60/90 %).

    Ten documents a share: int(avg * share / 200) corpus sentences that are no
    paraphrase seeds, as many near copies of seeds, and int(avg * (100 - share)
    / 100) fresh sentences that the corpus does not hold.  Every part is drawn
    without replacement from its whole list, by strides through the numbered
    list, and found by an equi-join on the position; a list shorter than a part
    gives all it has.
    """
    lists = eval_lists(spark, sf_dir)
    found = []
    for no, part in enumerate(PARTS):
        numbered = lists[part]
        n = numbered.count()
        if not n:
            continue
        step = _step(n)
        want = [(e, share, k, (_offset(e, share, part) + k * step) % n) for share in P.EVAL_SHARES
                for e in range(DOCS_PER_SHARE) for k in range(min(n, part_size(part, share, avg)))]
        rows = spark.createDataFrame(want, "eval_id int, share int, k int, pos long")
        found.append(numbered.join(F.broadcast(rows), "pos")      # sizes are parameters, not data
                     .select("eval_id", "share", F.lit(no).alias("part"), "k", "sentence"))
    if not found:
        return spark.createDataFrame([], "eval_id int, share int, n_in long, n_near long, n_fresh long, text string")
    count = lambda i: F.sum((F.col("part") == i).cast("long"))
    return (reduce(DataFrame.unionByName, found).groupBy("eval_id", "share")
            .agg(F.sort_array(F.collect_list(F.struct("part", "k", "sentence"))).alias("s"),
                 count(0).alias("n_in"), count(1).alias("n_near"), count(2).alias("n_fresh"))
            .select("eval_id", "share", "n_in", "n_near", "n_fresh",
                    F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("text")))
