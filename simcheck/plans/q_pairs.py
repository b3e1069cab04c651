"""Registered queries: document pairs (J8, A5, T3, J11, A9) and the paper path
(J10, A6, A7, A11, T2, J19, A10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.operators import sentences as S
from simcheck.operators.similarity import best_per_group, pair_matches
from simcheck.plans import check as C
from simcheck.plans import sql as Q
from simcheck.plans import index as IX
from simcheck.plans.catalog import register
from simcheck.session import materialize
from simcheck.sources.tables import load

# ------------------------------------------------------------------ pairs


def _doc_totals(cs):
    return cs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n2"))


def pair_counts(spark, sf_dir, threshold: float = P.MATCH_THRESHOLD, strict: bool = False):
    """(doc1, doc2, matches, n2): sentences of doc2 whose best match in doc1 reaches t."""
    cv = IX.corpus_table(spark, sf_dir)
    cs = cv.select("doc_id", "sentence_index")
    m = pair_matches(cv, "doc_id", "sentence_index", threshold, strict=strict)
    return m.join(_doc_totals(cs).withColumnRenamed("doc_id", "doc2"), "doc2")


def _pairs_sql(op: str) -> str:
    return (
        f"WITH cs AS ({Q.kept_sentences('documents', 'doc_id')}), cv AS ({Q.encode('SELECT * FROM cs')}), "
        "pairs AS (SELECT a.doc_id AS doc1, b.doc_id AS doc2, b.sentence_index AS idx2 "
        f"FROM cv a JOIN cv b ON a.doc_id < b.doc_id WHERE {Q.cos('a.vec', 'b.vec')} {op} {P.MATCH_THRESHOLD}), "
        "m AS (SELECT doc1, doc2, count(DISTINCT idx2) AS matches FROM pairs GROUP BY doc1, doc2), "
        "tot AS (SELECT doc_id, count(*) AS n2 FROM cs GROUP BY doc_id), "
        "pc AS (SELECT m.doc1, m.doc2, m.matches, tot.n2 FROM m JOIN tot ON tot.doc_id = m.doc2) ")


@register("pair_similarity", sql=_pairs_sql(">=") + (
    "SELECT doc1, doc2, matches, n2, round(matches / n2 * 100, 6) AS similarity FROM pc"))
def pair_similarity(spark, sf_dir):
    """Every document pair with a matching sentence; percent over doc2."""
    pc = pair_counts(spark, sf_dir)
    return pc.select("doc1", "doc2", "matches", "n2",
                     F.round(F.col("matches") / F.col("n2") * 100, 6).alias("similarity"))


@register("similar_pairs", sql=_pairs_sql(">=") + (
    "SELECT doc1, doc2, matches, round(matches / n2 * 100, 6) AS similarity FROM pc "
    f"WHERE matches / n2 * 100 >= {P.PAIR_MIN_PERCENT}"))
def similar_pairs_ranked(spark, sf_dir, min_percent: float = P.PAIR_MIN_PERCENT):
    """Pairs at or above 20 %, ordered by (percent, matches, doc1, doc2) desc.

    The filter runs before the global sort, so only qualifying pairs are ordered.
    """
    pc = pair_counts(spark, sf_dir)
    pct = F.col("matches") / F.col("n2") * 100
    return (pc.where(pct >= min_percent)
            .select("doc1", "doc2", "matches", F.round(pct, 6).alias("similarity"))
            .orderBy(F.col("similarity").desc(), F.col("matches").desc(),
                     F.col("doc1").desc(), F.col("doc2").desc()))


@register("two_doc_matches", sql=_pairs_sql(">") + (
    "SELECT doc1, doc2, matches, round(matches / n2, 6) AS avg_matches FROM pc"))
def two_doc_matches(spark, sf_dir):
    """Strict (> 0.9) arg-max matches of doc2 in doc1, and their mean per sentence."""
    pc = pair_counts(spark, sf_dir, strict=True)
    return pc.select("doc1", "doc2", "matches",
                     F.round(F.col("matches") / F.col("n2"), 6).alias("avg_matches"))


# ------------------------------------------------------------- paper path

def doc_best(spark, sf_dir, threshold: float = P.PAPER_THRESHOLD):
    """Per (submitted sentence, corpus document): best cosine >= t and first arg-max."""
    inp = C.Inputs.read(spark, sf_dir)
    qv = C.query_vectors(inp.benchmark)
    cs = IX.corpus_sentences(spark, sf_dir)
    return materialize(best_per_group(qv, cs, ["item_id", "q_index"], "doc_id", "sentence_index",
                                      threshold, c_text="sentence"))


_PAPER = (
    f"WITH {Q.base_ctes()}, "
    "sc AS (SELECT q.item_id, q.q_index, c.doc_id, c.sentence_index, "
    f"{Q.cos('q.vec', 'c.vec')} AS score FROM qv q, cv c), "
    "best AS (SELECT item_id, q_index, doc_id, score, sentence_index AS arg FROM ("
    "SELECT *, row_number() OVER (PARTITION BY item_id, q_index, doc_id ORDER BY score DESC, sentence_index) AS rn "
    f"FROM sc WHERE score >= {P.PAPER_THRESHOLD}) WHERE rn = 1), "
    "dvc AS (SELECT b.item_id, b.doc_id, count(*) AS matches, qt.n_sentences, "
    "trunc(count(*) * 100 / qt.n_sentences)::INTEGER AS pct FROM best b JOIN qt ON qt.item_id = b.item_id "
    "GROUP BY b.item_id, b.doc_id, qt.n_sentences) ")


def _doc_vs_corpus(spark, sf_dir, best=None):
    """Percent per (submission, document); ``best`` passes on matches that were already found."""
    best = doc_best(spark, sf_dir) if best is None else best
    qt = C.query_totals(load(spark, sf_dir, "benchmark"))
    return (best.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("matches"))
            .join(qt, "item_id")
            .withColumn("pct", (F.col("matches") * 100 / F.col("n_sentences")).cast("int")))


@register("column_argmax", sql=_PAPER + "SELECT item_id, q_index, doc_id, score, arg FROM best")
def column_argmax(spark, sf_dir):
    """Per (submitted sentence, document) max cosine (>= 0.8) and its first arg-max."""
    return doc_best(spark, sf_dir)


@register("doc_vs_corpus", sql=_PAPER + "SELECT item_id, doc_id, matches, n_sentences, pct FROM dvc")
def doc_vs_corpus(spark, sf_dir):
    """int(matches * 100 / n) per (submission, corpus document) with a match."""
    return _doc_vs_corpus(spark, sf_dir).select("item_id", "doc_id", "matches", "n_sentences", "pct")


_ROUNDED = (
    ", md AS (SELECT b.item_id, count(DISTINCT qs.sentence) AS m FROM best b JOIN qs "
    "ON qs.item_id = b.item_id AND qs.q_index = b.q_index GROUP BY b.item_id), "
    "tr AS (SELECT qt.item_id, coalesce(md.m, 0) AS m, qt.n_sentences, "
    "trunc(round_even(coalesce(md.m, 0) / qt.n_sentences, 2) * 100)::INTEGER AS total_percent "
    "FROM qt LEFT JOIN md ON md.item_id = qt.item_id) ")


def _total_rounded(spark, sf_dir, best=None):
    best = doc_best(spark, sf_dir) if best is None else best
    bench = load(spark, sf_dir, "benchmark")
    qs = S.query_sentences(bench)
    md = (best.select("item_id", "q_index").join(qs, ["item_id", "q_index"])
          .groupBy("item_id").agg(F.countDistinct("sentence").alias("m")))
    m = F.coalesce(F.col("m"), F.lit(0))
    return (C.query_totals(bench).join(md, "item_id", "left")
            .select("item_id", m.alias("m"), "n_sentences",
                    (F.bround(m / F.col("n_sentences"), 2) * 100).cast("int").alias("total_percent")))


@register("total_percent_rounded", sql=_PAPER + _ROUNDED + "SELECT * FROM tr")
def total_percent_rounded(spark, sf_dir):
    """Distinct matched sentences over all documents, int(round(m/n, 2) * 100)."""
    return _total_rounded(spark, sf_dir)


_TOP5P = ("top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pct DESC, doc_id DESC)::INTEGER "
          "AS rank FROM dvc) ")


def _top5_percent(spark, sf_dir, best=None):
    w = Window.partitionBy("item_id").orderBy(F.col("pct").desc(), F.col("doc_id").desc())
    return (_doc_vs_corpus(spark, sf_dir, best).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= P.TOP_DOCUMENTS))


@register("top5_percent", sql=_PAPER + ", " + _TOP5P + "SELECT item_id, doc_id, pct, rank FROM top WHERE rank <= 5")
def top5_percent(spark, sf_dir):
    """Five corpus documents with the highest percent (ties: higher doc_id first)."""
    return _top5_percent(spark, sf_dir).select("item_id", "doc_id", "pct", "rank")


@register("top_docs_sentences", sql=_PAPER + ", " + _TOP5P + (
    "SELECT DISTINCT t.item_id, t.doc_id, t.rank, qs.sentence FROM top t "
    "JOIN best b ON b.item_id = t.item_id AND b.doc_id = t.doc_id "
    "JOIN qs ON qs.item_id = b.item_id AND qs.q_index = b.q_index WHERE t.rank <= 5"))
def top_docs_sentences(spark, sf_dir):
    """The top-5 documents joined with their distinct matched sentences."""
    best = doc_best(spark, sf_dir)
    top = _top5_percent(spark, sf_dir, best).select("item_id", "doc_id", "rank")
    qs = S.query_sentences(load(spark, sf_dir, "benchmark"))
    return (top.join(best, ["item_id", "doc_id"]).join(qs, ["item_id", "q_index"])
            .select("item_id", "doc_id", "rank", "sentence").distinct())


# ------------------------------------- paper path on its own sentence list

def _chunks_sql(table: str, id_col: str, idx: str, name: str) -> str:
    """CTEs {name}_s (all sentences), {name} (numbered P4+P5 chunks)."""
    return (
        f"{name}_s AS ({Q.split_sentences(table, id_col)}), "
        f"{name}_w AS (SELECT {id_col}, pos, unnest(ws) AS word, unnest(range(len(ws))) AS wi FROM (SELECT {id_col}, pos, "
        f"string_split(sentence, ' ') AS ws FROM {name}_s WHERE {Q.space_pieces('sentence')} > {P.PAPER_MIN_PIECES})), "
        f"{name}_l AS (SELECT *, len(string_split(word, '_')) AS l FROM {name}_w), "
        f"{name}_r({id_col}, pos, wi, chunk, n) AS (SELECT {id_col}, pos, wi, 0, l FROM {name}_l WHERE wi = 0 UNION ALL "
        f"SELECT r.{id_col}, r.pos, w.wi, CASE WHEN r.n + w.l > {P.CHUNK_MAX_SUBTOKENS} THEN r.chunk + 1 ELSE r.chunk END, "
        f"CASE WHEN r.n + w.l > {P.CHUNK_MAX_SUBTOKENS} THEN w.l ELSE r.n + w.l END FROM {name}_r r JOIN {name}_l w "
        f"ON w.{id_col} = r.{id_col} AND w.pos = r.pos AND w.wi = r.wi + 1), "
        f"{name} AS (SELECT {id_col}, (row_number() OVER (PARTITION BY {id_col} ORDER BY pos, chunk) - 1)::INTEGER AS {idx}, "
        f"sentence FROM (SELECT r.{id_col}, r.pos, r.chunk, string_agg(w.word, ' ' ORDER BY w.wi) AS sentence "
        f"FROM {name}_r r JOIN {name}_l w ON w.{id_col} = r.{id_col} AND w.pos = r.pos AND w.wi = r.wi "
        f"GROUP BY r.{id_col}, r.pos, r.chunk))")


_CHUNKED = (
    f"WITH RECURSIVE {_chunks_sql('documents', 'doc_id', 'sentence_index', 'pd')}, "
    f"{_chunks_sql('benchmark', 'item_id', 'q_index', 'pq')}, "
    f"pv AS ({Q.encode('SELECT * FROM pd')}), qv AS ({Q.encode('SELECT * FROM pq')}), "
    "na AS (SELECT item_id, count(*) AS n_all FROM pq_s GROUP BY item_id), "
    "nk AS (SELECT item_id, count(*) AS n_kept FROM pq GROUP BY item_id), "
    "best AS (SELECT DISTINCT q.item_id, q.q_index, c.doc_id FROM qv q, pv c "
    f"WHERE {Q.cos('q.vec', 'c.vec')} >= {P.PAPER_THRESHOLD}) ")


def _chunk_matches(spark, sf_dir):
    """(item_id, q_index, n_all, sentence) of the submissions' chunks and their matches per document."""
    inp = C.Inputs.read(spark, sf_dir)
    q = materialize(S.paper_chunks(inp.benchmark, "item_id", "q_index"))
    best = best_per_group(S.encode(q), S.paper_chunks(inp.documents, "doc_id"), ["item_id", "q_index"],
                          "doc_id", "sentence_index", P.PAPER_THRESHOLD, c_text="sentence")
    return q, materialize(best.select("item_id", "q_index", "doc_id"))


def _denominators(q):
    return q.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_kept"), F.first("n_all").alias("n_all"))


@register("paper_doc_percent", sql=_CHUNKED + (
    "SELECT b.item_id, b.doc_id, b.matches, n_kept, n_all, trunc(matches * 100 / n_kept)::INTEGER AS pct_kept, "
    "trunc(matches * 100 / n_all)::INTEGER AS pct_all FROM (SELECT item_id, doc_id, count(*) AS matches FROM best "
    "GROUP BY item_id, doc_id) b JOIN nk ON nk.item_id = b.item_id JOIN na ON na.item_id = b.item_id"))
def paper_doc_percent(spark, sf_dir):
    """J10/A6 on the research path's own sentences: int(matches * 100 / n) per document,
    over the kept chunks and over all sentences."""
    q, best = _chunk_matches(spark, sf_dir)
    pct = lambda n: (F.col("matches") * 100 / F.col(n)).cast("int")
    return (best.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("matches")).join(_denominators(q), "item_id")
            .select("item_id", "doc_id", "matches", "n_kept", "n_all", pct("n_kept").alias("pct_kept"),
                    pct("n_all").alias("pct_all")))


@register("paper_total_percent", sql=_CHUNKED + (
    ", m AS (SELECT b.item_id, count(DISTINCT q.sentence) AS m FROM best b JOIN pq q ON q.item_id = b.item_id "
    "AND q.q_index = b.q_index GROUP BY b.item_id) "
    "SELECT nk.item_id, coalesce(m.m, 0) AS m, n_kept, n_all, "
    "trunc(round_even(coalesce(m.m, 0) / n_kept, 2) * 100)::INTEGER AS percent_kept, "
    "trunc(round_even(coalesce(m.m, 0) / n_all, 2) * 100)::INTEGER AS percent_all "
    "FROM nk JOIN na ON na.item_id = nk.item_id LEFT JOIN m ON m.item_id = nk.item_id"))
def paper_total_percent(spark, sf_dir):
    """A7 on the research path's own sentences: distinct matched chunks over all documents,
    int(round(m / n, 2) * 100) over the kept chunks and over all sentences."""
    q, best = _chunk_matches(spark, sf_dir)
    m = (best.select("item_id", "q_index").distinct().join(q, ["item_id", "q_index"])
         .groupBy("item_id").agg(F.countDistinct("sentence").alias("m")))
    found = F.coalesce("m", F.lit(0))
    pct = lambda n: (F.bround(found / F.col(n), 2) * 100).cast("int")
    return _denominators(q).join(m, "item_id", "left").select(
        "item_id", found.alias("m"), "n_kept", "n_all", pct("n_kept").alias("percent_kept"), pct("n_all").alias("percent_all"))


def band_of(pct):
    lo, mid, hi = P.SCORE_BANDS
    return (F.when(pct <= lo, F.lit(lo)).when(pct <= mid, F.lit(mid))
            .when(pct <= hi, F.lit(hi)))


@register("score_bands", sql=_PAPER + _ROUNDED + (
    "SELECT band, count(*) AS n, round(sum(total_percent) / (band * count(*)), 6) AS ratio FROM ("
    f"SELECT total_percent, CASE WHEN total_percent <= {P.SCORE_BANDS[0]} THEN {P.SCORE_BANDS[0]} "
    f"WHEN total_percent <= {P.SCORE_BANDS[1]} THEN {P.SCORE_BANDS[1]} "
    f"WHEN total_percent <= {P.SCORE_BANDS[2]} THEN {P.SCORE_BANDS[2]} END AS band FROM tr) "
    "WHERE band IS NOT NULL GROUP BY band"))
def score_bands(spark, sf_dir):
    """A10: predicted percents banded at 30/60/90; ratio = sum / (bound * count).

    Scores above the last bound are dropped; an empty band has no row.
    """
    tr = _total_rounded(spark, sf_dir).withColumn("band", band_of(F.col("total_percent")))
    return (tr.where(F.col("band").isNotNull()).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.sum("total_percent") / (F.col("band") * F.count(F.lit(1))), 6).alias("ratio")))
