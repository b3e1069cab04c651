"""Registered queries: encoder, cosine, exact vector search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import vectors as V
from simcheck.operators import sentences as S
from simcheck.operators.similarity import nearest
from simcheck.plans import check as C
from simcheck.plans import sql as Q
from simcheck.plans import index as IX
from simcheck.plans.catalog import register
from simcheck.sources.tables import load


@register("encode_sentences", sql=(
    f"WITH cs AS ({Q.kept_sentences('documents', 'doc_id')}), cv AS ({Q.encode('SELECT * FROM cs')}) "
    "SELECT doc_id, sentence_index, (d - 1)::INTEGER AS dim, round(w::DOUBLE, 6) AS weight FROM ("
    "SELECT doc_id, sentence_index, unnest(vec) AS w, unnest(range(1, len(vec) + 1)) AS d FROM cv) "
    "WHERE w <> 0"))
def encode_sentences(spark, sf_dir):
    """U1 default encoder, emitted in sparse form (non-zero dimensions only)."""
    cv = C.corpus_vectors(load(spark, sf_dir, "documents"))
    return (cv.select("doc_id", "sentence_index", F.posexplode("vec").alias("dim", "w"))
            .where(F.col("w") != 0)
            .select("doc_id", "sentence_index", "dim",
                    F.round(F.col("w").cast("double"), 6).alias("weight")))


@register("cosine", sql=(
    "SELECT a.vec_id, b.vec_id AS next_id, "
    "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"))
def cosine(spark, sf_dir):
    """U7 native cosine expression on consecutive vectors of the collection."""
    e = load(spark, sf_dir, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                 F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", "next_id",
                                      F.round(V.cosine("a", "b"), 6).alias("cos"))


@register("top1_match", sql=(
    f"WITH {Q.base_ctes()}, {Q.top1_cte()} SELECT * FROM hits"))
def top1_match(spark, sf_dir):
    """Best corpus sentence per submitted sentence, kept when >= 0.9."""
    return C.hits(spark, sf_dir)


def _embedding_rows(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").alias("vec"))


QUERY_STEP = 50


def stated_queries(e):
    """The query set of the vector searches: ids divisible by 50, against all vectors."""
    return e.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "label", "vec")


_TOPK_SQL = (
    "SELECT query_id, vec_id, score, rank FROM ("
    "SELECT q.vec_id AS query_id, c.vec_id, "
    "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY "
    "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC, c.vec_id)::INTEGER AS rank "
    f"FROM embeddings q JOIN embeddings c ON q.vec_id % {QUERY_STEP} = 0 " "{where}) WHERE rank <= " + str(P.SEARCH_TOP_K))


@register("topk_search", sql=_TOPK_SQL.format(where=""))
def topk_search(spark, sf_dir):
    """Top-5 nearest vectors of the stated queries."""
    e = _embedding_rows(spark, sf_dir)
    return nearest(stated_queries(e), e, ["query_id"], ["vec_id"], k=P.SEARCH_TOP_K).select(
        "query_id", "vec_id", "score", "rank")


@register("topk_search_filtered", sql=_TOPK_SQL.format(where="AND q.label = c.label"))
def topk_search_filtered(spark, sf_dir):
    """J2 with a scalar pre-filter: each query searches only its own label."""
    e = _embedding_rows(spark, sf_dir)
    q = stated_queries(e).withColumnRenamed("label", "qlabel")
    return nearest(q, e, ["query_id"], ["vec_id"], k=P.SEARCH_TOP_K,
                   q_filter="qlabel", c_filter="label").select("query_id", "vec_id", "score", "rank")


CONTEXT_WINDOW = 2


@register("context_window", sql=(
    f"WITH {Q.base_ctes()}, {Q.top1_cte()} "
    "SELECT h.item_id, h.q_index, h.sentence_index AS hit_index, c.doc_id, c.sentence_index, "
    "1.0::DOUBLE AS score FROM hits h JOIN cs c ON c.doc_id = h.doc_id "
    f"AND abs(c.sentence_index - h.sentence_index) BETWEEN 1 AND {CONTEXT_WINDOW}"))
def context_window(spark, sf_dir, w: int = CONTEXT_WINDOW):
    """Neighbours index +- w of every hit in the same document, score 1.0.

    No range join: each hit expands to its 2w neighbour positions and meets the
    sentence table on the equi-key (doc_id, sentence_index).
    """
    h = C.hits(spark, sf_dir)
    offsets = F.array(*[F.lit(d) for d in range(-w, w + 1) if d != 0])
    want = h.select("item_id", "q_index", "doc_id", F.col("sentence_index").alias("hit_index"),
                    F.explode(offsets).alias("off")) \
        .withColumn("sentence_index", (F.col("hit_index") + F.col("off")).cast("int")) \
        .where(F.col("sentence_index") >= 0)
    cs = IX.corpus_sentences(spark, sf_dir).select("doc_id", "sentence_index")
    return want.join(cs, ["doc_id", "sentence_index"]).select(
        "item_id", "q_index", "hit_index", "doc_id", "sentence_index",
        F.lit(1.0).alias("score"))


def expand_hits(found, sentences, q_keys, doc_col: str, index_col: str, w: int):
    """Hits (q_keys, doc, index, score, rank) followed by their neighbours: one ordered list per query.

    Every hit brings itself and the positions index - w .. index + w that its
    document has; the join is on (document, index).  ``position`` counts from 0:
    by rank the hit, then its neighbours in text order, which score 1.0.
    """
    offsets = F.array(*[F.lit(d) for d in range(-w, w + 1)])
    want = found.select(*q_keys, "rank", "score", doc_col, F.explode(offsets).alias("off"),
                        F.col(index_col).alias("at")).withColumn(index_col, (F.col("at") + F.col("off")).cast("int"))
    rows = want.join(sentences.select(doc_col, index_col, "sentence"), [doc_col, index_col])
    hit = F.col("off") == 0
    order = Window.partitionBy(*q_keys).orderBy("rank", F.when(hit, 0).otherwise(1), index_col)
    return rows.select(*q_keys, (F.row_number().over(order) - 1).alias("position"), "rank", hit.alias("is_hit"), doc_col,
                       index_col, "sentence", F.when(hit, F.col("score")).otherwise(F.lit(1.0)).alias("score"))


@register("search_with_context", sql=(
    f"WITH {Q.base_ctes()}, hits AS (SELECT * FROM (SELECT q.item_id, q.q_index, c.doc_id, c.sentence_index AS hit_at, "
    f"{Q.cos('q.vec', 'c.vec')} AS score, row_number() OVER (PARTITION BY q.item_id, q.q_index ORDER BY "
    f"{Q.cos('q.vec', 'c.vec')} DESC, c.doc_id, c.sentence_index)::INTEGER AS rank FROM qv q, cv c) "
    f"WHERE rank <= {P.SEARCH_TOP_K}) "
    "SELECT h.item_id, h.q_index, (row_number() OVER (PARTITION BY h.item_id, h.q_index ORDER BY rank, "
    "CASE WHEN c.sentence_index = hit_at THEN 0 ELSE 1 END, c.sentence_index) - 1)::INTEGER AS position, rank, "
    "c.sentence_index = hit_at AS is_hit, c.doc_id, c.sentence_index, c.sentence, "
    "CASE WHEN c.sentence_index = hit_at THEN score ELSE 1.0::DOUBLE END AS score "
    f"FROM hits h JOIN cs c ON c.doc_id = h.doc_id AND abs(c.sentence_index - hit_at) <= {CONTEXT_WINDOW}"))
def search_with_context(spark, sf_dir, k: int = P.SEARCH_TOP_K, w: int = CONTEXT_WINDOW):
    """The k nearest corpus sentences of every submitted sentence, each followed by its neighbours."""
    corpus = IX.corpus_table(spark, sf_dir)
    found = nearest(C.query_vectors(load(spark, sf_dir, "benchmark")), corpus, ["item_id", "q_index"],
                    ["doc_id", "sentence_index"], k=k)
    return expand_hits(found, corpus, ["item_id", "q_index"], "doc_id", "sentence_index", w)
