"""Registered queries: word counts, dictionary, TF-IDF, stop words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.operators import sentences as S
from simcheck.operators import sparse as SP
from simcheck.plans import sql as Q
from simcheck.plans import index as IX
from simcheck.plans.catalog import register
from simcheck.operators.guards import broadcast_if_small
from simcheck.session import materialize
from simcheck.sources.tables import load

KEYS = ["doc_id", "sentence_index"]


def _cs(spark, sf_dir):
    return IX.corpus_sentences(spark, sf_dir)


def _tok(spark, sf_dir):
    return SP.tokens(_cs(spark, sf_dir), KEYS)


_CS = f"cs AS ({Q.kept_sentences('documents', 'doc_id')})"
_TOK = ("tok AS (SELECT doc_id, sentence_index, unnest(t)::VARCHAR AS token, "
        "unnest(range(len(t)))::INTEGER AS token_index FROM ("
        "SELECT doc_id, sentence_index, list_filter(string_split(lower(sentence), ' '), "
        "lambda x: x <> '') AS t FROM cs))")
_VOCAB = "vocab AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token HAVING count(*) > 1)"
_BOW = ("bow AS (SELECT doc_id, sentence_index, token, count(*) AS tf FROM tok "
        "WHERE token IN (SELECT token FROM vocab) GROUP BY doc_id, sentence_index, token)")
_TFIDF = ("idf AS (SELECT token, log2((SELECT count(*) FROM cs)::DOUBLE / count(*)) AS idf "
          "FROM bow GROUP BY token), "
          "tw AS (SELECT b.doc_id, b.sentence_index, b.token, b.tf * i.idf AS w FROM bow b "
          "JOIN idf i ON i.token = b.token WHERE b.tf * i.idf <> 0), "
          "tfidf AS (SELECT doc_id, sentence_index, token, "
          "w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sentence_index)) AS weight FROM tw)")


@register("word_counts", sql=(
    f"WITH {_CS} SELECT word, count(*) - 1 AS cnt FROM ("
    "SELECT unnest(string_split(sentence, ' ')) AS word FROM cs) GROUP BY word"))
def word_counts(spark, sf_dir):
    """Word -> occurrences - 1 over all corpus sentences (ordered by count)."""
    return SP.word_counts(_cs(spark, sf_dir)).orderBy(F.col("cnt").desc(), "word")


@register("token_min_count", sql=f"WITH {_CS}, {_TOK}, {_VOCAB} SELECT token, cnt FROM vocab")
def token_min_count(spark, sf_dir):
    """Tokens seen more than once."""
    return SP.frequent_tokens(_tok(spark, sf_dir))


def _idf(spark, sf_dir):
    """Dictionary (every token seen more than once) with its idf, written once."""
    cs = _cs(spark, sf_dir)
    return materialize(SP.idf_table(SP.token_stats(cs), cs.count()))


@register("bag_of_words", sql=f"WITH {_CS}, {_TOK}, {_VOCAB}, {_BOW} SELECT * FROM bow")
def bag_of_words(spark, sf_dir):
    """(sentence, token, tf) over the filtered dictionary."""
    return SP.bag_of_words(_cs(spark, sf_dir), KEYS, _idf(spark, sf_dir).select("token"))


@register("tfidf_weights", sql=(
    f"WITH {_CS}, {_TOK}, {_VOCAB}, {_BOW}, {_TFIDF} "
    "SELECT doc_id, sentence_index, token, round(weight, 6) AS weight FROM tfidf"))
def tfidf_weights(spark, sf_dir):
    """Tf * log2(N/df), L2-normalised per sentence."""
    w = SP.weighted_tokens(_cs(spark, sf_dir), KEYS, _idf(spark, sf_dir))
    return w.withColumn("weight", F.round("weight", 6))


_STOP_SQL = (f"stop AS (SELECT token, count(*) AS cnt FROM tok GROUP BY token "
             f"ORDER BY cnt DESC, token LIMIT {P.STOPWORDS_LDA})")


@register("stopword_list", sql=(
    f"WITH {_CS}, {_TOK}, {_STOP_SQL} "
    "SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token)::INTEGER AS rank FROM stop"))
def stopword_list(spark, sf_dir):
    """T5: the 40 most frequent tokens."""
    return SP.stopwords(_tok(spark, sf_dir), P.STOPWORDS_LDA)


@register("remove_stopwords", sql=(
    f"WITH {_CS}, {_TOK}, {_STOP_SQL} SELECT doc_id, sentence_index, token_index, token FROM tok "
    "WHERE token NOT IN (SELECT token FROM stop)"))
def remove_stopwords(spark, sf_dir):
    """Tokens minus the top-40 list (broadcast anti-join; the list has 40 rows)."""
    tok = _tok(spark, sf_dir)
    stop = SP.stopwords(tok, P.STOPWORDS_LDA).select("token")
    return tok.join(F.broadcast(stop), "token", "left_anti").select(
        "doc_id", "sentence_index", "token_index", "token")


_QTOK = ("qs AS (" + Q.kept_sentences("benchmark", "item_id", "q_index") + "), "
         "qtok AS (SELECT item_id, q_index, unnest(string_split(lower(sentence), ' ')) AS token FROM qs), "
         "qbow AS (SELECT item_id, q_index, token, count(*) AS tf FROM qtok "
         "WHERE token IN (SELECT token FROM vocab) GROUP BY item_id, q_index, token), "
         "qw0 AS (SELECT q.item_id, q.q_index, q.token, q.tf * i.idf AS w FROM qbow q "
         "JOIN idf i ON i.token = q.token WHERE q.tf * i.idf <> 0), "
         "qw AS (SELECT item_id, q_index, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id, q_index)) AS weight FROM qw0)")


@register("tfidf_top1", sql=(
    f"WITH {_CS}, {_TOK}, {_VOCAB}, {_BOW}, {_TFIDF}, {_QTOK}, "
    "sc AS (SELECT q.item_id, q.q_index, c.doc_id, c.sentence_index, round(sum(q.weight * c.weight), 6) AS score "
    "FROM qw q JOIN tfidf c ON c.token = q.token GROUP BY q.item_id, q.q_index, c.doc_id, c.sentence_index), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, q_index ORDER BY score DESC, doc_id, sentence_index) AS rn FROM sc) "
    f"SELECT item_id, q_index, doc_id, sentence_index, score FROM rk WHERE rn = 1 AND score >= {P.MATCH_THRESHOLD}"))
def tfidf_top1(spark, sf_dir):
    """TF-IDF cosine top-1 of every submitted sentence, kept when >= 0.9."""
    return _tfidf_top1(spark, sf_dir)


def _tfidf_top1(spark, sf_dir):
    """Inverted-index join on ``token``.

    The submissions' tokens go first: only corpus sentences that may reach the
    threshold by these tokens are weighted, and only those tokens leave the row.  A partial sum per
    (query, corpus sentence) is followed by a top-1 window that Spark
    pre-limits before its shuffle.
    """
    idf = _idf(spark, sf_dir)
    qs = S.query_sentences(load(spark, sf_dir, "benchmark"))
    # unknown query tokens drop out (the dictionary does not grow)
    qw = materialize(SP.weighted_tokens(qs, ["item_id", "q_index"], idf).withColumnRenamed("weight", "qw"))
    near = materialize(SP.likely(_cs(spark, sf_dir), KEYS, idf, qw, ["item_id", "q_index"], P.MATCH_THRESHOLD))
    cw = SP.weighted_tokens(near, KEYS, idf, only=qw.select("token").distinct())
    sc = (cw.join(broadcast_if_small(qw), "token")
          .groupBy("item_id", "q_index", "doc_id", "sentence_index")
          .agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"))
          .where(F.col("score") >= P.MATCH_THRESHOLD))
    w = Window.partitionBy("item_id", "q_index").orderBy(F.col("score").desc(), "doc_id", "sentence_index")
    return materialize(sc.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"))


_QT = "qt AS (SELECT item_id, count(*) AS n FROM qs GROUP BY item_id)"


@register("tfidf_percent", sql=(
    f"WITH {_CS}, {_TOK}, {_VOCAB}, {_BOW}, {_TFIDF}, {_QTOK}, "
    "sc AS (SELECT q.item_id, q.q_index, c.doc_id, c.sentence_index, round(sum(q.weight * c.weight), 6) AS score "
    "FROM qw q JOIN tfidf c ON c.token = q.token GROUP BY q.item_id, q.q_index, c.doc_id, c.sentence_index), "
    f"hit AS (SELECT DISTINCT item_id, q_index FROM sc WHERE score >= {P.MATCH_THRESHOLD}), {_QT}, "
    "m AS (SELECT item_id, count(*) AS m FROM hit GROUP BY item_id) "
    "SELECT qt.item_id, coalesce(m.m, 0) AS matches, qt.n AS n_sentences, "
    "round_even(coalesce(m.m, 0) / qt.n, 2) * 100 AS percent FROM qt LEFT JOIN m ON m.item_id = qt.item_id"))
def tfidf_percent(spark, sf_dir):
    """round(matches / n, 2) * 100 per submission from the TF-IDF matches."""
    qs = S.query_sentences(load(spark, sf_dir, "benchmark"))
    m = _tfidf_top1(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("m"))
    n = qs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    matches = F.coalesce("m", F.lit(0))
    return n.join(m, "item_id", "left").select(
        "item_id", matches.alias("matches"), "n_sentences",
        (F.bround(matches / F.col("n_sentences"), 2) * 100).alias("percent"))
