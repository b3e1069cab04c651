"""Sentence tables: split, filter, number and encode (P1-P4, W6, U1 default).

All filtering happens inside the sentence array with higher-order functions,
so the kept position (``sentence_index``) comes straight out of
``posexplode`` — no window, no shuffle.  Documents stay where the scan put them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import text as TX
from simcheck.functions import vectors as V


def split_sentences(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Every non-empty sentence piece of the cleaned text: (id, pos, sentence)."""
    pieces = F.filter(TX.sentence_pieces(TX.clean_text(text_col)), lambda s: s != "")
    return df.select(id_col, F.posexplode(pieces).alias("pos", "sentence"))


def raw_sentences(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Sentence pieces of the uncleaned text (newlines kept): (id, pos, sentence)."""
    pieces = F.filter(TX.raw_sentence_pieces(text_col), lambda s: F.trim(s) != "")
    return df.select(id_col, F.posexplode(pieces).alias("pos", "sentence"))


def kept_sentences(df: DataFrame, id_col: str, text_col: str = "text",
                   index_col: str = "sentence_index", patterns=None,
                   min_words: int = P.MIN_SENTENCE_WORDS) -> DataFrame:
    """P2+P3+W6: sentences that survive the boilerplate filter, numbered 0.. per id."""
    pieces = TX.sentence_pieces(TX.clean_text(text_col))
    kept = F.filter(pieces, lambda s: (s != "") & ~TX.is_boilerplate(s, patterns, min_words))
    return df.select(id_col, F.posexplode(kept).alias(index_col, "sentence"))


def corpus_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_index, sentence) over the corpus documents."""
    return kept_sentences(documents.select("doc_id", "text"), "doc_id")


def query_sentences(benchmark: DataFrame) -> DataFrame:
    """(item_id, q_index, sentence) over submitted texts."""
    return kept_sentences(benchmark.select("item_id", "text"), "item_id", index_col="q_index")


def paper_chunks(df: DataFrame, id_col: str, index_col: str = "sentence_index", text_col: str = "text") -> DataFrame:
    """P4+P5: the research path's sentence list: (id, n_all, index, sentence).

    Sentences with more than six pieces, cut into chunks of bounded size and
    numbered 0.. per id; ``n_all`` counts all sentences, kept or not.
    """
    pieces = F.filter(TX.sentence_pieces(TX.clean_text(text_col)), lambda s: s != "")
    kept = F.filter(F.col("__p"), lambda s: TX.keep_min_pieces(s))
    chunks = F.flatten(F.transform(kept, lambda s: TX.chunk_sentence(s)))
    return (df.select(id_col, pieces.alias("__p"))
            .select(id_col, F.size("__p").cast("long").alias("n_all"), F.posexplode(chunks).alias(index_col, "sentence")))


def encode(df: DataFrame, sentence_col: str = "sentence", out_col: str = "vec",
           encoder=None) -> DataFrame:
    """Attach a sentence vector.  Default = native hashed-token vector."""
    if encoder is None:
        return df.withColumn(out_col, V.hashed_vector(sentence_col))
    return df.withColumn(out_col, encoder(F.col(sentence_col)))
