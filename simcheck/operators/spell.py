"""Spelling check (G3, J15, A17) with a pluggable corrector.

The default corrector judges the submissions' own words against the corpus: a
word is wrong if a word at edit distance 1 is at least ``RATIO`` times as
frequent there, a word that the corpus lacks counting as one that it has once.
The rule is a ratio, so it means the same at every size of the corpus, and a
misspelling is found whether or not the corpus holds it.

Candidates come from an index of single deletions (an equi-join, as in
symmetric-delete spelling correction) and are confirmed with the built-in
``levenshtein``; nothing compares all words with all words.  The index is
stored: every batch of corpus text appends its word counts and the deletion
keys of the words that are new, so a check reads it and never the corpus.

Words are compared without the marks around them and in lower case; marks and
a capital letter are put back.  A model-based corrector can be passed instead
as a ``pandas_udf(string)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simcheck.operators.guards import broadcast_if_small
from simcheck.session import materialize
from simcheck.sources.store import BatchStore

MIN_WORD_LEN = 4
#: A right word is this many times as frequent as the wrong one.
RATIO = 10
#: Marks, core and marks of a token.
CORE_RE = r"(?s)^(\P{L}*)(.*?)(\P{L}*)$"


def core(token: Column) -> Column:
    """A token without the marks, digits and signs around its letters, in lower case."""
    return F.lower(F.regexp_extract(token, CORE_RE, 2))


def words(sentences: DataFrame, sentence_col: str = "sentence") -> DataFrame:
    """(word): the words of all sentences that are long enough to be judged."""
    return (sentences.select(F.explode(F.split(sentence_col, " ")).alias("t")).select(core(F.col("t")).alias("word"))
            .where(F.length("word") >= MIN_WORD_LEN))


def deletions(w: str) -> Column:
    """The word and what is left of it without one of its letters."""
    dels = F.transform(F.sequence(F.lit(1), F.length(w)),
                       lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.array_union(F.array(w), dels))


class SpellIndex(BatchStore):
    """Word counts and deletion keys of a growing corpus."""

    SCHEMAS = {"counts": "word string, n long", "keys": "k string, word string"}

    def add(self, batch: int, sentences: DataFrame, sentence_col: str = "sentence") -> None:
        """Count the words of a batch of sentences; a committed batch is left as it is."""
        if batch in self.batches():
            return
        counts = self._write(words(sentences, sentence_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts", batch)
        new = counts.select("word").join(self.read("counts").select("word"), "word", "left_anti")
        self._write(new.select(F.explode(deletions("word")).alias("k"), "word"), "keys", batch)
        self._commit(batch)

    def counts(self) -> DataFrame:
        """(word, n) over all committed batches."""
        return self.read("counts").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(submitted: DataFrame, index: SpellIndex, ratio: int = RATIO) -> DataFrame:
    """(wrong, right): words of ``submitted`` (word) with a neighbour ``ratio`` times as frequent, the most frequent one."""
    counts = index.counts()
    own = submitted.select("word").distinct().join(counts, "word", "left").select(
        F.col("word").alias("wrong"), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("own"))
    near = (own.select("wrong", "own", F.explode(deletions("wrong")).alias("k")).join(index.read("keys"), "k")
            .select("wrong", "own", "word").distinct()
            .where((F.col("wrong") != F.col("word")) & (F.levenshtein("wrong", "word") <= 1)))
    fits = near.join(counts, "word").where(F.col("n") >= F.col("own") * ratio)
    w = Window.partitionBy("wrong").orderBy(F.col("n").desc(), F.col("word").asc())
    return fits.withColumn("r", F.row_number().over(w)).where("r = 1").select("wrong", F.col("word").alias("right"))


def correct(sentences: DataFrame, keys: list[str], table: DataFrame,
            sentence_col: str = "sentence") -> DataFrame:
    """Corrected text aligned with each sentence: keys + (sentence, suggestion, n_fixes)."""
    toks = sentences.select(*keys, sentence_col,
                            F.posexplode(F.split(sentence_col, " ")).alias("pos", "tok"))
    t = broadcast_if_small(table)
    j = toks.join(t, core(toks["tok"]) == t["wrong"], "left")
    part = lambda i: F.regexp_extract("tok", CORE_RE, i)
    first = F.substring(part(2), 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    right = F.when(capital, F.concat(F.upper(F.substring("right", 1, 1)), F.substring("right", 2, 1 << 20))).otherwise(F.col("right"))
    fixed = F.coalesce(F.concat(part(1), right, part(3)), F.col("tok"))
    g = j.groupBy(*keys, sentence_col).agg(
        F.sort_array(F.collect_list(F.struct("pos", fixed.alias("t")))).alias("toks"),
        F.count("right").alias("n_fixes"))
    return g.select(*keys, sentence_col,
                    F.array_join(F.transform("toks", lambda x: x["t"]), " ").alias("suggestion"),
                    "n_fixes")


def flags(sentences: DataFrame, keys: list[str], index: SpellIndex | None = None,
          corrector=None, sentence_col: str = "sentence", ratio: int = RATIO) -> DataFrame:
    """Sentences whose corrected text differs from the input."""
    if corrector is not None:
        out = sentences.withColumn("suggestion", corrector(F.col(sentence_col))) \
            .withColumn("n_fixes", F.lit(None).cast("long"))
    else:
        table = materialize(word_table(words(sentences, sentence_col), index, ratio))
        out = correct(sentences, keys, table, sentence_col)
    return out.where(F.col("suggestion") != F.col(sentence_col))
