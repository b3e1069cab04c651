"""Spelling by the ratio of word counts."""
from pyspark.sql import functions as F

from simcheck.operators import spell as SPL
from simcheck.session import scratch_dir

CORPUS = (["the document holds several chapters"] * 40 + ["every chapter follows the documen"] * 2
          + ["rare wordings stand alone"] + ["Straße und Wörter im Dokument"] * 30)


def frame(spark, sentences):
    return spark.createDataFrame(list(enumerate(sentences)), "k int, sentence string")


def index_of(spark, *batches):
    index = SPL.SpellIndex(spark, scratch_dir(spark, "spell"))
    for i, b in enumerate(batches):
        index.add(i, frame(spark, b))
    return index


def flagged(spark, index, sentences):
    return {r["k"]: (r["suggestion"], r["n_fixes"]) for r in SPL.flags(frame(spark, sentences), ["k"], index).collect()}


def brute_table(submitted, corpus):
    import re
    cut = lambda t: re.fullmatch(r"(?s)([^\W\d_]*)", t) and t
    count = {}
    for s in corpus:
        for t in s.split(" "):
            t = re.sub(r"^[\W\d_]+|[\W\d_]+$", "", t).lower()
            count[t] = count.get(t, 0) + (len(t) >= 4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    out = {}
    for w in submitted:
        near = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + j:] for i in range(len(w) + 1) for c in letters for j in (0, 1)}
        best = sorted((-count[n], n) for n in near - {w} if count.get(n, 0) >= 10 * max(1, count.get(w, 0)) and len(n) >= 4)
        if best:
            out[w] = best[0][1]
    assert cut("abc")
    return out


def test_flags_whether_or_not_the_corpus_has_the_word(spark):
    index = index_of(spark, CORPUS)
    got = flagged(spark, index, [
        "a documnet is not one edit away", "a documet is", "the documen twice", "the document is right", "Documet, first!",
        "(chapers)", "strasse straBe Straß", "xyzzy words", "rare wording"])
    assert got == {1: ("a document is", 1), 2: ("the document twice", 1), 4: ("Document, first!", 1), 5: ("(chapters)", 1),
                   6: ("strasse straße Straße", 2)}


def test_table_equals_brute_force(spark):
    words = ["documen", "documents", "chapter", "hols", "holds", "several", "severals", "dokumen", "wörte", "wörten", "alone", "abcd"]
    table = SPL.word_table(spark.createDataFrame([(w,) for w in words], "word string"), index_of(spark, CORPUS))
    assert {r["wrong"]: r["right"] for r in table.collect()} == brute_table(words, CORPUS)


def test_flags_stay_when_the_corpus_gains_correct_text(spark):
    submitted = ["the documen", "some chaptrs", "straße", "a documet"]
    before = flagged(spark, index_of(spark, CORPUS), submitted)
    index = index_of(spark, CORPUS, ["the document holds several chapters"] * 200)
    assert flagged(spark, index, submitted) == before and len(before) == 3
    whole = index_of(spark, CORPUS + ["the document holds several chapters"] * 200)
    assert sorted(map(tuple, index.counts().collect())) == sorted(map(tuple, whole.counts().collect()))
    assert sorted(map(tuple, index.read("keys").collect())) == sorted(map(tuple, whole.read("keys").collect()))


def test_a_batch_counts_once_and_only_when_committed(spark):
    index = index_of(spark, CORPUS)
    counts = sorted(map(tuple, index.counts().collect()))
    index.add(0, frame(spark, CORPUS))
    index._write(index.read("counts"), "counts", 1)         # a job that died before its commit
    assert sorted(map(tuple, index.counts().collect())) == counts
    index.add(1, frame(spark, ["document"] * 3))
    assert dict(map(tuple, index.counts().collect()))["document"] == 43


def test_empty_sides_and_hook(spark):
    empty = SPL.SpellIndex(spark, scratch_dir(spark, "spell"))
    assert flagged(spark, empty, ["any words here"]) == {}
    assert flagged(spark, index_of(spark, CORPUS), []) == {}
    out = SPL.flags(frame(spark, ["abc", "xyz"]), ["k"], corrector=lambda c: F.replace(c, F.lit("x"), F.lit("y")))
    assert [r["suggestion"] for r in out.collect()] == ["yyz"]
