"""Text preparation semantics."""
import re

from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.functions import text as TX
from simcheck.operators import sentences as S


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr("s").alias("o")).first()["o"]


def test_clean_text_matches_python_whitespace(spark):
    s = "a b c\x1cd\te\n\nf  g \x1f h　i "
    assert _one(spark, TX.clean_text, s) == re.sub(r"\s+", " ", s).strip()


def test_boilerplate_rules(spark):
    ten = "one two three four five six seven eight nine ten"
    nine = "one two three four five six seven eight nine"
    rows = [(ten, False), (nine, True), ("1. " + ten, True), ("99. " + ten, True),
            ("100. " + ten, False), (ten + " system", True)]
    rows += [(ten + " " + p + "x", True) for p in P.BOILERPLATE_PATTERNS if p.strip()]
    df = spark.createDataFrame(rows, "s string, want boolean")
    got = df.select("want", TX.is_boilerplate("s").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_split_keeps_only_kept_sentences_numbered(spark):
    text = ("Short one. " + " ".join(["w"] * 12) + ". Another short! "
            + " ".join(["v"] * 10) + "? tail")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = S.kept_sentences(df, "doc_id").orderBy("sentence_index").collect()
    assert [r["sentence_index"] for r in rows] == [0, 1]
    assert rows[0]["sentence"].startswith("w w") and rows[1]["sentence"].endswith("v?")


def test_min_pieces_counts_empty_pieces(spark):
    assert _one(spark, TX.space_pieces, "a  b") == len("a  b".split(" "))


def test_chunks_by_hand(spark):
    assert P.CHUNK_MAX_SUBTOKENS == 450
    parts = lambda c: len(c.replace("_", " ").split(" "))
    words = ["w"] * 449 + ["a_b"] + ["c"] * 450 + ["_".join("x" * 460), "z"]
    df = spark.createDataFrame([(" ".join(words),), ("one two",)], "s string")
    long, short = [r["c"] for r in df.select(TX.chunk_words(F.split("s", " ")).alias("c")).collect()]
    assert short == ["one two"]
    # 449 single words, then a pair that would be number 450 and 451, then 448 more beside it
    assert [len(c.split(" ")) for c in long] == [449, 449, 2, 1, 1]
    assert " ".join(long).split(" ") == words
    assert all(parts(c) <= 450 or " " not in c for c in long)
    assert all(parts(x) + parts(y.split(" ")[0]) > 450 for x, y in zip(long, long[1:]))


def test_chunks_of_a_sentence_equal_the_fold(spark):
    import random
    rng = random.Random(4)
    texts = ["", " ", "_", "a  b__c ", "x" * 900] + [
        " ".join(rng.choice(["a", "", "b_c", "_", "word"]) for _ in range(n)) for n in [*range(1, 9)] * 3 + [440, 449, 450, 451, 900]]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for limit in (3, 450):
        for r in df.select("s", TX.chunk_sentence("s", limit).alias("got"),
                           TX.chunk_words(F.split("s", " "), limit).alias("want")).collect():
            assert r.got == r.want, r.s
    fold = TX.chunk_words
    try:
        TX.chunk_words = lambda words, n: F.raise_error(F.lit("folded")).cast("array<string>")
        kept = df.where("length(s) < 450").select(TX.chunk_sentence("s").alias("c")).collect()
    finally:
        TX.chunk_words = fold
    assert all(len(r.c) == 1 for r in kept)                   # F20, F24: no fold over the words of a short sentence


def test_word_tokens(spark):
    got = _one(spark, TX.word_tokens, "Hé-llo, WO_rld!  12 ?")
    assert got == ["héllo", "wo_rld", "12"]


def test_noise_filters(spark):
    long = " ".join(["word"] * 16)
    df = spark.createDataFrame([(long.replace("word", "wxrd"),), (long,), ("wxrd " * 15 + "7",)], "s string")
    strict = [r[0] for r in df.select(TX.is_clean_sentence("s", P.NOISE_STRICT, True)).collect()]
    loose = [r[0] for r in df.select(TX.is_clean_sentence("s", P.NOISE_LOOSE, False)).collect()]
    assert strict == [True, False, False]   # 'o' is blacklisted, digits are not allowed
    assert loose == [True, True, True]
