"""Text preparation as Column expressions (JVM-side, no Python UDFs).

Every function here builds a ``pyspark.sql.Column`` so that Catalyst keeps it in
the generated code of the surrounding stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from simcheck import params as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Collapse every (Unicode) whitespace run to one space and strip."""
    return F.trim(F.regexp_replace(_col(c), P.WS_CLASS + "+", " "))


def sentence_pieces(cleaned) -> Column:
    """P2 splitter on cleaned text: cut after . ! ? followed by a space."""
    marked = F.regexp_replace(_col(cleaned), P.SENTENCE_END_RE, "$1" + P.SENTENCE_SEP)
    return F.split(marked, P.SENTENCE_SEP)


def raw_sentence_pieces(text) -> Column:
    """Splitter on uncleaned text: cut after . ! ? followed by spaces.

    Newlines inside a sentence are kept (the noise filters look for them).
    """
    marked = F.regexp_replace(_col(text), r"([.!?]) +", "$1" + P.SENTENCE_SEP)
    return F.split(marked, P.SENTENCE_SEP)


def space_pieces(c) -> Column:
    """Number of pieces of ``s.split(' ')`` (empty pieces counted)."""
    return F.size(F.split(_col(c), " "))


def contains_any(c, patterns) -> Column:
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.contains(p) for p in patterns], F.lit(False))


def is_boilerplate(c, patterns=None, min_words: int = P.MIN_SENTENCE_WORDS) -> Column:
    """Fewer than ``min_words`` words, a section number, or a pattern hit."""
    patterns = P.BOILERPLATE_PATTERNS if patterns is None else patterns
    c = _col(c)
    return ((space_pieces(c) < min_words)
            | c.rlike(P.SECTION_NUMBER_RE)
            | contains_any(c, patterns))


def keep_min_pieces(c, min_pieces: int = P.PAPER_MIN_PIECES) -> Column:
    """Keep sentences with more than ``min_pieces`` space pieces."""
    return space_pieces(c) > min_pieces


def is_clean_sentence(c, blacklist, forbid_digits: bool,
                      min_pieces: int = P.NOISE_MIN_PIECES) -> Column:
    """P6/P7/P8 predicate: long enough, no blacklisted substring, digits optional."""
    c = _col(c)
    cond = (space_pieces(c) > min_pieces) & ~contains_any(c, blacklist)
    if forbid_digits:
        cond = cond & ~c.rlike("[0-9]")
    return cond


def newline_to_space(c) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))


def word_tokens(c) -> Column:
    """Lowercase, drop non-word characters, split on whitespace runs."""
    lowered = F.lower(clean_text(c))
    stripped = F.trim(F.regexp_replace(F.regexp_replace(lowered, P.NON_WORD_CLASS, ""), " +", " "))
    return F.filter(F.split(stripped, " "), lambda t: t != "")


def lower_tokens(c) -> Column:
    """P10: ``text.lower().split()`` on cleaned text."""
    return F.filter(F.split(F.lower(clean_text(c)), " "), lambda t: t != "")


def chunk_words(words, max_len: int = P.CHUNK_MAX_SUBTOKENS) -> Column:
    """P5: greedy packing of words into chunks of at most ``max_len`` subtokens.

    A word weighs as many subtokens as ``word.split('_')`` has pieces.  A new
    chunk starts when adding the word would exceed the limit.  Implemented
    with ``aggregate`` over the word array, so no UDF and no shuffle.
    """
    words = _col(words)
    init = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast("array<string>").alias("cur"),
        F.lit(0).alias("n"),
    )

    def step(acc, w):
        wl = F.size(F.split(w, "_"))
        overflow = (acc["n"] + wl) > max_len
        flush = overflow & (F.size(acc["cur"]) > 0)
        done = F.when(flush, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))) \
            .otherwise(acc["done"])
        cur = F.when(overflow, F.array(w)).otherwise(F.concat(acc["cur"], F.array(w)))
        n = F.when(overflow, wl).otherwise(acc["n"] + wl)
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n"))

    def finish(acc):
        return F.when(F.size(acc["cur"]) > 0,
                      F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))) \
            .otherwise(acc["done"])

    return F.aggregate(words, init, step, finish)


def chunk_sentence(s, max_len: int = P.CHUNK_MAX_SUBTOKENS) -> Column:
    """P5 on a sentence: one with at most ``max_len`` subtokens is its only chunk, without the fold."""
    s = _col(s)
    short = (F.length(s) < max_len) | (F.size(F.split(s, "[ _]")) <= max_len)
    return F.when(short, F.array(s)).otherwise(chunk_words(F.split(s, " "), max_len))


def basename(path) -> Column:
    """Last path segment."""
    return F.element_at(F.split(_col(path), "/"), -1)


def utc_iso(ts) -> Column:
    """UTC time stamp as ``%Y-%m-%dT%H:%M:%SZ`` (session time zone is UTC)."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def job_id(ts) -> Column:
    """Compact job id ``%Y%m%d%H%M%S``."""
    return F.date_format(_col(ts), "yyyyMMddHHmmss")
