"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1],
``w(t) = target * (1 + tilt * (2t - 1))``: a positive tilt moves a source
towards the end, a negative one towards the start.  Its integral from 0 to t
is the source's cumulative demand of words; over the whole run that is its
target.  Documents of a source stand in a fixed pseudo-random order, and the
demand curve is inverted at the words before a document to get the time at
which it is due (its training position).  A source whose target exceeds its
size goes through its documents a second time.  Documents are then
range-sorted by position.

Targets: sources in code point order (null last) weigh ``weights`` in turn and
share ``budget`` times all words; a target stops at ``cap`` times its source's
size and the excess goes to the others by weight.  That is water filling: with
sources sorted by the level at which they are full, the level of the rest
follows from running sums.

Words before a document are a running sum within its source.  The source is
cut into 4096 cells by the first digits of the order key; the cells' sums are
added up first, so only the rows of one cell are sorted together, however much
one source holds.

Everything is DataFrame functions.  Defined results: a null or blank text has
size 0 and is never taken; a null source is a source of its own, after all
others; a null doc_id is ordered as an empty one; repeated rows are documents
of their own; an empty table gives no rows; columns beside doc_id, source and
text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simcheck.llm.common import WORD_PATTERN, small_or_shuffled, text_of
from simcheck.session import materialize

WEIGHTS = (3, 1, 2)
TILTS = (-0.5, 0.0, 0.5)
BUDGET, CAP = 1.5, 2.0


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD_PATTERN)).cast("long")


def targets(rows: DataFrame, weights=WEIGHTS, tilts=TILTS, budget: float = BUDGET,
            cap: float = CAP) -> DataFrame:
    """One row per source: (source, source_size, weight, tilt, target)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = (place - 1) % len(weights) + 1
    by_level = Window.orderBy("full_at", "place")
    everything = Window.partitionBy()
    level = ((F.lit(budget) * F.sum("source_size").over(everything)
              - F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    return (sources
            .withColumns({"place": place,
                          "weight": F.element_at(F.array(*map(F.lit, weights)), turn).cast("long"),
                          "tilt": F.element_at(F.array(*map(F.lit, tilts)), turn)})
            .withColumn("most", F.lit(cap) * F.col("source_size"))
            .withColumn("full_at", F.col("most") / F.col("weight"))
            .withColumn("level", level)
            .withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"),
                                              F.struct("full_at", "place", "level"))).over(everything)["level"])
            .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), "most")))
            .select("source", "source_size", "weight", "tilt", "target"))


def due(share: Column, tilt: Column) -> Column:
    """Time at which a schedule with this tilt has met ``share`` of its whole demand.

    The demand is tilt * t^2 + (1 - tilt) * t.
    """
    b = F.lit(1.0) - tilt
    return F.lit(2.0) * share / (b + F.sqrt(b * b + F.lit(4.0) * tilt * share))


def mix(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, budget: float = BUDGET,
        cap: float = CAP) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, taken, first, second, position, second_position).

    One row for every row of ``docs``.  ``taken`` counts words over all passes
    (``first`` and ``second``); the document at which a source's demand ends is
    taken in part, so the words of a source come to its target rounded down.
    ``position`` is null for documents that are not taken.
    """
    rows = materialize(
        docs.select("doc_id", "source", F.xxhash64(text_of()).alias("text_key"), word_count().alias("size"),
                    F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))
        .withColumn("cell", F.substring("key", 1, 3)))
    by_source = targets(rows, weights, tilts, budget, cap)
    cells = (rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
             .withColumn("cell_start", F.sum("cell_size").over(
                 Window.partitionBy("source").orderBy("cell")
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cell_size")))
    plan = materialize(cells.alias("c").join(by_source.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
                       .select(F.col("c.source").alias("p_source"), F.col("cell").alias("p_cell"),
                               "cell_start", "source_size", "tilt", "target"))
    in_cell = F.sum("size").over(Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size", "text_key")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    plan = small_or_shuffled(plan, F.coalesce(F.octet_length("p_source"), F.lit(0)) + 64)
    start, total = F.col("start"), F.floor("target")
    part = lambda words: F.least(F.col("size"), F.greatest(F.lit(0), words))
    return (rows.withColumn("in_cell", in_cell)
            .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("cell") == F.col("p_cell")))
            .withColumn("start", F.col("cell_start") + F.col("in_cell"))
            .withColumn("first", part(total - start))
            .withColumn("second", part(total - F.col("source_size") - start))
            .withColumn("position", F.when(F.col("first") > 0, due(start / F.col("target"), F.col("tilt"))))
            .withColumn("second_position", F.when(F.col("second") > 0, due(
                (start + F.col("source_size")) / F.col("target"), F.col("tilt"))))
            .select("doc_id", "source", "text_key", "size", "source_size", "target",
                    (F.col("first") + F.col("second")).cast("long").alias("taken"), "first", "second",
                    "position", "second_position"))


def curriculum(mixed: DataFrame) -> DataFrame:
    """The mix in training order: range-sorted by position, documents not taken last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id"))


def assemble(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, in training order.

    A row stands once for every pass that takes at least half of its words, so
    texts stay whole.  Rows that share a doc_id are told apart by source and
    text; equal ones are interchangeable.
    """
    # Equal rows are numbered and joined on what makes them equal; the number is
    # a condition beside the key, so the join keeps the windows' partitioning and
    # texts are shuffled once before the final sort.  The row itself is one
    # column, so its columns may have any name.
    def numbered(df: DataFrame, key: str, nth: str, order: list[str]) -> DataFrame:
        return df.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*order)))

    def same(text_key: Column) -> Column:
        part = [F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                for c in (F.col("doc_id").cast("string"), F.col("source"))]
        return F.md5(F.concat(*part, text_key.cast("string")).cast("binary"))

    passes = F.filter(F.array(F.when((F.col("first") > 0) & (F.col("first") * 2 >= F.col("size")), F.col("position")),
                              F.when((F.col("second") > 0) & (F.col("second") * 2 >= F.col("size")), F.col("second_position"))),
                      lambda p: p.isNotNull())
    due_rows = (numbered(mixed.withColumn("m_key", same(F.col("text_key"))), "m_key", "m_nth", ["position", "second_position"])
                .select("m_key", "m_nth", passes.alias("passes")).filter(F.size("passes") > 0))
    whole = docs.select(same(F.xxhash64(text_of())).alias("d_key"), F.struct("*").alias("row"))
    return (numbered(whole, "d_key", "d_nth", ["d_key"])
            .join(due_rows, (F.col("d_key") == F.col("m_key")) & (F.col("d_nth") - F.col("m_nth") == 0))
            .select("row", F.explode("passes").alias("position"))
            .orderBy("position", "row.doc_id").select("row.*"))
