"""Removes bytes of 100-byte strings that also start earlier, by merged transforms.

1. Anchors.  Every 100-byte window picks one of its 28-byte grams, the one with
   the least hash, the leftmost of equal ones.  Equal windows pick the same
   gram at the same place, so a window whose anchor is the only one of its hash
   is nowhere else and leaves.  Runs of windows with one anchor stay together.
2. Spans.  The bytes of a run's windows (at most 172) form a string; strings
   with the same anchor hash meet in one bucket.  Equal strings are one string
   with its first occurrence: the windows of all others start earlier too.
3. Transforms.  Strings that share an anchor are read in blocks of 8 bytes
   counted from the anchor.  Shards of strings get their Burrows-Wheeler
   transforms, which are merged by interleave refinement (see ``bwt``); suffixes
   that share 11 blocks form a repeated interval.  Two equal windows always have
   the same 11 whole blocks, so they meet in an interval, and the bytes at both
   ends decide within it.
4. Bytes covered by a window that starts earlier are taken out of each text.

Buckets hold anchors or distinct strings, packed by Arrow batch after equal
ones of a batch are joined; their number and that of the tasks follow from the
bytes of the texts (and the shuffle partitions, if those are more), so both stay
small on large inputs.  An anchor that occurs more than ``HOT``
times (the edge of a passage that very many documents hold, each going on in
its own way) would still fill one bucket: its windows are sent one by one, by
their own hash, so equal ones meet and the others spread.  The texts are joined with the places
found in them by document, through a shuffle of the documents that have any
while their ids fit a measured broadcast, else of all.

Defined results: a null text is empty; texts below 100 bytes lose nothing;
spans never cross documents; a null doc_id comes after all others; rows that
repeat a doc_id with another text (or lack one) are documents of their own, in
the order of their texts' digests; rows equal in both are one document and get
the same result; an empty table gives no rows; columns beside doc_id and text
are ignored.  Very long texts are read in pieces with an overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simcheck.functions.ordering import global_row_number
from simcheck.llm.bwt import repeated_blocks
from simcheck.llm.common import BROADCAST_BYTES, small_or_shuffled, text_of
from simcheck.llm.textwords import mix64
from simcheck.session import materialize

LENGTH, GRAM, BLOCK = 100, 28, 8
WINDOW = LENGTH - GRAM + 1
DEPTH = (LENGTH - (BLOCK - 1)) // BLOCK
PIECE = 1 << 20
SHARD_SYMBOLS = 1 << 15
BUCKETS_PER_PARTITION = 8
#: Bytes of text a task of the bucket stages.
TASK_BYTES = 256 << 20
HOT = 50_000
ROWS_OUT = 2048
NO_ID = (1 << 63) - 1

_STEP = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_STEP, PIECE + LENGTH)
_DOWN = _powers(pow(_STEP, -1, 1 << 64), PIECE + LENGTH)


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _UP[:len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, number of windows, hash) of each anchor of a text."""
    found = []
    for s in range(0, len(data) - LENGTH + 1, PIECE):
        piece = data[s:s + PIECE + LENGTH - 1]
        sums = _sums(piece)
        n = len(piece) - GRAM + 1
        code = mix64((sums[GRAM:] - sums[:-GRAM]) * _DOWN[:n])
        key = (code & ~_U((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        rows = -(-n // WINDOW)
        grid = np.full(rows * WINDOW, ~_U(0))
        grid[:n] = key
        grid = grid.reshape(rows, WINDOW)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - WINDOW + 1
        least = np.minimum(behind[:windows], ahead[WINDOW - 1:WINDOW - 1 + windows])
        place = (least & _U((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        count = np.diff(np.append(first, windows))
        found.append((place[first] + s, first + s, count, code[place[first]]))
    if not found:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spread(code: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix64(code.astype(np.uint64) ^ _U(0xA5A5A5A5)) % _U(n_buckets)).astype(np.int64)


def _small(x: np.ndarray) -> tuple[int, bytes]:
    """Lowest value, and the rest above it in the fewest bytes of 1, 2, 4 or 8."""
    low = int(x.min())
    rest = x - low
    kind = np.min_scalar_type(int(rest.max()))
    return low, rest.astype(kind).tobytes()


def _full(low: int, packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64) + low


def _doc(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


ANCHORS = "bucket long, known boolean, n long, codes binary, doc_low long, docs binary, place_low long, places binary, " \
          "lows binary, counts binary"


def shared_anchors(docs: DataFrame, n_buckets: int, n_tasks: int) -> DataFrame:
    """(doc, at, code) of anchors whose hash occurs again; at = place, windows before it and number, packed."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_OUT):
                part = pdf.iloc[k:k + ROWS_OUT].sort_values("doc")
                found = [(d, *anchors(np.frombuffer(t.encode(), np.uint8)))
                         for d, t in zip(part["doc"].tolist(), part["text"], strict=True)]
                doc = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
                if not len(doc):
                    continue
                place, first, count, code = (np.concatenate([f[i] for f in found]) for i in range(1, 5))
                order = np.argsort(code, kind="stable")
                doc, place, first, count, code = (x[order] for x in (doc, place, first, count, code))
                new = np.concatenate(([True], code[1:] != code[:-1]))
                size = np.diff(np.append(np.flatnonzero(new), len(code)))
                known = np.repeat(size > 1, size)
                # a hash that recurs here is known to; one note of it tells the bucket
                note = known & new
                e = np.concatenate((np.arange(len(code)), np.flatnonzero(note)))
                is_note = np.arange(len(e)) >= len(code)
                is_known = known[e] & ~is_note
                to = np.where(is_known, _spread(doc[e], n_buckets), _spread(code[e], n_buckets))
                kind = to * 2 + is_known
                by = np.lexsort((place[e], doc[e], kind))
                e, kind, is_note = e[by], kind[by], is_note[by]
                edge = np.concatenate(([0], np.flatnonzero(np.diff(kind)) + 1, [len(kind)]))
                out = []
                for s, t in zip(edge[:-1], edge[1:], strict=True):
                    i = e[s:t]
                    counts = np.where(is_note[s:t], 0, count[i]).astype(np.uint8)
                    out.append((kind[s] // 2, bool(kind[s] % 2), t - s, code[i].tobytes(), *_small(doc[i]),
                                *_small(place[i]), (place[i] - first[i]).astype(np.uint8).tobytes(), counts.tobytes()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ANCHORS.split(", ")])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(np.full(r.n, r.known), np.frombuffer(r.codes, np.uint64), _full(r.doc_low, r.docs, r.n),
                 _full(r.place_low, r.places, r.n), np.frombuffer(r.lows, np.uint8), np.frombuffer(r.counts, np.uint8))
                for r in pdf.itertuples(index=False)]
        known, code, doc, place, low, count = (np.concatenate(x) for x in zip(*rows, strict=True))
        asked = np.flatnonzero(~known)
        asked = asked[np.argsort(code[asked], kind="stable")]
        same = code[asked][1:] == code[asked][:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        keep = known.copy()
        keep[asked] = again[:len(asked)]
        keep &= count > 0
        at = (place << 16) | (low.astype(np.int64) << 8) | count
        return pd.DataFrame({"doc": doc[keep], "at": at[keep], "code": code[keep].astype(np.int64)})

    return (_doc(docs).mapInPandas(read, ANCHORS).repartition(n_tasks, "bucket").groupBy("bucket")
            .applyInPandas(meet, "doc long, at long, code long"))


SPANS = "bucket long, n long, codes binary, doc_low long, docs binary, first_low long, firsts binary, lows binary, " \
        "counts binary, data binary"
RUNS = "doc long, first long, count long"


def _joined_runs(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> pd.DataFrame:
    """Runs of windows with neighbours joined."""
    order = np.lexsort((first, doc))
    doc, first, count = doc[order], first[order], count[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + count[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc))[:len(at)] - 1
    return pd.DataFrame({"doc": doc[at], "first": first[at], "count": first[last] + count[last] - first[at]})


def split_hot(spans, hots: list[bool]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """The spans, those of hot anchors as single windows under a hash of their own."""
    for span, hot in zip(spans, hots, strict=True):
        if not hot:
            yield span
            continue
        first, _, count, _, data = span
        for k in range(count):
            window = data[k:k + LENGTH]
            code = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
            yield first + k, 0, 1, code, window


def span_rows(texts: DataFrame, n_buckets: int) -> DataFrame:
    """Packed distinct spans by bucket; rows of negative buckets are runs known to start earlier."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for pdf in batches:
            seen: dict[tuple[int, bytes], tuple[int, int]] = {}
            keep, late = [], []
            for doc, text, ats, codes, hots in sorted(zip(pdf["doc"].tolist(), pdf["text"], pdf["ats"], pdf["codes"],
                                                          pdf["hots"], strict=True), key=lambda r: r[0]):
                raw = text.encode()
                order = np.argsort(ats)
                ats = np.asarray(ats)[order]
                low, count = (ats >> 8) & 255, ats & 255
                first = (ats >> 16) - low
                spans = zip(first.tolist(), low.tolist(), count.tolist(), np.asarray(codes)[order].tolist(),
                            [raw[f:f + n + LENGTH - 1] for f, n in zip(first.tolist(), count.tolist(), strict=True)],
                            strict=True)
                if len(hots) and any(hots):
                    spans = split_hot(spans, np.asarray(hots)[order].tolist())
                for f, lo, n, code, span in spans:
                    place = seen.get((code, span))
                    if place is None:
                        seen[code, span] = (doc, f)
                        keep.append((code, doc, f, lo, n, span))
                    elif place != (doc, f):         # else a row that repeats its document
                        late.append((doc, f, n))
            out = []
            if late:
                runs = _joined_runs(*np.array(late, np.int64).T)
                spread = int(_spread(runs["doc"].to_numpy()[:1], n_buckets)[0])
                out.append((-1 - spread, len(runs), b"", *_small(runs["doc"].to_numpy()), *_small(runs["first"].to_numpy()), b"",
                            runs["count"].to_numpy(np.int64).tobytes(), b""))
            if keep:
                code, doc, first, low, count = (np.array([k[i] for k in keep], np.int64) for i in range(5))
                to = _spread(code, n_buckets)
                by = np.argsort(to, kind="stable")
                edge = np.concatenate(([0], np.flatnonzero(np.diff(to[by])) + 1, [len(by)]))
                for s, t in zip(edge[:-1], edge[1:], strict=True):
                    i = by[s:t]
                    out.append((to[i[0]], t - s, code[i].tobytes(), *_small(doc[i]), *_small(first[i]),
                                low[i].astype(np.uint8).tobytes(), count[i].astype(np.uint8).tobytes(),
                                b"".join([keep[j][5] for j in i])))
            if out:
                yield pd.DataFrame(out, columns=names)

    return texts.mapInPandas(cut, SPANS)


def late_windows(spans: list[bytes], low: np.ndarray, count: np.ndarray, rank: np.ndarray,
                 first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, window) of windows that an earlier one equals; ``rank`` orders documents, ``first`` windows in them.

    Spans are distinct strings around anchors at place ``low`` of each.
    """
    skip = low % BLOCK
    symbols = [np.frombuffer(s, np.dtype("<u8"), (len(s) - k) // BLOCK, k) for s, k in zip(spans, skip.tolist(), strict=True)]
    block, string, place = repeated_blocks(symbols, DEPTH, SHARD_SYMBOLS)
    x = skip[string] + place * BLOCK                      # where the first whole block of these windows is
    string, window = np.repeat(string, BLOCK), (x[:, None] - np.arange(BLOCK)).ravel()
    block = np.repeat(block, BLOCK)
    fits = (window >= 0) & (window < count[string])
    string, window, block = string[fits], window[fits], block[fits]
    size = np.array([len(s) for s in spans])
    start = np.cumsum(size) - size
    code = np.empty(len(string), np.uint64)
    data = np.frombuffer(b"".join(spans), np.uint8)
    place = start[string] + window
    for s in range(0, len(data), PIECE):
        sums = _sums(data[s:s + PIECE + LENGTH - 1])
        own = np.flatnonzero((place >= s) & (place < s + PIECE))
        p = place[own] - s
        code[own] = mix64((sums[p + LENGTH] - sums[p]) * _DOWN[p])
    order = np.lexsort((first[string] + window, rank[string], code, block))
    code, block = code[order], block[order]
    again = np.zeros(len(order), bool)
    again[1:] = (code[1:] == code[:-1]) & (block[1:] == block[:-1])
    return string[order][again], window[order][again]


def late_runs(rows: DataFrame, n_tasks: int) -> DataFrame:
    """(doc, first, count): runs of windows that start earlier somewhere else."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            parts = [(_full(r.doc_low, r.docs, r.n), _full(r.first_low, r.firsts, r.n), np.frombuffer(r.counts, np.int64))
                     for r in pdf.itertuples(index=False)]
            return _joined_runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        entries = []
        for r in pdf.itertuples(index=False):
            code, doc = np.frombuffer(r.codes, np.int64), _full(r.doc_low, r.docs, r.n)
            first = _full(r.first_low, r.firsts, r.n)
            low, count = np.frombuffer(r.lows, np.uint8), np.frombuffer(r.counts, np.uint8)
            end = np.cumsum(count.astype(np.int64) + LENGTH - 1)
            data = r.data
            entries += [(d, f, c, lo, n, data[e - n - LENGTH + 1:e]) for d, f, c, lo, n, e in zip(
                doc.tolist(), first.tolist(), code.tolist(), low.tolist(), count.tolist(), end.tolist(), strict=True)]
        entries.sort(key=lambda x: x[:2])
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        late, own = [], []
        for entry in entries:
            key = (entry[2], entry[5])
            place = seen.get(key)
            if place is None:
                seen[key] = entry[:2]
                own.append(entry)
            elif place != entry[:2]:
                late.append((entry[0], entry[1], entry[4]))
        # an anchor with one string has no other windows to compare
        code = np.array([x[2] for x in own], np.int64)
        _, back, times = np.unique(code, return_inverse=True, return_counts=True)
        own = [x for x, t in zip(own, times[back].tolist(), strict=True) if t > 1]
        found = [np.array(late, np.int64).reshape(-1, 3)]
        if own:
            doc, first = np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)
            string, window = late_windows([x[5] for x in own], np.array([x[3] for x in own], np.int64),
                                          np.array([x[4] for x in own], np.int64), doc, first)
            found.append(np.stack([doc[string], first[string] + window, np.ones(len(string), np.int64)], axis=1))
        return _joined_runs(*np.concatenate(found).T)

    return rows.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(solve, RUNS)


def joined_with(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Texts with the rows of ``places`` by doc; only documents that have places are shuffled if their ids are few."""
    ids = materialize(places.select("doc"))
    n = ids.count()
    texts = _doc(docs)
    if n * 24 > BROADCAST_BYTES:
        return texts.join(places, "doc", how)
    with_places = texts.join(F.broadcast(ids), "doc", "left_semi").join(places, "doc")
    if how == "inner":
        return with_places
    return with_places.unionByName(texts.join(F.broadcast(ids), "doc", "left_anti"), allowMissingColumns=True)


def _arrays(rows: DataFrame, **columns: str) -> DataFrame:
    """One row a document with the given columns of its rows as arrays."""
    packed = rows.groupBy("doc").agg(F.collect_list(F.struct(*columns)).alias("all"))
    return packed.select("doc", *[F.col(f"all.{c}").alias(name) for c, name in columns.items()])


def survey(docs: DataFrame) -> tuple[bool, int]:
    """Whether an id (or its lack) stands for different texts, or NO_ID is an id; and the bytes of all texts."""
    by_id = (docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("doc_id").alias("id"),
                         F.md5(text_of().cast("binary")).alias("digest"), F.octet_length("text").alias("bytes"))
             .groupBy("doc").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.max("id").alias("id"),
                                 F.sum("bytes").alias("bytes")))
    several, size = by_id.agg(F.bool_or(F.expr(f"low <> high or id <=> {NO_ID}")), F.sum("bytes")).first()
    return bool(several), size or 0


def suffix_dedup(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; kept is binary."""
    docs = docs.select("doc_id", "text")
    several, size = survey(docs)
    n_tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    n_buckets = n_buckets or BUCKETS_PER_PARTITION * n_tasks
    if not several:
        return _by_document(docs, n_buckets, n_tasks)
    # every different row is numbered in the order of ids and takes its number as id
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text"), F.md5(text_of().cast("binary")).alias("digest"))
    numbers = materialize(global_row_number(rows.select("id", "digest").distinct(),
                                            [F.asc_nulls_last("id"), F.asc("digest")], "doc_id"))
    of = small_or_shuffled(numbers.select(F.col("id").alias("n_id"), F.col("digest").alias("n_digest"), "doc_id"), 64)
    numbered = materialize(rows.join(of, F.col("id").eqNullSafe(F.col("n_id")) & (F.col("digest") == F.col("n_digest")))
                           .select("doc_id", "text"))
    done = _by_document(numbered, n_buckets, n_tasks).withColumnRenamed("doc_id", "number")
    back = small_or_shuffled(numbers.select(F.col("doc_id").alias("number"), F.col("id").alias("doc_id")), 24)
    return done.join(back, "number").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def _by_document(docs: DataFrame, n_buckets: int, n_tasks: int) -> DataFrame:
    anchored = materialize(shared_anchors(docs, n_buckets, n_tasks))
    hot = materialize(anchored.groupBy("code").count().filter(F.col("count") > HOT)
                      .select("code", F.lit(True).alias("hot")))
    marked = (anchored.join(small_or_shuffled(hot, 24), "code", "left")
              .withColumn("hot", F.coalesce("hot", F.lit(False))))
    shared = materialize(_arrays(marked, at="ats", code="codes", hot="hots"))
    spans = span_rows(joined_with(docs, shared, "inner"), n_buckets)
    runs = materialize(_arrays(late_runs(spans, n_tasks), first="firsts", count="counts"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), ROWS_OUT):
                out = []
                for doc, text, firsts, counts in pdf.iloc[k:k + ROWS_OUT][["doc", "text", "firsts", "counts"]].itertuples(index=False):
                    raw = text.encode()
                    if firsts is None or not len(firsts):
                        out.append((doc, len(raw), 0, 0, raw))
                        continue
                    order = np.argsort(firsts)
                    start = np.asarray(firsts)[order]
                    end = np.maximum.accumulate(start + np.asarray(counts)[order] + LENGTH - 1)
                    new = np.concatenate(([True], start[1:] > end[:-1]))
                    start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                    edges = np.stack([np.concatenate(([0], end)), np.append(start, len(raw))], axis=1).tolist()
                    out.append((doc, len(raw), int((end - start).sum()), len(start), b"".join([raw[a:b] for a, b in edges])))
                yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return (joined_with(docs, runs, "left").select("doc", "text", "firsts", "counts")
            .mapInPandas(keep, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
            .withColumn("doc_id", F.nullif("doc", F.lit(NO_ID))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
