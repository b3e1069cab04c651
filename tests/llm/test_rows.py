"""Repeated ids, rows without an id, long digit runs, oversized components and clashing columns."""
import random
from collections import Counter

import pytest

import corpus_pipeline
from simcheck.llm import line_dedup, mixing, near_dedup, pii, sharding, suffix_dedup, voronoi
from simcheck.session import scratch_dir

SMOKE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
NO_ID = (1 << 63) - 1


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_long_digit_runs(spark, kind):
    run = "0" * 5000
    texts = [run + ".1.2.3", "1.2.3." + "7" * 5000, "+" + "1" * 5000, "+1 " + "2 " * 4000, "4" * 5000, "4 " * 5000,
             run + "@" + run + ".com", "@".join([run] * 3), "1.2.3." + run + "9 and 10.0.0.1"]
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert len(rows) == len(texts)
    k = pii.KINDS.index(kind)
    for r in rows:
        text = texts[r["doc_id"]]
        want = [(m.start(), m.end()) for m in pii.BASE[kind].finditer(text)
                if pii.accepted(kind, m.group())] if kind != "email" else None
        got = [(s["start"], s["end"]) for s in r["base"] if s["kind"] == k]
        assert want is None or got == want
    assert [(s["start"], s["end"]) for r in rows if r["doc_id"] == 0 for s in r["base"] if s["kind"] == 1] == [(0, 5006)]


def brute_suffix(rows):
    """Bytes kept of every distinct row, rows in the order of id (none last) and digest."""
    import hashlib
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for row in order:
        raw = (row[1] or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            w = raw[i:i + 100]
            if w in seen:
                gone[i:i + 100] = [True] * 100
            seen.add(w)
        out[row] = bytes(b for b, g in zip(raw, gone) if not g)
    return Counter((row[0], out[row]) for row in rows)


def test_suffix_dedup_keeps_what_is_nowhere_else(spark):
    p, q, short = prose(1), prose(2), "short text"
    for rows in ([(1, p), (None, p), (None, q)], [(1, p), (None, p), (None, short)], [(5, p), (5, q), (6, q + p)],
                 [(5, p), (5, p), (None, p), (None, p), (None, None), (NO_ID, p), (NO_ID, q), (2, q[:200] + p[50:])],
                 [(7, p + " " + p), (7, q), (7, p[10:]), (8, None)]):
        got = Counter((r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect())
        assert got == brute_suffix(rows)


def brute_near(rows, percent=85):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
    node = [("id", i) if i is not None else ("row", shingles(t)) for i, t in rows]
    sets = [shingles(t) for _, t in rows]
    root = {n: n for n in node}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(node[i])] = find(node[j])
    least = {}
    for n in node:
        value = n[1] if n[0] == "id" else NO_ID
        least[find(n)] = min(least.get(find(n), NO_ID), value)
    return Counter((i, len(s), None if least[find(n)] == NO_ID else least[find(n)],
                    (NO_ID if i is None else i) == least[find(n)]) for (i, _), s, n in zip(rows, sets, node))


def test_near_dedup_with_repeated_and_missing_ids(spark):
    a, b, c, d = (prose(10 + i) for i in range(4))
    for rows in ([(3, a), (5, a), (5, b), (7, b)],
                 [(9, a), (9, ""), (None, a), (None, b), (None, c), (8, c + " tail"), (None, "x y"), (None, None)],
                 [(3, a), (4, a + " end"), (4, b), (4, c), (6, c + " z"), (6, d), (11, d), (12, "one"), (13, "one"), (None, d)]):
        got = Counter(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()))
        assert got == brute_near(rows)


def test_line_index_forgets_a_document_on_two_rows(spark):
    line = "a line that two documents hold"
    frame = lambda ids: spark.createDataFrame([(i, line) for i in ids], DOCS)
    index = line_dedup.LineIndex(spark)
    index.insert(frame([1, 1, 2]))
    assert [(r["n_docs"], r["min_doc"]) for r in index.counts.collect()] == [(2, 1)]
    index.delete(frame([1, 1]))
    assert [(r["n_docs"], r["min_doc"]) for r in index.counts.collect()] == [(1, 2)]
    assert index.drops(index.refs(frame([2]))).count() == 0
    index.insert(frame([1]))
    index.insert(frame([1, 3]))
    index.delete(frame([1]))
    assert [(r["n_docs"], r["min_doc"]) for r in index.counts.collect()] == [(2, 2)]
    assert {r["doc"] for r in index.drops(index.refs(frame([2, 3]))).collect()} == {3}


@pytest.mark.parametrize("salts", [1, 3])
def test_large_filters_are_met_in_a_shuffle(spark, monkeypatch, salts):
    rng = random.Random(6)
    rows = [(i, "\n".join([f"a line of its own {i}", f"one of a few lines {rng.randint(0, 9)}", "the hot line of all"])) for i in range(300)]
    index = line_dedup.LineIndex(spark, n_shards=5)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    index.insert(docs)
    refs = index.refs(docs)
    small = Counter((bytes(r["key"]), r["doc"]) for r in line_dedup.probe(refs, index.filters).collect())
    large = Counter((bytes(r["key"]), r["doc"]) for r in line_dedup.probe(refs, index.filters, 0, salts).collect())
    assert small == large and 600 <= sum(small.values()) < 900
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup.probe, "__defaults__", (0, salts))
    done = line_dedup.line_dedup(docs).collect()
    assert sum(r["n_dropped"] for r in done) == 300 - 1 + 300 - 10
    assert line_dedup.probe(refs.limit(0), index.filters, 0, salts).count() == 0


def test_shards_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_BYTES", 10)
    index = line_dedup.LineIndex(spark)
    index.insert(spark.createDataFrame([(1, "x" * 2000), (2, "x" * 2000), (3, None)], DOCS))
    assert index.n_shards == 400 and index.drops(index.refs(spark.createDataFrame([(2, "x" * 2000)], DOCS))).count() == 1


def brute_knn(rows, k=5, step=50):
    import math
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    out = Counter()
    for i, v in {(i, tuple(v)) for i, v in whole if i % step == 0}:
        scores = sorted(((sum(a * b for a, b in zip(v, w)), -j) for j, w in whole if j != i), reverse=True)[:k]
        for n, (s, j) in enumerate(scores):
            out[i, n + 1, -j, max(min(s, 2 ** 63 - 1), -2 ** 63)] += 1
    return out


@pytest.mark.parametrize("scale", [1.0, 300_000.0, 1e9, 1e25, 1e200])
def test_exact_search_of_any_size(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(4)]) for i in range(120)]
    rows += [(0, [0.0, scale, 0.0, 0.0]), (50, rows[50][1]), (50, [scale, 0.0, 0.0, 0.0]), (7, rows[9][1])]
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_knn(rows)


def test_exact_search_over_several_deals(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 8)
    monkeypatch.setattr(voronoi, "BLOCKS_PER_KEY", 1)
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_knn(rows)


def test_neighbouring_large_products_stay_apart(spark):
    rows = [(0, [300_000.0]), (1, [400_000.0]), (2, [400_000.5])]
    got = voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (2, 300_000 * 256 * (400_000 * 256 + 128)), (1, 300_000 * 400_000 * 65536)]


@pytest.mark.parametrize("same_text", [True, False])
def test_copies_of_an_id_spread_over_shards(spark, same_text, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    rows = [(i if i % 3 else 0, "word " * (5 + (0 if same_text and i % 3 == 0 else i % 40))) for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 3000 and len(size) == 16 and max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 16
    for shard in size:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


CLASH = ["_", "__gone", "__m_id", "__passes", "row", "gone", "position", "passes", "m_key", "d_nth", "n_lines", "doc", "order by"]


def test_stages_with_clashing_columns(spark):
    rows = [(i, prose(i % 9) + "\nthe same line of all documents", "en", "ab"[i % 2], 5, *["v"] * len(CLASH)) for i in range(20)]
    rows += [(None, prose(77), None, None, None, *[None] * len(CLASH))] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    docs = spark.createDataFrame(rows, schema)
    for name, apply in corpus_pipeline.STAGES[1:4]:
        path = scratch_dir(spark, name)
        apply(spark, docs, SMOKE).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns, name
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(r)[5:] for r in rows}, name
        docs = out if name != "mixing" else docs


def test_rows_without_an_id_are_assembled_apart(spark):
    rows = [(None, f"word {i} " * (1 + i % 3), "s") for i in range(40)] + [(None, "equal words", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.assemble(docs, mixing.mix(docs)).collect()
    assert set(r["text"] for r in out) == set(r[1] for r in rows)


def test_registered_personal_data_counts_by_kind(spark, tmp_path):
    from simcheck.llm import queries
    far = 1 << 60                                          # not exact beside a null as a float
    texts = {None: "a@b.cc", far + 1: "1.2.3.4 and 10.0.0.1 and x@y.zz", far + 2: "+44 20 7946 0123", far + 3: None,
             far + 4: "4111 1111 1111 1111 or 4111-1111-1111-1111"}
    spark.createDataFrame(list(texts.items()), DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_boosted_pii"](spark, str(tmp_path)).collect()}
    want = {None: (1, 0, 0, 0), far + 1: (1, 2, 0, 0), far + 2: (0, 0, 0, 1), far + 3: (0, 0, 0, 0), far + 4: (0, 0, 2, 0)}
    assert {i: (r.n_email, r.n_ip, r.n_card, r.n_phone) for i, r in got.items()} == want
