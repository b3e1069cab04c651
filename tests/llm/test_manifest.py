"""Merkle manifest, whitening and page differencing against brute force."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simcheck.llm import html_extraction as pages
from simcheck.llm import merkle, queries, whitening

SMOKE = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf int, `group` string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in merkle.FIELDS))


def lowered(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    text = r["text"]
    return r | {"text": "".join(c.lower() if "A" <= c <= "Z" else c for c in text)} if hit and text is not None else r


def level_up(nodes, paths):
    """One level of digests; ``paths`` are the leaves below each node, which get the siblings' digests."""
    out, below = [], []
    for i in range(0, len(nodes), 8):
        run = nodes[i:i + 8]
        for j, leaves in enumerate(paths[i:i + 8]):
            for x in leaves:
                x["proof"].append((run[:j], run[j + 1:]))
        out.append(h("".join(run)))
        below.append([x for leaves in paths[i:i + 8] for x in leaves])
    return out, below


def brute_manifest(rows):
    leaves = [{"id": r["doc_id"], "lang": r["lang"], "leaf": leaf(r), "seen": leaf(lowered(r)), "proof": []} for r in rows]
    null_first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({x["lang"] for x in leaves}, key=lambda v: (v is not None, (v or "").encode()))
    tops, below = [], []
    for lang in langs:
        mine = sorted((x for x in leaves if x["lang"] == lang), key=lambda x: (null_first(x["id"]), x["leaf"]))
        nodes, paths = [x["leaf"] for x in mine], [[x] for x in mine]
        while len(nodes) > 1:
            nodes, paths = level_up(nodes, paths)
        for x in mine:
            x["subroot"] = nodes[0]
        tops.append(nodes[0])
        below.append(mine)
    while len(tops) > 1:
        tops, below = level_up(tops, below)
    out = Counter()
    for x in leaves:
        node = x["seen"]
        for before, after in x["proof"]:
            node = h("".join(before) + node + "".join(after))
        proof = h("".join(d for before, after in x["proof"] for d in before + after))
        out[x["id"], x["leaf"], x["subroot"], tops[0], proof, node, node == tops[0]] += 1
    return out


def documents(n_langs=11):
    rng = random.Random(4)
    rows = []
    for lang, n in [("en", 530), (None, 9), ("de", 8), ("fr", 1), ("es", 65)] + [(f"x{i}é", 2) for i in range(n_langs)]:
        for _ in range(n):
            i = len(rows)
            text = rng.choice([None, "", f"Words {i}", "lower only", "É" * 9, "A" * 30_000 if i == 40 else "Same Text"])
            rows.append((i, text, lang, rng.choice([None, "", "s"]), rng.choice([None, i])))
    rows += [rows[3], rows[3], (None, "No Id", "en", None, None), (None, None, None, None, None), (7, "other", "en", "s", 1)]
    rng.shuffle(rows)
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]


@pytest.mark.parametrize("cut", [None, 1, 5, 9])
def test_manifest_equals_brute_force(spark, cut):
    rows = documents()[:cut]
    if cut:
        rows = [r | {"lang": "en"} for r in rows]
    df = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "t", 1, "g") for r in rows],
                               DOCS).repartition(3)
    got = merkle.manifest_of(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute_manifest(rows)


def test_manifest_shuffles_as_it_broadcasts(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "t", 1, "g") for r in rows],
                               DOCS)
    monkeypatch.setattr(merkle, "small_or_shuffled", lambda d, _: d)
    assert Counter(map(tuple, merkle.manifest_of(df).collect())) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert merkle.manifest_of(spark.createDataFrame([], DOCS)).collect() == []


def test_any_change_breaks_the_proof(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "s", 1, "", 1, "") for i in range(100)], DOCS)
    cut = merkle.manifest_of(df, lambda f: merkle.leaf(f | {"n_chars": F.lit(2)}))
    assert not cut.filter("verified").count() and cut.count() == 100


VECTORS = "vec_id long, embedding array<float>, key string, w int, copies string"


def vector_rows(dim=6, n=200):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) / 4).astype(np.float32).astype(float)
    rows = [(i, x.tolist(), "k", 1, "c") for i, x in enumerate(v)]
    rows += [(500 + i, v[0].tolist(), "k", 1, "c") for i in range(150)]         # one hot vector
    odd = [None, [], [None] + [0.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [-float("inf")] + [0.0] * (dim - 1),
           [1.0, 2.0], [3e38] * dim]
    rows += [(None, v[1].tolist(), None, None, None), (3, v[2].tolist(), None, None, None)]
    return rows + [(900 + i, x, None, None, None) for i, x in enumerate(odd)]


def brute_whitening(rows, dim, weighted=False, k=4):
    fit = [(i, tuple(int(np.floor(256 * c)) for c in e)) for i, e, *_ in rows
           if e and len(e) == dim and all(c is not None and abs(c) < 2 ** 54 for c in e)]
    copies = Counter(x for _, x in fit)
    x = np.array(list(copies), float)
    w = np.array([copies[tuple(int(c) for c in r)] if weighted else 1 for r in x], float)
    n, sums = int(w.sum()), [int(s) for s in (x * w[:, None]).sum(0)]
    c = x - np.array([s / n for s in sums])
    v = (c * w[:, None]).T @ c / n
    values, axes = np.linalg.eigh(v)
    return fit, n, sums, v, values[::-1][:k], axes[:, ::-1][:, :k]


@pytest.mark.parametrize("weights,limit", [("one", 1 << 20), ("one", 0), ("copies", 0)])
def test_whitening_equals_numpy(spark, monkeypatch, weights, limit):
    monkeypatch.setattr(whitening, "HOT_ROWS", 20)
    rows = vector_rows()
    got = whitening.whitened_rows(spark.createDataFrame(rows, VECTORS).repartition(3), weights=weights, limit=limit).toPandas()
    fit, n, sums, v, values, axes = brute_whitening(rows, 6, weights == "copies")
    assert Counter(got["vec_id"].fillna(-1)) == Counter({-1: 4} | {i: 0 for i, _ in fit if i is not None}) + Counter(
        [i for i, _ in fit if i is not None] * 4)
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    want = Counter()
    sign = {}
    for i, x in fit:
        d = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        p = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        for c in range(4):
            want[i if i is not None else -1, c + 1, d, round(abs(p[c]), 7)] += 1
            sign.setdefault(i, p)
    seen = Counter((-1 if np.isnan(r.vec_id) else int(r.vec_id), r.component, r.deviation, round(abs(r.whitened), 7))
                   for r in got.itertuples())
    assert seen == want
    for c in range(4):
        flips = {np.sign(r.whitened * sign[r.vec_id][c]) for r in got[got.component == c + 1].itertuples()
                 if r.vec_id in sign and r.vec_id != 3 and abs(r.whitened) > 1e-9}
        assert len(flips) == 1
        assert np.allclose(got[got.component == c + 1]["explained"], values[c] / np.trace(v), rtol=1e-9)


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [0.5, -0.25, 1.0], "", 1, "") for i in range(5)], VECTORS)
    rows = whitening.whitened_rows(same).collect()
    assert len(rows) == 15 and {(r["deviation"], r["whitened"], r["identity_error"]) for r in rows} == {(0, None, None)}
    assert whitening.whitened_rows(spark.createDataFrame([], VECTORS)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "", 1, "") for i in range(9)], VECTORS)
    by = {(r["component"], r["whitened"] is None) for r in whitening.whitened_rows(line).collect()}
    assert by == {(1, False), (2, True), (3, True)}


def test_deviation_beyond_a_long(spark):
    big = float(1 << 40)
    rows = whitening.whitened_rows(spark.createDataFrame([(0, [big, 0.0], "", 1, ""), (1, [-big, 1.0], "", 1, "")], VECTORS)).collect()
    x = int(big) * 256
    assert {r["deviation"] for r in rows} == {None}
    assert {int(r["deviation_exact"]) for r in rows} == {(2 * x) ** 2 + 256 ** 2}


def test_registered_whitening_on_the_smoke_table(spark):
    got = queries.op12_weighted_covariance(spark, SMOKE).toPandas()
    raw = spark.read.parquet(f"{SMOKE}/embeddings.parquet").toPandas()
    rows = [(i, [float(c) for c in e]) for i, e in zip(raw["vec_id"], raw["embedding"])]
    fit, n, sums, v, values, axes = brute_whitening(rows, 64)
    assert len(got) == 4 * len(fit) and got["identity_error"].max() < 1e-9
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in fit}
    assert all(exact[r.vec_id] == r.deviation for r in got.itertuples())
    for c in range(4):
        mine = got[got.component == c + 1].set_index("vec_id")["whitened"]
        p = np.array([(np.array(x) - np.array(sums) / n) @ axes[:, c] / np.sqrt(values[c]) for _, x in fit])
        other = mine.loc[[i for i, _ in fit]].to_numpy()
        assert min(np.abs(other - p).max(), np.abs(other + p).max()) < 1e-6


def brute_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("table", [1 << 24, 64])
def test_alignment_is_longest(monkeypatch, table):
    monkeypatch.setattr(pages, "TABLE_BYTES", table)
    rng = random.Random(1)
    for _ in range(300):
        k = rng.choice([2, 3, 9])
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = pages.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == brute_lcs(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_alignment_of_very_many_lines():
    a = list(range(60_000)) + [1, 2] * 5000
    b = [x for x in a if x % 7] + [-1] * 100
    assert len(pages.common_lines(a, b)) == len([x for x in a if x % 7])


PAGES = "page_id long, url string, html string, host string, rank int, gone string"


def extracted(spark, rows, **kw):
    df = spark.createDataFrame([(i, u, t, "h", 1, "g") for i, u, t in rows], PAGES).repartition(3)
    return {(r["page_id"], r["url"]): r for r in pages.extract(df, **kw).collect()}


def test_text_of_an_article(spark):
    rows = [
        (1, "http://a.example/x", "<head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul>"
         "<li><a href='/q'>One</a></li></ul></nav><!-- c <p>no</p> --><div class=\"ad\">Buy</div><article><h1>Head &amp; line</h1>"
         "<p><b>First   line\n here<br>next<p>Two&nbsp;words &#233; &lt;b&gt; &am</article><footer>&copy; foot</footer>"),
        (2, "http://b.example/x", "<article><header><h2>Title</h2><p>By me</p></header>Text<form>Name <input></form><aside>Side</aside>"
         "<div class='cookie-notice'>Cookies!</div><p>in<b>li</b>ne</p><section id=comments><p>Nice</p></section>"
         "<article class=comment>Reader</article></article><p>outside</p>"),
        (3, "http://c.example/x", None), (4, "http://c.example/y", ""), (5, None, "<p>no url</p>"), (6, "no host", "plain < text"),
        (7, "http://d.example/", "<p title=\"a > b\">kept</p><p hidden>not</p><style>x{} </style><textarea>no</textarea>"),
        (None, "http://e.example/", "<ul><li><a>Menu</a></li><li><a>Menu 2</a></li></ul><p>Body <a>with link</a></p>"),
    ]
    got = {k[0]: r["text"] for k, r in extracted(spark, rows).items()}
    assert got == {1: "Head & line First line here next Two words é <b> &am", 2: "Title Text inline", 3: "", 4: "",
                   5: "no url", 6: "plain < text", 7: "kept", None: "Body with link"}
    assert all(r["n_chars"] == len(r["text"]) for r in extracted(spark, rows).values())


def soup(top, body, end, number):
    """A page whose markup names nothing."""
    return (f"<html><body><div>{top}</div><div><span>Welcome, reader</span></div><!-- {number} --><div>"
            + "".join(f"<div>{p}</div>" for p in body) + f"</div><div>All rights with {end}</div></body></html>")


def test_differencing_finds_unnamed_templates(spark):
    rng = random.Random(9)
    rows, want = [], {}
    shared = "A paragraph that two pages quote word for word."
    for host, n in [("hot.example", 700), ("two.example", 2), ("one.example", 1)]:
        for i in range(n):
            body = [f"{host} text {i} part {j} {rng.random()}" for j in range(rng.randint(1, 4))]
            if i in (10, 400):
                body.insert(0, shared)
            url = f"https://{host}/en/{i * 7919 % 1000}?page=2"
            rows.append((len(rows), url, soup("Top of " + host, body, host, i)))
            alone = n == 1
            left = ["Top of one.example", "Welcome, reader", *body, "All rights with one.example"] if alone else body
            want[len(rows) - 1, url] = " ".join(left)
    copies = [(9000 + i, f"https://hot.example/en/{i * 5}/copy", rows[3][2].replace("<!-- 3 -->", f"<!-- c{i} -->")) for i in range(90)]
    for i, u, _ in copies:
        want[i, u] = want[rows[3][0], rows[3][1]]
    got = extracted(spark, rows + copies)
    assert {k: r["text"] for k, r in got.items()} == want
    assert got[9000, copies[0][1]]["n_shared"] == 3


def test_prose_of_articles_is_aligned_too(spark):
    quote = "A passage that every page quotes word for word."

    def page(i, tag):
        return (f"<div>Top</div><{tag}><p>own {i}</p><p>{quote}</p><p>own end {i}</p></{tag}><div>End</div>")
    rows = [(i, f"http://a.example/{i}", page(i, "article")) for i in range(5)]
    rows += [(10 + i, f"http://b.example/{i}", page(i, "section")) for i in range(5)]
    rows += [(20, "http://c.example/0", page(0, "article")), (21, "http://c.example/1", f"<p>{quote}</p><p>own 0</p>")]
    got = {k[0]: r for k, r in extracted(spark, rows).items()}
    for i in range(5):
        assert (got[i]["text"], got[i]["n_shared"], got[i]["n_quoted"]) == (f"own {i} {quote} own end {i}", 2, 1)
        assert (got[10 + i]["text"], got[10 + i]["n_shared"], got[10 + i]["n_quoted"]) == (f"own {i} own end {i}", 3, 0)
    assert [(got[i]["text"], got[i]["n_shared"], got[i]["n_quoted"]) for i in (20, 21)] == [
        (f"own 0 {quote} own end 0", 0, 0), (f"{quote} own 0", 0, 0)]


def test_blocks_of_ranks_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, f"http://h.example/{i:03d}", soup(f"T{i // 3}", [f"own {i}"], f"E{i // 5}", i)) for i in range(80)]
    one = {k: r["text"] for k, r in extracted(spark, rows).items()}
    monkeypatch.setattr(pages, "BLOCK", 7)
    assert {k: r["text"] for k, r in extracted(spark, rows).items()} == one


def test_no_pages(spark):
    assert extracted(spark, []) == {}


def test_registered_extraction_on_the_smoke_table(spark):
    got = {r["page_id"]: r["text"] for r in queries.op13_page_differencing(spark, SMOKE).collect()}
    raw = spark.read.parquet(f"{SMOKE}/pages.parquet").collect()
    assert len(got) == len(raw)
    import html
    import re
    for r in raw:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"<(?:/?p|/?h1|br)>", re.sub(r"</?b>", "", article))
        want = " ".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert got[r["page_id"]] == want
