"""Registered queries of this folder, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcheck.llm import bpe, html_extraction, merkle
from simcheck.llm import exact_dedup as exact
from simcheck.llm import line_dedup as lines
from simcheck.llm import mixing, pii, quality, sharding, voronoi, whitening
from simcheck.llm import near_dedup as near
from simcheck.llm import suffix_dedup as suffix
from simcheck.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies; it is only read, on the driver."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.curriculum(mixed).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLES["op2_curriculum_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, ([3, 1, 2])[(place - 1) % 3 + 1] AS weight,
             ([-0.5, 0.0, 0.5])[(place - 1) % 3 + 1]::DOUBLE AS tilt, 2.0::DOUBLE * source_size AS most FROM p),
l AS (SELECT *, most / weight AS full_at,
        (1.5::DOUBLE * sum(source_size) OVER ()
         - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
v AS (SELECT arg_min(level, (full_at, place)) AS level FROM l WHERE level <= full_at),
t AS (SELECT l.source, source_size, tilt, least(most, coalesce(v.level * weight, most)) AS target FROM l LEFT JOIN v ON true),
b AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d),
r AS (SELECT doc_id, size, source_size, target, tilt, start,
        least(size, greatest(0, floor(target) - start)) AS a,
        least(size, greatest(0, floor(target) - source_size - start)) AS c
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (a + c)::BIGINT AS taken,
  CASE WHEN a > 0 THEN 2.0 * (start / target)
    / ((1.0 - tilt) + sqrt((1.0 - tilt) * (1.0 - tilt) + 4.0 * tilt * (start / target))) END AS position
FROM r
"""


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"text_sha256": lambda norm: F.sha2(norm, 256)}
    return exact.exact_dedup(table(spark, sf_dir, "documents"), digest)


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*)::BIGINT AS group_size, max(points) AS most FROM d GROUP BY 1),
k AS (SELECT d.text_sha256, min(doc_id) AS keep_id FROM d JOIN g ON g.text_sha256 = d.text_sha256 AND points = most GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256) JOIN k USING (text_sha256)
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) > 1),
x AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""


@query
def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


@query
def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.classify(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_text=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_minhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
        ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS alike FROM s a JOIN s b ON a.shingle = b.shingle
        AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * alike >= 85 * (a.n + b.n - alike)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""


@query
def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.col("spans")).alias("spans"))


@query
def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op5_voronoi_knn"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))



# bytes as pairs of hexadecimal digits, windows as 200 of them
ORACLES["op8_merged_transforms"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS win
      FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS p FROM d)),
f AS (SELECT win, min((doc_id, p)) AS at FROM w GROUP BY win HAVING count(*) > 1),
late AS (SELECT doc_id, p FROM w JOIN f ON f.win = w.win WHERE (doc_id, p) <> f.at),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 100 THEN 0 ELSE 1 END AS new FROM late
      WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
r AS (SELECT doc_id, run, min(p) AS s, max(p) + 100 AS e FROM g GROUP BY doc_id, run),
x AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
k AS (SELECT doc_id, s AS stop, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS start FROM r
      UNION ALL SELECT d.doc_id, n, coalesce((SELECT max(e) FROM r WHERE r.doc_id = d.doc_id), 0) FROM d),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS kept
      FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t ON t.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""


@query
def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_of(table(spark, sf_dir, "documents"))


# the inner list_reduce is one byte of the CRC, bit by bit; runs are the groups of eight, up their members' siblings
ORACLES["op11_pointer_jumping"] = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))) AS crc
  FROM documents),
h AS (SELECT doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(strlen(text) || ':' || CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS seen FROM f),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM h),
low AS (SELECT tree, 0 AS level, pos, n, leaf AS d FROM l
  UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE n > 1
  GROUP BY tree, level, pos // 8, n),
sub AS (SELECT tree, level, d FROM low WHERE n = 1),
top AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM sub) AS n, d FROM sub
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1
  GROUP BY level, pos // 8, n),
nodes AS (SELECT tree, level, pos, n, d FROM low UNION ALL SELECT -1, level, pos, n, d FROM top),
runs AS (SELECT tree, level, pos // 8 AS up, list(d ORDER BY pos) AS ds FROM nodes WHERE n > 1 GROUP BY ALL),
sides AS (SELECT nodes.tree, nodes.level, nodes.pos, array_to_string(ds[:pos % 8], '') AS before,
    array_to_string(ds[pos % 8 + 2:], '') AS after
  FROM nodes JOIN runs ON runs.tree = nodes.tree AND runs.level = nodes.level AND up = pos // 8),
walk AS (SELECT tree AS own, pos AS id, tree, 0::BIGINT AS level, pos, n, seen AS d, '' AS proof FROM l
  UNION ALL SELECT own, id, CASE WHEN w.n > 1 THEN w.tree ELSE -1 END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 1 END,
    CASE WHEN w.n > 1 THEN w.pos ELSE w.tree END // 8, (CASE WHEN w.n > 1 THEN w.n ELSE (SELECT count(*) FROM sub) END + 7) // 8,
    sha256(before || w.d || after), proof || before || after
  FROM walk w JOIN sides s ON s.tree = CASE WHEN w.n > 1 THEN w.tree ELSE -1 END
    AND s.level = CASE WHEN w.n > 1 THEN w.level ELSE 0 END AND s.pos = CASE WHEN w.n > 1 THEN w.pos ELSE w.tree END
  WHERE w.n > 1 OR w.tree >= 0),
ends AS (SELECT own, id, d, proof FROM walk w WHERE n = 1 AND (tree < 0 OR (SELECT count(*) FROM sub) = 1))
SELECT doc_id, leaf, sub.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, ends.d AS folded_root,
  ends.d = r.d AS verified
FROM l JOIN sub ON sub.tree = l.tree JOIN ends ON ends.own = l.tree AND ends.id = l.pos
  CROSS JOIN (SELECT d FROM top WHERE n = 1) r
"""


@query
def op12_weighted_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


@query
def op13_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))
