"""SQL twins of the derived views, for checking results in DuckDB.

These strings re-state each operator's semantics in plain SQL over the driver
tables (DuckDB dialect: RE2 regexes, ``lambda x: ...`` list functions).  They
are the correctness oracle, not an execution path of the engine.
"""

from __future__ import annotations

from simcheck import params as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{P.WS_CLASS}+', ' ', 'g'))"


def pieces(cleaned: str) -> str:
    return (f"string_split(regexp_replace({cleaned}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))")


def raw_pieces(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


def space_pieces(s: str) -> str:
    return f"len(string_split({s}, ' '))"


def contains_any(s: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({s}, {lit(p)})" for p in patterns) + ")"


def boilerplate(s: str, patterns=None, min_words: int = P.MIN_SENTENCE_WORDS) -> str:
    patterns = P.BOILERPLATE_PATTERNS if patterns is None else patterns
    return (f"({space_pieces(s)} < {min_words} OR regexp_matches({s}, '{P.SECTION_NUMBER_RE}') "
            f"OR {contains_any(s, patterns)})")


def kept_sentences(table: str, id_col: str, index_col: str = "sentence_index") -> str:
    return (f"SELECT {id_col}, unnest(kept) AS sentence, "
            f"unnest(range(len(kept)))::INTEGER AS {index_col} FROM ("
            f"SELECT {id_col}, list_filter({pieces(clean('text'))}, "
            f"lambda s: s <> '' AND NOT {boilerplate('s')}) AS kept FROM {table})")


def split_sentences(table: str, id_col: str) -> str:
    return (f"SELECT {id_col}, unnest(parts)::VARCHAR AS sentence, "
            f"unnest(range(len(parts)))::INTEGER AS pos FROM ("
            f"SELECT {id_col}, list_filter({pieces(clean('text'))}, lambda s: s <> '') AS parts "
            f"FROM {table})")


def raw_sentences(table: str, id_col: str) -> str:
    return (f"SELECT {id_col}, unnest(parts)::VARCHAR AS sentence, "
            f"unnest(range(len(parts)))::INTEGER AS pos FROM ("
            f"SELECT {id_col}, list_filter({raw_pieces('text')}, lambda s: trim(s) <> '') AS parts "
            f"FROM {table})")


def bucket(t: str, dim: int = P.HASH_DIM) -> str:
    return f"((('0x' || substr(md5({t}), 1, 8))::UBIGINT % {dim})::BIGINT)"


def encode(src: str, dim: int = P.HASH_DIM) -> str:
    """Adds ``vec FLOAT[]`` (hashed-token unit vector) to every row of ``src``."""
    return (
        f"SELECT * EXCLUDE (b, cnt, n2), list_transform(cnt, lambda c: (c / sqrt(n2))::FLOAT) AS vec FROM ("
        f"SELECT *, list_sum(list_transform(cnt, lambda y: y * y)) AS n2 FROM ("
        f"SELECT *, list_transform(range({dim}), lambda i: len(list_filter(b, lambda x: x = i))) AS cnt FROM ("
        f"SELECT *, list_transform(string_split(lower(sentence), ' '), lambda t: {bucket('t', dim)}) AS b "
        f"FROM ({src}))))")


def cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


# Common CTE prefix: corpus and query sentences with vectors.
def base_ctes() -> str:
    return (
        f"cs AS ({kept_sentences('documents', 'doc_id')}), "
        f"qs AS ({kept_sentences('benchmark', 'item_id', 'q_index')}), "
        f"cv AS ({encode('SELECT * FROM cs')}), "
        f"qv AS ({encode('SELECT * FROM qs')}), "
        f"qt AS (SELECT item_id, count(*) AS n_sentences FROM qs GROUP BY item_id)"
    )


def top1_cte(threshold: float = P.MATCH_THRESHOLD) -> str:
    return (
        "hits AS (SELECT item_id, q_index, doc_id, sentence_index, score FROM ("
        f"SELECT q.item_id, q.q_index, c.doc_id, c.sentence_index, {cos('q.vec', 'c.vec')} AS score, "
        "row_number() OVER (PARTITION BY q.item_id, q.q_index "
        f"ORDER BY {cos('q.vec', 'c.vec')} DESC, c.doc_id, c.sentence_index) AS rn "
        f"FROM qv q, cv c) WHERE rn = 1 AND score >= {threshold})"
    )


def per_doc_cte() -> str:
    return ("mpd AS (SELECT item_id, doc_id, count(*) AS n_matches, min(q_index) AS first_q "
            "FROM hits GROUP BY item_id, doc_id)")
