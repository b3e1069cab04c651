"""The corpus index: sentences and vectors of ``documents``, written once.

The service encodes its corpus at ingest time and every check only searches
it.  Here the same split: the first query that needs corpus sentences writes
``(doc_id, sentence_index, sentence, vec)`` as parquet into the shared
checkpoint folder, sorted by ``doc_id`` within files (row-group statistics let
lookups by document skip data), and every later query reads that table.  The
location is keyed by path, size and modification time of every input file and
by the parameters of the splitter and the encoder, so a changed input or a
changed parameter builds a new index.  A partial write is never read: the index
is used only when Spark's ``_SUCCESS`` marker exists.

Queries that ask for sentences alone read a table of their own, written without
encoding anything.  Rows are in order because the documents are sorted before
they are split, so a task sorts texts and not vectors ten times their size.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simcheck import params as P
from simcheck.operators import sentences as S
from simcheck.operators import sparse as SP
from simcheck.operators.ann import VectorStore
from simcheck.operators.spell import SpellIndex
from simcheck.operators.topics import TopicStore
from simcheck.operators.word_vectors import WordVectorStore, train
from simcheck.session import checkpoint_root
from simcheck.sources.tables import load, table_path

_BUILT: set[str] = set()


def _fs_status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_status(spark, path)
    return fs.exists(p)


def _signature(spark: SparkSession, path: str) -> str:
    fs, p = _fs_status(spark, path)
    files = fs.listFiles(p, True)
    raw = []
    while files.hasNext():
        st = files.next()
        raw.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
    built_with = [P.BOILERPLATE_PATTERNS, P.MIN_SENTENCE_WORDS, P.HASH_DIM, P.WS_CLASS, P.SECTION_NUMBER_RE,
                  P.SENTENCE_END_RE, P.SENTENCE_SEP]
    return hashlib.sha256(repr((sorted(raw), built_with)).encode()).hexdigest()


def corpus_index_path(spark: SparkSession, sf_dir: str) -> str:
    src = table_path(sf_dir, "documents")
    return f"{checkpoint_root(spark).rstrip('/')}/corpus-index/{_signature(spark, src)}"


def _publish(spark: SparkSession, sf_dir: str, path: str, rows, force: bool = False) -> str:
    """Write ``rows`` of the documents under ``path`` if it is not there yet (or when ``force``); returns the path.

    The table is written into a unique temporary folder and published with one
    directory rename, so concurrent builders and killed jobs never expose a
    partial index; when another builder published first, its index is used.
    """
    import uuid

    if not force and (path in _BUILT or _exists(spark, f"{path}/_SUCCESS")):
        _BUILT.add(path)
        return path
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").sortWithinPartitions("doc_id")
    rows(docs).write.mode("overwrite").parquet(tmp)
    fs, target = _fs_status(spark, path)
    _, src = _fs_status(spark, tmp)
    fs.mkdirs(target.getParent())
    if force and fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(src, target):          # lost the race: keep the published one
        fs.delete(src, True)
    _BUILT.add(path)
    return path


def build_corpus_index(spark: SparkSession, sf_dir: str, force: bool = False) -> str:
    """The path of the sentences with their vectors, written if they are not there yet."""
    return _publish(spark, sf_dir, corpus_index_path(spark, sf_dir), lambda d: S.encode(S.corpus_sentences(d)), force)


def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentence_index, sentence, vec) of the corpus, from the index."""
    return spark.read.parquet(build_corpus_index(spark, sf_dir))


def corpus_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sentence_index, sentence) of the corpus, from the sentence table."""
    path = corpus_index_path(spark, sf_dir).replace("/corpus-index/", "/sentence-index/")
    return spark.read.parquet(_publish(spark, sf_dir, path, S.corpus_sentences))


def spell_index(spark: SparkSession, sf_dir: str) -> SpellIndex:
    """Word counts and deletion keys of the corpus sentences, written once."""
    path = corpus_index_path(spark, sf_dir).replace("/corpus-index/", "/spell-index/")
    index = SpellIndex(spark, path)
    index.add(0, corpus_sentences(spark, sf_dir))
    return index


def vector_store(spark: SparkSession, sf_dir: str) -> VectorStore:
    """The vectors of ``embeddings`` by cell, trained and written once."""
    src = table_path(sf_dir, "embeddings")
    store = VectorStore(spark, f"{checkpoint_root(spark).rstrip('/')}/vector-store/{_signature(spark, src)}", "vec_id")
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    if store.version() is None:
        store.train(rows, nlist=max(2, min(P.IVF_NLIST, rows.count() // P.IVF_CELL_ROWS)))
    store.add(0, rows)
    return store


def word_vectors(spark: SparkSession, sf_dir: str) -> WordVectorStore:
    """Word vectors of the documents, trained and written once."""
    src = table_path(sf_dir, "documents")
    store = WordVectorStore(spark, f"{checkpoint_root(spark).rstrip('/')}/word-vectors/{_signature(spark, src)}")
    if store.version() is None:
        store.publish(train(load(spark, sf_dir, "documents").select("text")))
    return store


def topic_model(spark: SparkSession, sf_dir: str, k: int = P.LDA_TOPICS, passes: int = P.LDA_PASSES) -> TopicStore:
    """Topics of the corpus sentences, fitted and written once.

    Dictionary: tokens seen more than once, minus the 40 most frequent.
    """
    path = corpus_index_path(spark, sf_dir).replace("/corpus-index/", "/topic-model/")
    store = TopicStore(spark, f"{path}-{k}-{passes}")
    if not store.batches():
        keys = ["doc_id", "sentence_index"]
        tok = SP.tokens(corpus_sentences(spark, sf_dir), keys)
        stop = SP.stopwords(tok, P.STOPWORDS_LDA).select("token")
        vocabulary = SP.frequent_tokens(tok).select("token").join(F.broadcast(stop), "token", "left_anti")
        store.train(tok, keys, vocabulary, k, passes)
    return store
