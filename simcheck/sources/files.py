"""File sources: recursive scans, archives, JSON sentence lists.

Everything is a DataFrame reader; per-file Python (zip expansion) runs in
``mapInPandas`` on the executors, one archive per row, never on the driver.
"""

from __future__ import annotations

import io
import zipfile
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentences in a line of a part file, at most.
PART_LINE = 1000
#: Bytes of archive members that leave a task at once, and what a member takes beside its content.
MEMBER_BYTES, MEMBER_OVERHEAD = 16 << 20, 512


def scan_files(spark: SparkSession, root: str, glob: str = "*.pdf", recursive: bool = True,
               with_content: bool = False) -> DataFrame:
    """Every file under ``root`` matching ``glob``; content only when asked
    (the binaryFile reader skips reading bytes when ``content`` is pruned)."""
    df = (spark.read.format("binaryFile")
          .option("recursiveFileLookup", str(recursive).lower())
          .option("pathGlobFilter", glob)
          .load(root))
    cols = ["path", "length", "modificationTime"] + (["content"] if with_content else [])
    return df.select(*cols)


MEMBER_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def _file_system(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs as pafs
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.replace("file:", "", 1)


def expand_archives(archives: DataFrame) -> DataFrame:
    """S3: one row per member of every zip archive.

    Rows with (path, content) are opened from their content, rows with a path
    alone are read where they lie, member by member.  Members leave a task in
    batches of about ``MEMBER_BYTES``.
    """
    def opened(path, content):
        if content is not None:
            return io.BytesIO(content)
        filesystem, name = _file_system(path)
        return filesystem.open_input_file(name)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows, held = [], 0
                with opened(path, content) as file, zipfile.ZipFile(file) as zf:
                    for info in zf.infolist():
                        if info.is_dir():
                            continue
                        rows.append((path, info.filename, info.file_size, zf.read(info)))
                        held += info.file_size + MEMBER_OVERHEAD
                        if held > MEMBER_BYTES:
                            yield pd.DataFrame(rows, columns=MEMBER_SCHEMA.fieldNames())
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=MEMBER_SCHEMA.fieldNames())

    content = F.col("content") if "content" in archives.columns else F.lit(None).cast("binary").alias("content")
    return archives.select("path", content).mapInPandas(expand, MEMBER_SCHEMA)


def write_zip_archives(df: DataFrame, key_col: str, name_col: str, text_col: str, out_dir: str) -> int:
    """Pack rows into zip archives (one per ``key_col`` group) under ``out_dir``.

    Runs inside the executors and writes through ``pyarrow.fs``, so ``out_dir``
    may be a shared HDFS/S3 URI as well as a local path.  The rows of an archive
    come to its task in order and go into it as they come, so no group is held.
    A retried task rewrites the same archive name (idempotent).  Returns the
    number of archives.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _file_system(out_dir)
        filesystem.create_dir(base, recursive=True)
        done, file, zf = [], None, None
        for pdf in batches:
            for key, name, text in zip(pdf[key_col].astype(object), pdf[name_col], pdf[text_col]):
                path = f"{base.rstrip('/')}/{key}.zip"
                if not done or done[-1] != path:
                    if zf:
                        zf.close()
                        file.close()
                    file = filesystem.open_output_stream(path)
                    zf = zipfile.ZipFile(file, "w", compression=zipfile.ZIP_DEFLATED)
                    done.append(path)
                zf.writestr(str(name), (text or "").encode("utf-8"))
        if zf:
            zf.close()
            file.close()
        if done:
            yield pd.DataFrame({"archive": done})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.select(key_col, name_col, text_col).repartition(parts, key_col).sortWithinPartitions(key_col)
            .mapInPandas(pack, "archive string").count())


def load_sentence_list(spark: SparkSession, path: str) -> DataFrame:
    """Files holding JSON arrays of strings -> (file, list_no, pos, sentence, status).

    A file is one array, however it is indented, or one array per line.  The
    JSON reader cannot turn a top-level scalar array into rows, so texts are
    parsed with ``from_json`` and exploded with their position.  What does not
    parse becomes one row with status ``error``, never a lost file.
    """
    schema = "array<string>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    whole = F.from_json("value", schema)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    lists = F.when(whole.isNotNull() & (F.size(lines) == 1), F.array(whole)) \
        .when(F.exists(lines, lambda x: F.from_json(x, schema).isNull()), F.array(whole)) \
        .otherwise(F.transform(lines, lambda x: F.from_json(x, schema)))
    found = raw.select("file", F.posexplode_outer(lists).alias("list_no", "items"))
    status = F.when(F.col("items").isNull(), "error").otherwise("ok").alias("status")
    return found.select("file", "list_no", F.posexplode_outer("items").alias("pos", "sentence"), status) \
        .where((F.col("status") == "error") | F.col("pos").isNotNull())


def read_requested_objects(spark: SparkSession, root: str, requests: DataFrame,
                           prefix: str = "checker") -> DataFrame:
    """Fetch the objects named by requests (``{root}/{prefix}/{subject}/{file}``).

    The listing is a ``binaryFile`` scan of the prefix (``s3a://`` or local);
    a semi-join keeps the requested objects, so nothing is fetched one by one.
    """
    base = f"{root.rstrip('/')}/{prefix}"
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    want = requests.select(F.concat_ws("/", F.lit(base), "subject_id", "file_name").alias("want"),
                           "file_check_id")
    norm = F.regexp_replace("path", "^file:", "")
    return (listing.withColumn("want", norm).join(want, "want")
            .select("file_check_id", "path", "length", "content"))


def extract_pages(files: DataFrame, extractor) -> DataFrame:
    """U8 hook: ``extractor(path, content)`` yields one text per page, applied
    per file on the executors.  A page that cannot be read is data: an extractor
    that yields an exception in its place goes on with the next page, one that
    raises ends the file there; either leaves a row with the page's number, no
    text and the error as status.  Output (path, page_num, text, status)."""
    schema = T.StructType([T.StructField("path", T.StringType()),
                           T.StructField("page_num", T.IntegerType()),
                           T.StructField("text", T.StringType()),
                           T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = lambda e: f"error: {type(e).__name__}"
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                page = 0
                try:
                    for text in extractor(path, content):
                        bad = isinstance(text, Exception)
                        rows.append((path, page, None if bad else text, failed(text) if bad else "ok"))
                        page += 1
                except Exception as e:  # noqa: BLE001 - per-page failure is data
                    rows.append((path, page, None, failed(e)))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return files.select("path", "content").mapInPandas(run, schema)


def write_sentence_list(sentences: DataFrame, path: str, group_col: str,
                        order_col: str, sentence_col: str = "sentence") -> None:
    """K5: one JSON array of sentences per group (a line each), in order."""
    lists = sentences.groupBy(group_col).agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct(order_col, sentence_col))),
        lambda x: x[sentence_col])).alias("value"))
    lists.select("value").write.mode("overwrite").text(path)


def write_parts(rows: DataFrame, path: str, part_col: str, order_col: str, sentence_col: str = "sentence",
                per_line: int = PART_LINE) -> None:
    """K6: exactly one file per part, under ``part=N``, its sentences in order.

    ``order_col`` counts the sentences; a file holds one JSON array of at most ``per_line`` of them per line, so
    no row holds a part; ``load_sentence_list`` reads it back.
    """
    lines = (rows.groupBy(part_col, F.expr(f"{order_col} div {per_line}").alias("__block")).agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct(order_col, sentence_col))), lambda x: x[sentence_col])).alias("value")))
    (lines.select(F.col(part_col).alias("part"), "__block", "value").repartitionByRange("part")
     .sortWithinPartitions("part", "__block").select("part", "value")
     .write.mode("overwrite").partitionBy("part").text(path))


def write_word_counts(counts: DataFrame, path: str) -> None:
    """K5: word counts as JSON rows, highest count first."""
    counts.orderBy(F.col("cnt").desc(), F.col("word")).write.mode("overwrite").json(path)


def load_word_count_map(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON object word -> count -> (word, cnt) rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "cnt"))
