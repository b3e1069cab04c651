"""Session construction and the shared scratch folder.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names (a
shared file system such as HDFS or an object store); leaving it unset there is
an error.  Only a ``local`` master without it gets a temporary folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "simcheck",
                  shuffle_partitions: int | None = None) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIMCHECK_DRIVER_MEM", "16g"))
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )
    if shuffle_partitions:          # else the session's own setting stands
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only a ``local`` master without the setting gets a
    folder of its own; on a cluster a missing setting is an error, because a
    machine-local folder would lose what other executors need.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="simcheck-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Compute ``df`` once and cut its lineage with a table in the shared folder.

    Used for intermediates consumed by several branches of one plan (Spark
    does not reuse exchanges across Python UDF subtrees).  The parquet files go
    to a fresh sub-folder of ``spark.checkpoint.dir``, so a lost executor does
    not lose them and later stages read columnar data.
    """
    path = scratch_dir(df.sparkSession, "stage")
    df.write.mode("overwrite").parquet(path)
    for made in _WATCHED:
        made.append(path)
    return df.sparkSession.read.parquet(path)


_WATCHED: list[list[str]] = []


@contextmanager
def materialized() -> Iterator[list[str]]:
    """Collects the folders that ``materialize`` writes inside the block."""
    made: list[str] = []
    _WATCHED.append(made)
    try:
        yield made
    finally:
        _WATCHED[:] = [w for w in _WATCHED if w is not made]      # by identity: nested blocks may hold equal lists


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables whose last reader is done."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``simcheck`` importable on the executors (once per SparkContext).

    Python UDF closures reference this package; ``addPyFile`` distributes a
    zip of it with the job, exactly as on a cluster.
    """
    import shutil
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="simcheck-pkg-"), "simcheck")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="simcheck")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
