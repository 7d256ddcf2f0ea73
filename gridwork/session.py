"""Spark session helpers.

Everything in the library takes a ``SparkSession`` from the caller; these
helpers only build one for tests, the bench and local runs, and read the
shared checkpoint folder that a cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "gridwork") -> SparkSession:
    """A local session configured the way the library expects a cluster to be."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, which every
    executor of a cluster can reach. Only in local mode, where it may be unset
    (tests, a laptop), a private folder is made and set on the session."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="gridwork-ckpt-")
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and survives lost executors like ``checkpoint()``, but is
    columnar and compressed, and keeps column statistics. The folder goes when
    the session's JVM ends."""
    return stage_table(df)[0]


#: Spark's setting by which the shuffle files of an execution go when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written or counted inside leaves no shuffle files: its result is all that is read again. Otherwise
    they stay until the driver's garbage collector comes upon them, beside those of all later stages."""
    known = spark.conf.isModifiable(CLEAN_SHUFFLES)
    before = spark.conf.get(CLEAN_SHUFFLES, None) if known else None
    if known:
        spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        if known:
            spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)


#: The stages that end with the innermost :func:`dropping_stages`.
_STAGES: ContextVar[list[str] | None] = ContextVar("stages", default=None)


@contextmanager
def dropping_stages(spark: SparkSession) -> Iterator[None]:
    """Stages made inside are removed at the end: what was made of them is stored by then."""
    made: list[str] = []
    token = _STAGES.set(made)
    try:
        yield
    finally:
        _STAGES.reset(token)
        for path in made:
            drop_stage(spark, path)


def _new_stage(spark: SparkSession) -> str:
    """The path of a stage that is written next; it goes with the JVM, or before."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    if hasattr(spark, "_jvm"):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    if (made := _STAGES.get()) is not None:
        made.append(path)
    return path


def _write_stage(df: DataFrame, path: str, mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    with freeing_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def stage_table(df: DataFrame) -> tuple[DataFrame, str]:
    """As :func:`cut_lineage`, with the folder's path."""
    path = _new_stage(df.sparkSession)
    _write_stage(df, path)
    return df.sparkSession.read.parquet(path), path


def drop_stage(spark: SparkSession, path: str) -> None:
    """Remove a folder of :func:`stage_table` that nothing reads any more."""
    if hasattr(spark, "_jvm"):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(target, True)
        fs.cancelDeleteOnExit(target)


def in_slices(df: DataFrame, key: str, n: int, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``job(df)`` for a job whose rows never meet rows of another ``key``, in ``n`` slices by the hash of ``key``.

    ``df`` is stored by slice and each slice's result is added to one stored table, so the disk has the shuffles and
    stages of one slice at a time, beside ``df`` and the results. One slice is ``job(df)``, with nothing stored."""
    if n <= 1:
        return job(df)
    spark = df.sparkSession
    number = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    source, path = _new_stage(spark), _new_stage(spark)
    _write_stage(df.withColumn("_slice", number), source, by=("_slice",))
    stored = spark.read.schema(df.withColumn("_slice", number).schema).parquet(source)
    for i in range(n):
        with dropping_stages(spark):
            result = job(stored.filter(F.col("_slice") == i).drop("_slice"))
            _write_stage(result, path, mode="append")
    drop_stage(spark, source)
    return spark.read.schema(result.schema).parquet(path)


#: More partitions than any table has.
EVERY = 1_000_000


def in_parts(df: DataFrame) -> DataFrame:
    """``df`` as it is, its partitions too; what follows is compiled apart from
    what came before. Many steps in one generated method are too long for the
    JVM's compiler, which then runs them several times slower; a ``coalesce``
    to at least the partitions there are moves no row and parts the two."""
    return df.coalesce(EVERY)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``gridwork`` importable in the Python workers (``addPyFile`` of a
    zip of the package, once per application) - the functions behind
    ``mapInPandas`` and pandas UDFs are pickled by module reference."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # Spark Connect
        sc, key = None, f"connect-{id(spark)}"
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="gridwork-pkg-"), "gridwork.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
