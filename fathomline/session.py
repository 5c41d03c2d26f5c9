"""Session settings and the small driver-side checks the operators share."""

from __future__ import annotations

import os
import posixpath
import re
import stat
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def get_spark(app: str = "fathomline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster the master and the sizes come from spark-submit; nothing here
    overrides them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; a cluster
    session without it is an error, because a machine-local folder would be
    lost with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="fathomline-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Computed once, whatever reads it later, and safe from lost executors. The
    folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = posixpath.join(checkpoint_dir(spark), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def file_system(path: str):
    """Arrow's file system of a written file or folder, and the name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "/", path)))


def is_local(system) -> bool:
    """Whether Arrow's file system is the machine's own."""
    from pyarrow import fs

    return isinstance(system, fs.LocalFileSystem)


def local_path(path: str) -> str | None:
    """The name of a file on the machine's own file system; None if it lies elsewhere."""
    plain = re.sub(r"^file:/+", "/", path)
    return plain if plain.startswith("/") else None


def regular_file(name: str) -> os.stat_result | None:
    """Time and size of a local file; None if there is no file of that name."""
    try:
        state = os.stat(name)
    except (FileNotFoundError, NotADirectoryError):
        return None
    return state if stat.S_ISREG(state.st_mode) else None


def hadoop_file_system(spark: SparkSession, path: str):
    """Spark's file system of ``path``, and its class of paths."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


# Largest table an operator sends to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def _width(field: T.StructField) -> Column:
    """Bytes a value takes, about."""
    value = F.col(f"`{field.name}`")
    kind = field.dataType
    # Each column stands once, so that nothing is computed twice for its size.
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        total = F.aggregate(value, F.lit(0), lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0)) + 16)
        return F.coalesce(total, F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return 8 * F.greatest(F.size(value), F.lit(0)) + 16
    return F.lit(16)


def row_bytes(df: DataFrame) -> Column:
    """Bytes a row of ``df`` takes, about."""
    width = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        width = width + _width(field)
    return width


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when the rows of ``df`` together take at most ``limit`` bytes."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= limit


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its scan has fewer splits than there are cores.

    For work that is much heavier than its input. A large table is left as the
    scan splits it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Tasks per core that rows of much work are dealt to.
DEALT_PER_CORE = 2


def deal(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores.

    For rows that are much work for their bytes, by which Spark would bring them together in few tasks.
    """
    return df.repartition(DEALT_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
