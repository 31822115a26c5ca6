"""Session settings and the staging area for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hearthgrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # joins on a household and more need no exchange where both sides lie by household
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # many queries share the preparation stages: keep their compiled code
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # plans of several hundred columns: no call-site capture per column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder, since other executors could not read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="hearthgrid-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the staging area and read it back.

    Cuts the lineage in a way that survives lost executors and lets the planner
    see the real size of the table.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a bucket is laid out for.
BUCKET_BYTES = 64 << 20


def stage_by(df: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """Write ``df`` to the staging area in hash buckets of ``key``, sorted by it, and read it back.

    Groups, windows and joins whose keys hold ``key`` then need no exchange (joins: with the settings of :func:`build_session`). For keys that
    have a bounded number of rows each, as a bucket is one task. ``size``, the bytes that ``df`` is made from, gives the number of buckets: at least
    one for each core and at most the configured number of shuffle partitions.
    """
    spark = df.sparkSession
    number = uuid.uuid4().hex
    wanted = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{staging_dir(spark).rstrip('/')}/{name}-{number}").format("parquet").saveAsTable(f"{name}_{number}")
    return spark.table(f"{name}_{number}")


def staged_bytes(df: DataFrame) -> int:
    """Bytes of the files of a staged table, as the planner knows them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash rows on ``keys`` into the configured number of shuffle partitions.

    For rows that are small but cause much work each (a model fit, thousands of
    perturbations): a partition number given by hand is not merged by adaptive execution,
    which judges partitions by their bytes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def attach(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a staged dimension (unique on ``on``) to a fact table that may have hot keys.

    ``dim`` must come from :func:`stage`: the planner then knows its bytes and broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold``. Beyond that both sides are shuffled, and
    adaptive execution splits the partitions of hot keys.
    """
    return fact.join(dim, on, how)
