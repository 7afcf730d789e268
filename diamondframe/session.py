"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    parallel = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("diamondframe")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="diamondframe-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/diamondframe/{app}/{name}-{uuid.uuid4().hex[:12]}"


def written_together(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write independent small tables at the same time."""
    with ThreadPool(max(1, len(tables))) as pool:
        done = pool.starmap(written, [(df, name) for name, df in tables.items()])
    return dict(zip(tables, done))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a small derived table once and read it back.

    The lineage ends at the files, so a lost executor costs no recomputation, and
    the planner sees the real size: it broadcasts the table in a join only while the
    files are below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
