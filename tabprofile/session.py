"""Session construction and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tabprofile", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` entries win over them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def storage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset, as in local tests, a temporary folder is made and removed at exit.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "path" not in _LOCAL:
        _LOCAL["path"] = tempfile.mkdtemp(prefix="tabprofile-")
        atexit.register(shutil.rmtree, _LOCAL["path"], ignore_errors=True)
    return _LOCAL["path"]


_LOCAL: dict[str, str] = {}


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the shared folder and read on from there.

    Used where several later stages must see the very same rows, or where a loop would otherwise
    grow the plan.  The table outlives lost executors, and later stages read only the columns they
    need.
    """
    path = f"{storage_root(df.sparkSession)}/tabprofile-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Makes a statement drop its shuffle files as it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ONE_AT_A_TIME = threading.Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table stored meanwhile goes once it is written; the setting is the session's, so one thread has it at a time."""
    with _ONE_AT_A_TIME:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
