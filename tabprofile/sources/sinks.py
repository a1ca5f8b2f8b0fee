"""Writing transformed datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabprofile.session import storage_root


def write_dataset(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write a dataset in parts.  Parquet keeps types; CSV is for exchange with other tools."""
    writer = df.write.mode(mode)
    if format == "parquet":
        writer.parquet(path)
    elif format == "csv":
        writer.csv(path, header=True)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown output format '{format}'")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder (see :func:`storage_root`)."""
    return f"{storage_root(spark)}/tabprofile-{name}-{uuid.uuid4().hex}.parquet"
