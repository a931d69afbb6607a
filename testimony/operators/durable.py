"""Intermediate tables that survive lost executors, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast up to this many rows and bytes, as counted.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a local master only."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="testimony-"))
    return _own[0]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running on it, not the work
    before this point, and a table that is used twice is computed once.
    """
    path = shared_path(df.sparkSession, "settled")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value has in a broadcast table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        inner = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0), lambda n, x: n + _bytes(x, kind.elementType).cast("int"))
        return F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes are counted to be few; else as it is, for a shuffle join."""
    if rows is not None and rows > BROADCAST_ROWS:
        return df
    width = sum((_bytes(df[f.name], f.dataType) for f in df.schema.fields), F.lit(16))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df
