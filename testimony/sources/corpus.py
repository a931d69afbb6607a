"""Reading the corpus and the vocabularies, and writing the report's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions import text as T


def payload_fields(posts: DataFrame, payload: str = "payload") -> DataFrame:
    """Text and time out of the raw JSON payload; a malformed payload gives nulls."""
    return posts.withColumns({"text": F.get_json_object(payload, "$.text"), "posted_at": F.try_to_timestamp(F.get_json_object(payload, "$.created_at"))})


def read_corpus(posts: DataFrame, placements: DataFrame, closure: DataFrame, authors: DataFrame, root, start, end, match: str | None = None, limit: int | None = None) -> DataFrame:
    """Posts whose current placement lies in a subtree, posted in [start, end), with their author, in order.

    ``match`` keeps posts whose folded text contains it; ``limit`` is the caller's own.
    """
    here = placements.where("superseded_at is null").join(closure.where(F.col("ancestor") == F.lit(root)).select(F.col("descendant").alias("place_id")), "place_id", "left_semi")
    found = posts.where((F.col("posted_at") >= F.lit(start).cast("timestamp")) & (F.col("posted_at") < F.lit(end).cast("timestamp"))).join(here.select("post_id"), "post_id", "left_semi")
    if match is not None:
        found = found.where(F.contains(T.fold(F.col("text")), T.fold(F.lit(match))))
    out = found.join(authors, "author_id", "left").orderBy("posted_at", "post_id")
    return out if limit is None else out.limit(limit)


def skip_held(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return rows.join(held.select(key).distinct(), key, "left_anti")


def write_report(queues: DataFrame, path: str) -> None:
    queues.write.mode("overwrite").partitionBy("event_id", "kind").parquet(path)


def append_residue(residue: DataFrame, path: str) -> None:
    residue.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
