"""Incremental forms of the record's tables on Structured Streaming.

State is bounded by watermarks. What comes later than that is kept apart (``late_posts``), and the slices it falls in
are counted again in batch over all that came.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from testimony.operators.durable import settle, shared_path


def stream_posts(posts: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Posts once each: a re-found post changes nothing while the watermark remembers it."""
    return posts.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def stream_slices(rows: DataFrame, at: str, seconds: int = 600, offset_seconds: int = 0, late: str = "10 minutes") -> DataFrame:
    """(slice_start, slice_end, n): tumbling slices anchored at an offset. In append mode the watermark closes
    a slice, so one that still fills is never emitted."""
    w = F.window(at, f"{seconds} seconds", startTime=f"{offset_seconds} seconds")
    return rows.withWatermark(at, late).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("slice_start"), F.col("window.end").alias("slice_end"), "n")


def stream_density(rows: DataFrame, at: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.withWatermark(at, late).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def stream_first_query(appearances: DataFrame, at: str, post: str, query: str, id_col: str) -> DataFrame:
    """(post, query, at, version): the first query of each post by (time, id), after each batch that changes it; the highest version holds.

    State is the earliest appearance of each post, for good: an appearance that comes late but was earlier takes its place. Tasks send on the
    earliest of each post among the rows that they read at once, and no row is looked at by itself.
    """

    def earliest(batches):
        for pdf in batches:
            yield pdf.sort_values(["at", "id"], kind="stable").drop_duplicates("post")

    def step(key, frames, state):
        version, held = state.get if state.exists else (0, None)
        best = json.loads(held) if held else None
        was = best
        for pdf in frames:
            when, i, q = pdf.sort_values(["at", "id"], kind="stable").iloc[0][["at", "id", "query"]]
            seen = [int(when.value), int(i), q]
            if best is None or seen[:2] < best[:2]:
                best = seen
        if best != was:
            state.update((version + 1, json.dumps(best)))
            yield pd.DataFrame({"post": [key[0]], "query": [best[2]], "at": [pd.Timestamp(best[0])], "version": [version + 1]})

    rows = appearances.select(F.col(post).cast("string").alias("post"), F.col(query).cast("string").alias("query"), F.col(at).alias("at"), F.col(id_col).cast("long").alias("id"))
    first = rows.mapInPandas(earliest, "post string, query string, at timestamp, id long")
    return first.groupBy("post").applyInPandasWithState(step, "post string, query string, at timestamp, version long", "version long, held string", "append", "NoTimeout")


def late_posts(rows: DataFrame, at: str, keep: str, late: str, delay_seconds: int = 600) -> None:
    """Run a stream to its end by batches: all rows are kept under ``keep``, and those that a watermark of ``delay_seconds`` would drop under ``late``.

    A batch's watermark is the latest time of the batches before, less the delay. A batch that is run again after a failure is written
    again under its own number, so nothing counts twice.
    """
    spark, latest = rows.sparkSession, shared_path(rows.sparkSession, "latest")

    def take(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{keep}/batch={n}")
        kept = spark.read.schema(batch.schema).parquet(f"{keep}/batch={n}")
        seen = spark.read.parquet(f"{latest}/batch={n - 1}").first()[0] if n else None
        if seen is not None:
            kept.where(F.col(at) < F.lit(seen) - F.make_dt_interval(secs=F.lit(delay_seconds))).write.mode("overwrite").parquet(f"{late}/batch={n}")
        # One row a batch: the latest time so far.
        kept.agg(F.greatest(F.max(at), F.lit(seen).cast("timestamp")).alias("at")).write.mode("overwrite").parquet(f"{latest}/batch={n}")

    marks = shared_path(spark, "offsets")
    rows.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def posts_for_ever(posts: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 16) -> None:
    """Run a stream to its end by batches and keep under ``out`` the first post of each key, for good: however late it is found again, it changes nothing.

    What a batch adds is its posts, once a key by ``order``, that no earlier batch has stored. It is written under the batch's number, so a batch that is run again after a
    failure, even one in the middle of its writing, replaces what it wrote and looks at earlier batches only. Stored keys lie in buckets by their hash; a batch reads the keys of the
    buckets that it touches. Start it again with the same ``out`` to go on: offsets lie beside it. Null keys are keys. Read the result with ``stored_posts``.
    """
    spark = posts.sparkSession
    kind = T_.StructType([*posts.schema.fields, T_.StructField("bucket", T_.IntegerType())])

    def take(batch: DataFrame, n: int) -> None:
        rank = Window.partitionBy(*keys).orderBy(*order)
        mine = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        mine = settle(mine.withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k"))
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]
        stored = _stored(spark, out, kind).where((F.col("batch") < n) & F.col("bucket").isin(touched)).select(*[F.col(k).alias(f"_{k}") for k in keys]) if n else None
        if stored is not None:
            same = F.lit(True)
            for k in keys:
                same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
            mine = mine.join(stored, same, "left_anti")
        mine.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/posts/batch={n}")

    posts.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start().awaitTermination()


def _stored(spark, out: str, kind: T_.StructType) -> DataFrame:
    return spark.read.schema(T_.StructType([*kind.fields, T_.StructField("batch", T_.LongType())])).option("basePath", f"{out}/posts").parquet(f"{out}/posts")


def stored_posts(posts: DataFrame, out: str) -> DataFrame:
    """The posts that ``posts_for_ever`` has kept under ``out``, with the columns of ``posts``."""
    return _stored(posts.sparkSession, out, T_.StructType([*posts.schema.fields, T_.StructField("bucket", T_.IntegerType())])).select(*posts.columns)


def recounted_slices(kept: DataFrame, late_rows: DataFrame, at: str, seconds: int, anchor: str) -> DataFrame:
    """(slice_start, n): the slices that late rows fall in, counted again over all rows kept."""
    touched = touched_slices(late_rows, at, seconds, anchor)
    return kept.withColumn("slice_start", _slice_of(at, seconds, anchor)).join(touched, "slice_start", "left_semi").groupBy("slice_start").agg(F.count("*").alias("n"))


def _slice_of(at: str, seconds: int, anchor: str):
    start = F.unix_seconds(F.lit(anchor).cast("timestamp"))
    return F.timestamp_seconds(start + F.floor((F.unix_seconds(at) - start) / seconds) * seconds)


def touched_slices(late_rows: DataFrame, at: str, seconds: int, anchor: str) -> DataFrame:
    """Distinct slice starts that late rows fall in; the grid never moves."""
    return late_rows.select(_slice_of(at, seconds, anchor).alias("slice_start")).distinct()


CURRENT = "scope string, version long, slot string, id string, at timestamp, none boolean"


def stream_current_answer(log: DataFrame, scope: str, slot: str, at: str, id_col: str, none: str) -> DataFrame:
    """Current answers of a scope after each batch that touches it, as rows of one ``version``; the highest version holds.

    State per scope is the last answer of each slot and the last 'nothing there': an answer is current if no
    later 'nothing there' closed it, and the reverse. Only latest ones count, so the order of arrival does not matter.
    """

    def step(key, frames, state):
        version, held = state.get if state.exists else (0, "{}")
        last = json.loads(held)
        for pdf in frames:
            for s, when, i, n in zip(pdf["slot"], pdf["at"], pdf["id"], pdf["none"], strict=True):
                place = "none" if n else f"slot {s}"
                seen = [int(when.value), str(i), None if n else s]
                if place not in last or (seen[0], len(seen[1]), seen[1]) > (last[place][0], len(last[place][1]), last[place][1]):
                    last[place] = seen
        state.update((version + 1, json.dumps(last)))
        order = lambda v: (v[0], len(v[1]), v[1])
        closed = last.get("none")
        real = [v for p, v in last.items() if p != "none" and (closed is None or order(v) > order(closed))]
        rows = real or ([closed] if closed else [])
        yield pd.DataFrame({"scope": key[0], "version": version + 1, "slot": [v[2] for v in rows], "id": [v[1] for v in rows], "at": [pd.Timestamp(v[0]) for v in rows], "none": not real})

    rows = log.select(F.col(scope).cast("string").alias("scope"), F.col(slot).cast("string").alias("slot"), F.col(at).alias("at"), F.col(id_col).cast("string").alias("id"), F.col(none).alias("none"))
    return rows.groupBy("scope").applyInPandasWithState(step, CURRENT, "version long, held string", "append", "NoTimeout")


def settle_stream(stream: DataFrame) -> DataFrame:
    """What a stream appends until its source is used up, written to the shared folder and read as a table.

    The query keeps its offsets and state there too, so a restart goes on where it was.
    """
    out, marks = shared_path(stream.sparkSession, "stream"), shared_path(stream.sparkSession, "offsets")
    query = stream.writeStream.format("parquet").option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
