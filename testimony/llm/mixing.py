"""Mixing sources to target weights.

Every row gets a hash-random key. The keys' value range is cut into equal ranges, rows are sorted
within (source, range), and a row's start in its source is the sum of the ranges before plus the
running sum in its own: a prefix sum that no single task computes. Each source is cut at its exact
budget; budgets beyond the source's size repeat it in whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.llm.common import WORD, broadcast_if_small, settle

#: Rows that one range of one source holds on average.
ROWS_PER_RANGE = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sums_before(rows: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over the rows before in the order.

    Rows are dealt by ranges of the order and summed there; only the ranges, as many as shuffle partitions, pass through one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(rows.withColumns({f"_one_{k}": v for k, v in sums.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    upto = Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(F.col("_range").alias("_r")).agg(F.min(F.struct(*order)).alias("_least"), *[F.sum(f"_one_{k}").alias(f"_all_{k}") for k in sums])
    starts = whole.select("_r", *[F.coalesce(F.sum(f"_all_{k}").over(upto), F.lit(0)).alias(f"_start_{k}") for k in sums])
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(broadcast_if_small(starts), F.col("_range") == F.col("_r"))
    return joined.select(*rows.columns, *[(F.coalesce(F.sum(f"_one_{k}").over(inner), F.lit(0)) + F.col(f"_start_{k}")).alias(k) for k in sums])


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) for sources (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn. ``share`` times the total is
    split by weight; a target stops at ``epochs`` times its source, and what it leaves goes to the
    others by weight until none is above. Filling in order of size per weight gives that in one
    pass: the sources whose limit lies under the level of those after them are exactly the full ones.
    Sources may be many; their order and sums are taken by ranges.
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("_last"))
    turned = sums_before(named, ["_last", "source"], {"_k": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    s = turned.select("source", "source_size", "_last", weight.alias("w"), (F.col("source_size") / weight).alias("_each"))
    order = ["_each", "_last", "source"]
    s = settle(sums_before(s, order, {"_full": F.col("source_size"), "_used": F.col("w")}))
    every = s.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    level = (F.lit(share) * F.lit(every["size"]) - epochs * F.col("_full")) / (F.lit(every.w) - F.col("_used"))
    first = s.where(epochs * F.col("source_size") > level * F.col("w")).agg(F.min(F.struct(*order, level.alias("level"))).alias("x")).first().x
    limit = epochs * F.col("source_size")
    share_of = F.least(limit, F.lit(float(first.level)) * F.col("w")) if first else limit
    return s.select("source", "source_size", share_of.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 11,
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, copies, text_key.

    ``taken`` is the words that the mix takes from the document, repeats counted: whole epochs, and
    from the last one the words before the source's budget (its target rounded), so the document on
    the cut gives a part. ``copies`` is the mix in whole documents: a document on the cut goes in
    when more than half of it does. The key hashes id, source and text, so reruns agree whatever
    the partitions.

    Null text has no words; a source without words has target 0 and nothing is taken; null is a
    source of its own. Rows of size 0 are returned with taken 0. Repeated rows count each time, and
    equal keys fall in order of id. Very long texts count whole. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
        )
    )
    # Ranges of a power of two, so that a key's range is its top bits.
    bits = max(4, (rows.count() // ROWS_PER_RANGE).bit_length() + 1)
    rows = rows.withColumn("range", F.shiftright("key", 64 - bits).cast("int"))
    sums = settle(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    sources = settle(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "range", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"))
    plan = starts.alias("a").join(sources.alias("b"), F.expr("a.source <=> b.source")).select(
        F.col("a.source").alias("_source"), F.col("range").alias("_range"), "start", "source_size", "target"
    )
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_upto", F.sum("size").over(inner))
    placed = placed.join(broadcast_if_small(plan), F.expr("source <=> _source and range = _range"), "left")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    at = F.col("start") + F.col("_upto") - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - at))
    return placed.select(
        "doc_id",
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        (whole + F.when(part * 2 > F.col("size"), 1).otherwise(0)).cast("int").alias("copies"),
        "text_key",
    )
