"""A training corpus in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.llm import decontamination, minhash, mixing, quality, sharding
from testimony.llm.common import broadcast_if_small, fresh, settle, table
from testimony.operators.beats import numbered


def _prefix(docs: DataFrame, prefix: str) -> str:
    """``prefix`` with underscores in front until no column of ``docs`` starts with it."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: whole rows, in as many copies as they come.

    Null, empty and very long texts are scored like others, and so are rows of a null id. Equal texts have equal scores. No documents: none.
    Columns keep their values, whatever their names.
    """
    p = _prefix(docs, "_q_")
    judged = quality.score_quality(docs, table(spark, sf_dir, "labels"), prefix=p)
    return judged.where(F.col(f"{p}predicted") == 1).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the first by (id, text): five-word shingles, similarity 0.8 or more.

    Rows without words, null or empty, link with nothing and all stay. Repeated rows are copies, so one stays. Null ids come last.
    Very long texts are compared whole. No documents: none. Columns keep their values, whatever their names.
    """
    return minhash.keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs: whole rows, in as many copies as they come.

    Null and empty texts are clean; very long ones are scanned whole. No documents: none. Columns keep their values, whatever their names.
    """
    p = _prefix(docs, "_d_")
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix=p)
    return judged.where(~F.col(f"{p}contaminated")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by source weight, in as many copies as the mix takes.

    Null is a source of its own. Documents without words, and those of which less than half is taken, come in no copy. Repeated rows count
    each: copies go to them in equal parts, and one more to each of the first of them in the order of the MD5 of their JSON until none is left. Very long texts count
    whole. No documents: none. Columns keep their values, whatever their names.
    """
    names = ("id", "source", "key", "copies", "rows", "own", "each", "copy", "digest", "group", "number", "start", "least")
    id_, source, key, copies, rows, own, each, copy, digest, group, number, start, least = fresh(docs, *(f"_m_{n}" for n in names))
    plan = mixing.mix_sources(docs).select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("text_key").alias(key), F.col("copies").alias(copies))
    # Repeated rows have plans of their own; they are paired off with the rows by their number in the table.
    plan = settle(plan.groupBy(id_, source, key).agg(F.sum(copies).alias(copies), F.count("*").alias(rows)))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(key))
    taken = keyed.join(broadcast_if_small(plan.where(F.col(copies) > 0)), same)
    # What goes beyond equal parts: rows of one id, source and text are numbered by ranges of an order, however many they are.
    left = F.col(copies) % F.col(rows)
    even = taken.withColumn(each, F.floor(F.col(copies) / F.col(rows)).cast("int"))
    more = taken.where((F.col(rows) > 1) & (left > 0)).withColumn(digest, F.md5(F.to_json(F.struct(*[docs[c] for c in docs.columns])).cast("binary")))
    more = settle(numbered(more.withColumn(group, F.struct(id_, source, own)), [group, digest], number))
    starts = more.groupBy(F.col(group).alias(start)).agg(F.min(number).alias(least))
    more = more.join(broadcast_if_small(starts), F.col(group).eqNullSafe(F.col(start))).where(F.col(number) - F.col(least) < left).withColumn(each, F.lit(1))
    repeated = even.where(F.col(each) > 0).select(*docs.columns, each).unionByName(more.select(*docs.columns, each))
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document of the mix.

    Null texts are one group, empty ones another; repeated rows each take a slot. Very long texts only count by their size. No documents:
    none. Other columns are ignored, whatever their names.
    """
    return sharding.shard(docs).drop("text_key")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier is not SQL; tests compare each stage with brute force on its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
