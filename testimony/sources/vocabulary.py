"""Loading vocabularies into an event: trees of places and of themes, with what is there reused and names topped up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.durable import broadcast_if_small, settle

# What a place's name may be, and how it is asked for; other words count as the last named.
NAME_KINDS = "official colloquial alias acronym abbreviation spelling_variant historical error".split()
EMISSIONS = "raw anchored recognition_only".split()

NODES = "old_id string, parent_old_id string, canonical string, type string, names array<struct<name:string,kind:string,emission:string>>"
THEMES = "name string, parent string, nature string, definition string, applies_when string, not_to_be_confused_with string"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Places of a JSON file, {"nodes": [...]}."""
    return spark.read.schema(f"nodes array<struct<{_fields(NODES)}>>").option("multiLine", True).json(path).select(F.explode("nodes").alias("n")).select("n.*")


def read_themes(spark: SparkSession, path: str) -> DataFrame:
    """Themes of a JSON file, {"themes": [...]}."""
    return spark.read.schema(f"themes array<struct<{_fields(THEMES)}>>").option("multiLine", True).json(path).select(F.explode("themes").alias("t")).select("t.*")


def _fields(ddl: str) -> str:
    return ",".join(":".join(x.strip().split(" ", 1)) for x in _split(ddl))


def _split(ddl: str) -> list[str]:
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def load_gazetteer(nodes: DataFrame, event_id, places: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new places, new names, counts) of a node list (NODES) for an event.

    places: id, event_id, parent_id, canonical_name, type (any id type, given back as strings). names: place_id, name, kind, emission.
    Parents go first, level by level. A node is the place of the event with its folded name, type and parent, if there is one, or one that an
    equal node before it made; else it is made, active. A node whose parent is not in the list is a root. Names that the place does not
    hold in the same kind and emission are added, once each; of spellings that fold alike the least is taken.
    counts: created, reused, names. Nodes below a cycle of parents are no part of any tree and are left out.
    """
    n = settle(nodes.select(*[F.col(c.strip().split(" ")[0]) for c in _split(NODES)], T.fold(F.col("canonical")).alias("f")))
    held = settle(
        places.where(F.col("event_id") == F.lit(event_id))
        .select(F.col("id").cast("string").alias("_held"), T.fold(F.col("canonical_name")).alias("_f"), F.col("type").alias("_t"), F.col("parent_id").cast("string").alias("_p"))
        .groupBy("_f", "_t", "_p").agg(F.min("_held").alias("_held"))
    )
    known = n.select(F.col("old_id").alias("_k")).distinct()
    roots = n.join(known, F.col("parent_old_id") == F.col("_k"), "left").where("_k is null").drop("_k").withColumn("parent_id", F.lit(None).cast("string"))
    level, done = roots, None
    while True:
        met = level.join(broadcast_if_small(held), F.col("f").eqNullSafe(F.col("_f")) & F.col("type").eqNullSafe(F.col("_t")) & F.col("parent_id").eqNullSafe(F.col("_p")), "left")
        minted = F.sha2(F.concat_ws("\u0001", F.lit(str(event_id)), F.coalesce("parent_id", F.lit("")), F.coalesce("f", F.lit("")), F.coalesce("type", F.lit(""))), 256)
        met = settle(met.select(*n.columns, "parent_id", F.coalesce("_held", minted).alias("place_id"), F.col("_held").isNull().alias("made")))
        if met.isEmpty():
            break
        done = met if done is None else done.unionByName(met)
        level = n.join(met.select(F.col("old_id").alias("parent_old_id"), F.col("place_id").alias("parent_id")), "parent_old_id").select(*n.columns, "parent_id")
    done = met if done is None else done
    new = done.where("made").groupBy(F.col("place_id").alias("id"), "parent_id", "type").agg(F.min_by("canonical", F.struct("canonical", "old_id")).alias("canonical_name"))
    new = settle(new.select("id", F.lit(event_id).alias("event_id"), "parent_id", "canonical_name", "type", F.lit("active").alias("lifecycle")))
    said = done.select("place_id", F.explode("names").alias("x")).select("place_id", F.col("x.name").alias("name"), _one_of("x.kind", NAME_KINDS, "alias"), _one_of("x.emission", EMISSIONS, "recognition_only"))
    there = names.select(F.col("place_id").cast("string").alias("place_id"), T.fold(F.col("name")).alias("_f"), "kind", "emission").distinct()
    fresh = said.where("name is not null").withColumn("_f", T.fold(F.col("name"))).groupBy("place_id", "_f", "kind", "emission").agg(F.min("name").alias("name"))
    fresh = settle(fresh.join(there, ["place_id", "_f", "kind", "emission"], "left_anti").select("place_id", "name", "kind", "emission"))
    total = done.agg(F.count("*").alias("n")).crossJoin(new.agg(F.count("*").alias("created"))).crossJoin(fresh.agg(F.count("*").alias("names")))
    return new, fresh, total.select("created", (F.col("n") - F.col("created")).alias("reused"), "names")


def _one_of(c: str, allowed: list[str], other: str):
    return F.when(F.col(c).isin(allowed), F.col(c)).otherwise(other).alias(c.rsplit(".", 1)[-1])


def load_taxonomy(themes: DataFrame, event_id, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new themes, counts) of a theme list (THEMES) for an event. known: id, event_id, name.

    A name that the event has is left as it is; of repeats in the list one is made (the least by its rule). A theme's parent is the event's theme of that
    name, held or made. The rule text carries what the theme is not to be confused with. counts: created, reused.
    """
    t = themes.select([F.col(c.strip().split(" ")[0]) for c in _split(THEMES)])
    held = known.where(F.col("event_id") == F.lit(event_id)).select("name", F.col("id").cast("string").alias("_held"))
    rule = F.concat(F.coalesce("applies_when", F.lit("")), F.coalesce(F.concat(F.lit(" Not to be confused with: "), F.col("not_to_be_confused_with")), F.lit("")))
    minted = lambda c: F.sha2(F.concat_ws("\u0001", F.lit(str(event_id)), c), 256)
    each = t.withColumn("applies_when", rule).groupBy("name").agg(F.min(F.struct("applies_when", "parent", "nature", "definition")).alias("x"), F.count("*").alias("n"))
    named = settle(each.join(held, "name", "left").select("name", "x.*", "n", "_held"))
    of = named.select(F.col("name").alias("parent"), F.coalesce("_held", minted(F.col("name"))).alias("parent_id")).unionByName(held.select(F.col("name").alias("parent"), F.col("_held").alias("parent_id"))).distinct()
    new = named.where("_held is null").join(broadcast_if_small(of), "parent", "left")
    new = settle(new.select(minted(F.col("name")).alias("id"), F.lit(event_id).alias("event_id"), "name", "parent_id", "nature", "definition", "applies_when"))
    counts = named.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("_held").isNull()).alias("created"))
    return new, counts.select("created", (F.col("n") - F.col("created")).alias("reused"))
