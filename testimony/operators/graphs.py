"""Connected groups and neighbourhood blocks of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.operators.durable import settle


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph given as links; component is the least node reachable.

    A node's links to lesser nodes first become one link to the least, and links from there to the others: many of those are
    the same, so a dense group shrinks to about its size. Then every node takes the least label around it and that
    label's label, round by round, so path lengths halve; labels and links stay distributed, and each round is settled. Nodes that are linked
    with none but themselves are not returned.
    """
    down = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    star = down.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    both = star.select("u", F.col("m").alias("v")).union(star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    both = settle(both.union(both.select("v", "u")).distinct())
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("low"))
        new = labels.join(near, "node").select("node", "component", F.least("component", "low").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("beyond"))
        stepped = settle(new.join(jump, "at").select("node", "component", F.least("at", "beyond").alias("new")))
        if stepped.where("new <> component").isEmpty():
            return labels
        labels = stepped.select("node", F.col("new").alias("component"))


def pair_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(component, size, n_pairs, members), largest first."""
    groups = connected(pairs, a, b)
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    links = pairs.join(groups, F.col(a) == F.col("node")).groupBy("component").agg(F.count("*").alias("n_pairs"))
    return sizes.join(links, "component").orderBy(F.desc("size"), F.desc("n_pairs"), "component")


def standalone_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs whose group is those two alone; only they can be judged by themselves."""
    groups = connected(pairs, a, b)
    alone = groups.groupBy("component").agg(F.count("*").alias("n")).where("n = 2")
    return pairs.join(groups, F.col(a) == F.col("node")).join(alone, "component", "left_semi").select(*pairs.columns)


def neighbourhoods(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(block, members): each node with its direct neighbours, equal sets once, sets inside a larger one dropped.

    A set can only be inside sets that hold its rarest member, so each set asks those alone: a node that all share is nobody's rarest, and sets that meet in it
    only are never compared. What is asked is settled by counting shared members, which come one row each.
    """
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.union(both.select("v", "u"))
    sets = both.groupBy("u").agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("v"), F.array(F.first("u"))))).alias("members"))
    sets = settle(sets.groupBy("members").agg(F.min("u").alias("block")).withColumn("n", F.size("members")))
    member = settle(sets.select("block", "n", F.explode("members").alias("m")))
    often = member.groupBy("m").agg(F.count("*").alias("often")).where("often > 1")
    known = member.join(often, "m", "left").groupBy("block", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "m")).alias("r"))
    # A member that no other set has keeps its set out of all others.
    asks = known.where("r.often > 1").select("block", "n", F.col("r.m").alias("m"))
    other = member.toDF("_block", "_n", "m")
    asked = asks.join(other, "m").where("n < _n").select("block", "n", "_block")
    met = asked.join(member.select("block", "m"), "block").join(other.select("_block", "m"), ["_block", "m"])
    inside = met.groupBy("block", "n", "_block").agg(F.count("*").alias("k")).where("k = n").select("block").distinct()
    return sets.join(inside, "block", "left_anti").select("block", "members")
