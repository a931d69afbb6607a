"""How well a vocabulary fits its corpus, and how dense and rich the record is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Count and share of each key among all rows, or among its ``within`` group; counted before any window."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(within or []))))


def theme_load(posts: DataFrame, theme: str, times: float = 3.0) -> DataFrame:
    """Share per theme; overloaded when its count is over ``times`` the median theme's."""
    s = shares(posts, [theme])
    return s.withColumn("overloaded", F.col("n") > times * F.percentile("n", F.lit(0.5)).over(Window.partitionBy()))


def residue_rate(posts: DataFrame, at: str, fits: Column, width: str = "1 day", trail: int = 7) -> DataFrame:
    """Share of posts per window that fit no theme; rising when over twice the trailing median."""
    w = Window.orderBy("start").rowsBetween(-trail, -1)
    rate = posts.groupBy(F.window(at, width).start.alias("start")).agg(F.count("*").alias("posts"), F.sum((~fits).cast("long")).alias("residue"))
    rate = rate.withColumn("rate", F.col("residue") / F.col("posts"))
    return rate.withColumn("rising", F.coalesce(F.col("rate") > 2 * F.percentile("rate", F.lit(0.5)).over(w), F.lit(False)))


def refusal_rate(claims: DataFrame, theme: str, support: str) -> DataFrame:
    return claims.groupBy(theme).agg(F.avg(F.col(support).isin("overstated", "unsupported").cast("double")).alias("refused"))


def theme_confusion(pairs: DataFrame, post: str, theme: str) -> DataFrame:
    """(a, b, both, jaccard): posts that carry both themes, against those that carry either.

    A post's themes, of which there are few, are one list, so its pairs are made in place and summed before they are sent.
    """
    once = pairs.select(post, theme).distinct()
    n = once.groupBy(theme).agg(F.count("*").alias("n"))
    sets = once.where(F.col(post).isNotNull() & F.col(theme).isNotNull()).groupBy(post).agg(F.array_sort(F.collect_list(theme)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both"))
    sized = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return sized.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def sibling_imbalance(children: DataFrame, parent: str, child: str) -> DataFrame:
    """Each child's share under its parent; parents with a single child are marked."""
    s = shares(children, [parent, child], [parent])
    return s.withColumn("single_child", F.count("*").over(Window.partitionBy(parent)) == 1)


def theme_drift(posts: DataFrame, theme: str, at: str) -> DataFrame:
    """Share per theme and week, with the share of its week before; arrived without one."""
    week = posts.withColumn("week", F.date_trunc("week", at))
    s = shares(week, ["week", theme], ["week"])
    w = Window.partitionBy(theme).orderBy("week")
    return s.withColumns({"before": F.lag("share").over(w), "arrived": F.lag("share").over(w).isNull()})


def density(rows: DataFrame, at: str, width: str = "1 hour") -> DataFrame:
    return rows.groupBy(F.window(at, width).start.alias("start")).agg(F.count("*").alias("n"))


def richness(appearances: DataFrame, item: str, occasion: Column) -> DataFrame:
    """One row: distinct items, Good-Turing unseen mass (singletons / sightings), and the Chapman
    capture-recapture estimate from two occasions (``occasion`` true or false).
    """
    seen = appearances.groupBy(item).agg(F.count("*").alias("n"), F.max(occasion.cast("int")).alias("first"), F.max((~occasion).cast("int")).alias("second"))
    t = seen.agg(
        F.count("*").alias("distinct_items"), F.sum("n").alias("sightings"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"),
        F.sum("first").alias("n1"), F.sum("second").alias("n2"), F.sum(F.col("first") * F.col("second")).alias("both"),
    )
    return t.select("distinct_items", "sightings", "singletons", (F.col("singletons") / F.col("sightings")).alias("unseen_mass"), ((F.col("n1") + 1) * (F.col("n2") + 1) / (F.col("both") + 1) - 1).alias("estimated_items"))


def saturation(appearances: DataFrame, item: str, at: str, width: str = "1 day") -> DataFrame:
    """Cumulative distinct items per bucket: each item counts where it first appears."""
    first = appearances.groupBy(item).agg(F.min(at).alias("at")).groupBy(F.window("at", width).start.alias("start")).agg(F.count("*").alias("new"))
    return first.withColumn("cumulative", F.sum("new").over(Window.orderBy("start")))


def reader_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, pairs on which both readers agree, the rate, and the rate beyond chance.

    From the contingency table: pairs together are sums of n(n-1)/2 over cells, rows and columns, so no pair is made.
    """
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two("n")).alias("both"), F.sum("n").alias("m"))
    one = lambda c, out: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias(out))
    t = both.join(one(a, "ta")).join(one(b, "tb")).withColumn("pairs", two("m"))
    t = t.withColumn("agree", F.col("pairs") + 2 * F.col("both") - F.col("ta") - F.col("tb"))
    p, q = F.col("ta") / F.col("pairs"), F.col("tb") / F.col("pairs")
    chance = p * q + (1 - p) * (1 - q)
    return t.select("pairs", "agree", (F.col("agree") / F.col("pairs")).alias("rate"), ((F.col("agree") / F.col("pairs") - chance) / (1 - chance)).alias("beyond_chance"))
