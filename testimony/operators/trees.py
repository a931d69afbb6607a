"""Forests by parent id, and redirect chains, by doubling: each round reaches twice as far.

The number of jobs is the logarithm of the depth, not the depth nor the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.operators.durable import settle

#: Rows of a closure that one task of a join holds, about, which bounds its memory.
_ROWS_A_TASK = 1 << 20


def tree_closure(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(ancestor, descendant, depth), each node with itself at depth 0, to any depth.

    Parents that are not nodes are ignored. Parents that form a cycle raise: some node would be above itself. A round is a write and a count
    of what it wrote.
    """
    own = nodes.select(F.col(id_col).alias("n"), F.col(parent_col).alias("p"))
    up = own.where("p is not null").join(own.select(F.col("n").alias("p")), "p", "left_semi")
    # ``more`` tells that there is something above the ancestor.
    top = up.select(F.col("n").alias("p"), F.lit(True).alias("more")).distinct()
    every = settle(up.join(top, "p", "left").select(F.col("p").alias("ancestor"), F.col("n").alias("descendant"), F.lit(1).alias("depth"), F.coalesce("more", F.lit(False)).alias("more")))
    part, reach = every, 1
    while True:
        loops, open_ = part.agg(F.count_if(F.col("ancestor") == F.col("descendant")), F.count_if((F.col("depth") == reach) & F.col("more"))).first()
        if loops:
            raise ValueError("parents form a cycle")
        if not open_:
            break
        # Ancestors ``reach`` up, and those up to as far above them.
        last = part.where((F.col("depth") == reach) & F.col("more")).select(F.col("ancestor").alias("_mid"), "descendant")
        above = every.select("ancestor", F.col("descendant").alias("_mid"), (F.col("depth") + reach).alias("depth"), "more")
        part = settle(last.join(above, "_mid").select("ancestor", "descendant", "depth", "more"))
        every = every.unionByName(part)
        reach *= 2
    self_ = own.select(F.col("n").alias("ancestor"), F.col("n").alias("descendant"), F.lit(0).alias("depth"))
    return self_.unionByName(every.drop("more"))


def ancestors(closure: DataFrame) -> DataFrame:
    """(id, ancestor_ids): nearest first, self left out; nodes without ancestors have no row."""
    return closure.where("depth > 0").groupBy(F.col("descendant").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x.ancestor).alias("ancestor_ids"))


def subtree(closure: DataFrame, root) -> DataFrame:
    return closure.where(F.col("ancestor") == F.lit(root)).select(F.col("descendant").alias("id"))


def order_by_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id", list_col: str = "ids") -> DataFrame:
    """``rows`` with their position in a given id list; ids without a row drop out."""
    at = ids.select(F.posexplode(list_col).alias("position", id_col))
    # Ids divide what has one position in many lists, which else is one task of the sort.
    return rows.join(at, id_col).orderBy("position", id_col)


def cycle_guard(moves: DataFrame, closure: DataFrame, id_col: str = "id", parent_col: str = "new_parent_id") -> DataFrame:
    """Proposed moves with ``refused``: the new parent is the node itself or beneath it."""
    tasks = max(1, closure.count() // _ROWS_A_TASK)
    bad = closure.select(F.col("ancestor").alias(id_col), F.col("descendant").alias(parent_col), F.lit(True).alias("_bad"))
    return moves.repartition(tasks, id_col, parent_col).join(bad.repartition(tasks, id_col, parent_col), [id_col, parent_col], "left").withColumn("refused", F.coalesce("_bad", F.lit(False))).drop("_bad")


def deepest(links: DataFrame, depths: DataFrame, by: str, place_col: str, order_col: str) -> DataFrame:
    """Per ``by``, the link to the deepest place (id, depth); the first by ``order_col`` on ties."""
    w = Window.partitionBy(by).orderBy(F.desc("depth"), order_col)
    return links.join(depths, F.col(place_col) == F.col("id")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "id")


def subtree_rollup(links: DataFrame, closure: DataFrame, item_col: str, place_col: str) -> DataFrame:
    """(place, n): distinct items at a place and everything under it."""
    pairs = links.join(closure, F.col(place_col) == F.col("descendant")).select("ancestor", item_col).distinct()
    return pairs.groupBy(F.col("ancestor").alias("place")).agg(F.count("*").alias("n"))


def follow_redirects(nodes: DataFrame, id_col: str = "id", next_col: str = "next_id") -> DataFrame:
    """(id, final, loops): the end of each redirect chain by pointer jumping; ids in a loop or leading to one are marked.

    After k rounds a pointer has gone 2^k steps. A chain's ids end in turn, so a round in which none ends leaves loops
    alone, and the rounds are the log of the longest chain. A target that is no id is an end. ``final`` of a looping id is
    an id of its loop.
    """
    hop = settle(nodes.select(F.col(id_col).alias("id"), F.coalesce(next_col, id_col).alias("at"), F.col(next_col).isNull().alias("done")))
    left = hop.where("not done").count()
    while left:
        over = hop.select(F.col("id").alias("at"), F.col("at").alias("beyond"), F.col("done").alias("_done"))
        step = [F.coalesce("beyond", "at").alias("at"), (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done")]
        hop = settle(hop.join(over, "at", "left").select("id", *step))
        before, left = left, hop.where("not done").count()
        if left == before:
            break
    return hop.select("id", F.col("at").alias("final"), (~F.col("done")).alias("loops"))
