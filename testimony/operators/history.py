"""Append-only histories: first and last row per key, supersession, exclusive answers, sets, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: an upsert that changes nothing that is there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def current_rows(rows: DataFrame) -> DataFrame:
    return rows.where("superseded_at is null")


def supersession(log: DataFrame, slot: list[str], at: str, id_col: str) -> DataFrame:
    """The log with superseded_at and superseded_by_id: the next answer of the same slot."""
    w = Window.partitionBy(*slot).orderBy(at, id_col)
    return log.withColumns({"superseded_at": F.lead(at).over(w), "superseded_by_id": F.lead(id_col).over(w)})


def exclusive_answers(log: DataFrame, scope: list[str], slot: list[str], none: Column, at: str, id_col: str) -> DataFrame:
    """Answers and 'nothing there' answers of a scope close each other.

    A row closes at the earlier of the next of its own slot (which succeeds it) and the next of the other
    kind in its scope (which does not). ``none`` marks the 'nothing there' rows; they share one slot.
    """
    rows = log.withColumn("_none", none)
    own = Window.partitionBy(*scope, "_none", *[F.when(~F.col("_none"), F.col(c)) for c in slot]).orderBy(at, id_col)
    # Read from the end, what comes after a row is what stands before it, so one running value serves every row.
    after = Window.partitionBy(*scope).orderBy(F.desc_nulls_last(at), F.desc_nulls_last(id_col)).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(F.col(at).alias("at"), F.col(id_col).alias("id"))
    # The next row of the other kind: the first after this one whose kind differs.
    rows = rows.withColumns(
        {
            "_own": F.lead(key).over(own),
            "_other_none": F.last(F.when(F.col("_none"), key), ignorenulls=True).over(after),
            "_other_real": F.last(F.when(~F.col("_none"), key), ignorenulls=True).over(after),
        }
    )
    rows = rows.withColumn("_other", F.when(F.col("_none"), F.col("_other_real")).otherwise(F.col("_other_none")))
    by_own = F.col("_own").isNotNull() & (F.col("_other").isNull() | (F.col("_own") < F.col("_other")))
    out = rows.withColumns({"superseded_at": F.least("_own", "_other")["at"], "superseded_by_id": F.when(by_own, F.col("_own.id"))})
    return out.drop("_none", "_own", "_other", "_other_none", "_other_real")


def set_replacement(sets: DataFrame, scope: list[str], target: str, at: str, set_id: str) -> DataFrame:
    """Rows (scope, set, target): each set replaces the one before it in its scope.

    A target in the next set too is superseded by that set's row; one that is not is closed without a
    successor. A target listed twice in one set is judged once.
    """
    once = sets.dropDuplicates([*scope, set_id, target])
    order = once.select(*scope, set_id, at).distinct()
    w = Window.partitionBy(*scope).orderBy(at, set_id)
    following = order.select(*scope, set_id, F.lead(set_id).over(w).alias("_next"), F.lead(at).over(w).alias("superseded_at"))
    rows = once.join(following, [*scope, set_id])
    again = once.select(*scope, F.col(set_id).alias("_next"), target, F.col(set_id).alias("superseded_by_set"))
    return rows.join(again, [*scope, "_next", target], "left").drop("_next")


def state_as_of(rows: DataFrame, at: str, moment) -> DataFrame:
    """What was current at a moment."""
    t = F.lit(moment).cast("timestamp")
    return rows.where((F.col(at) <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t)))


def status_chain(rows: DataFrame, id_col: str, next_col: str, at: str) -> DataFrame:
    """Rows with the root of their chain of successors and their step in it."""
    from testimony.operators.graphs import connected

    links = rows.where(F.col(next_col).isNotNull()).select(F.col(id_col).alias("a"), F.col(next_col).alias("b"))
    groups = connected(links)
    known = rows.join(groups, F.col(id_col) == F.col("node"), "left").withColumn("_c", F.coalesce("component", id_col))
    w = Window.partitionBy("_c").orderBy(at, id_col)
    return known.withColumns({"root_id": F.first(id_col).over(w), "step": F.row_number().over(w)}).drop("_c", "node", "component")
