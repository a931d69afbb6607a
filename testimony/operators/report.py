"""Review queues, samples and accounts as tables: each a join or a window, none an N+1 read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.beats import numbered
from testimony.operators.durable import broadcast_if_small


def claim_detail(claims: DataFrame, sides: dict[str, DataFrame], key: str = "claim_id") -> DataFrame:
    """Claims with one sorted array per side; each side is aggregated before its join, so nothing fans out.

    sides: name -> DataFrame(key, item).
    """
    out = claims
    for name, rows in sides.items():
        one = rows.groupBy(key).agg(F.array_sort(F.collect_set("item")).alias(name))
        out = out.join(one, key, "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return out


def flag_rate(rows: DataFrame, by: list[str], support: str = "support") -> DataFrame:
    """Share of flagged verdicts in percent, one decimal; unverified rows are not judged."""
    flagged, judged = F.col(support).isin("overstated", "unsupported"), F.col(support) != "unverified"
    return rows.groupBy(*by).agg(F.sum(judged.cast("long")).alias("judged"), F.sum(flagged.cast("long")).alias("flagged")).withColumn("flag_rate", F.round(F.col("flagged") * 100 / F.nullif("judged", F.lit(0)), 1))


def support_tally(rows: DataFrame, by: list[str], support: str = "support") -> DataFrame:
    verdicts = ["unverified", "supported", "overstated", "unsupported"]
    return rows.groupBy(*by).pivot(support, verdicts).count().fillna(0, verdicts)


def _per_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``groups`` (one row for each ``by``) added; nulls are a group."""
    renamed = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return rows.join(broadcast_if_small(renamed), [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]).drop(*[f"_by_{c}" for c in by])


def _positions(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their position from 0 within ``by``, numbered by ranges of the order, so that no key passes through one task."""
    placed = numbered(rows, [*by, *order], name)
    return _per_group(placed, placed.groupBy(*by).agg(F.min(name).alias("_first")), by).withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def bounded_sample(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group, with ``rest``: how many more there are.

    Only the first k rows of a group in each task are sent on; groups are counted apart.
    """
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
    counts = rows.groupBy(*by).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("rest"))
    return _per_group(first, counts, by)


def stratified_sample(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def systematic_sample(posts: DataFrame, by: str, text_col: str, order: list[str], every: int) -> DataFrame:
    """One in ``every`` by order, exact duplicates removed first."""
    first = Window.partitionBy(by, text_col).orderBy(*order)
    once = posts.withColumn("_d", F.row_number().over(first)).where("_d = 1").drop("_d")
    return _positions(once, [by], order, "_k").where(F.col("_k") % every == 0).drop("_k")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with ``batch``: fixed counts in order within each key."""
    return _positions(rows, by, order, "_k").withColumn("batch", F.floor(F.col("_k") / size).cast("long")).drop("_k")


def handle_collisions(persons: DataFrame, name_col: str) -> DataFrame:
    handle = T.derive_handle(F.col(name_col))["handle"]
    return persons.select(handle.alias("handle")).where("handle is not null").groupBy("handle").agg(F.count("*").alias("n")).where("n > 1")


def refusal_groups(persons: DataFrame, name_col: str) -> DataFrame:
    reason = T.derive_handle(F.col(name_col))["reason"]
    return persons.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def low_confidence_summary(links: DataFrame, by: str, confidence: str, bar: float = 0.7, k: int = 3) -> DataFrame:
    """Weak links per kind: how many, and the k weakest."""
    low = links.where(F.col(confidence) < bar)
    first = low.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(confidence, "id"))).where(F.col("_k") <= k)
    weakest = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(confidence, "id"))).alias("weakest"))
    return _per_group(low.groupBy(by).agg(F.count("*").alias("n")), weakest, [by])


def ambiguous_by_form(links: DataFrame, form: str, claim: str) -> DataFrame:
    return links.groupBy(form).agg(F.count_distinct(claim).alias("claims")).where("claims > 1")


def accepted_verdicts(flagged: DataFrame, accepted: DataFrame) -> DataFrame:
    """Flagged claims whose exact verdict nobody accepted; a changed verdict comes back."""
    return flagged.join(accepted.select("claim_id", "support").distinct(), ["claim_id", "support"], "left_anti")


def numbered_questions(queues: list[DataFrame], order: list[Column | str]) -> DataFrame:
    """Queues in their given order as one table (event_id, kind, subject_id, detail, number), numbered within each event."""
    out = None
    for i, q in enumerate(queues):
        part = q.select("event_id", "kind", "subject_id", "detail", F.lit(i).alias("_q"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("event_id").orderBy("_q", *order)
    return out.withColumn("number", F.row_number().over(w)).drop("_q")


def rivals(forms: DataFrame, names: DataFrame, closure: DataFrame, prefix: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """(by, form, linked_id, rival_id): other places of the same name; without one, places whose name begins with the form
    and that are not beneath the linked place. Prefix candidates meet on their first characters. ``by``: columns
    that forms and names share, such as the event.
    """
    out = [*by, "form", "linked_id", "rival_id"]
    same = forms.join(names.select(*by, F.col("name").alias("form"), F.col("place_id").alias("rival_id")), [*by, "form"]).where("rival_id <> linked_id")
    rest = forms.join(same.select(*by, "form", "linked_id").distinct(), [*by, "form", "linked_id"], "left_anti")
    # Forms shorter than the prefix are few and meet on what they have.
    beneath = closure.select(F.col("ancestor").alias("linked_id"), F.col("descendant").alias("rival_id"))
    found = same.select(*out)
    for n in range(1, prefix + 1):
        mine = rest.where(F.length("form") >= n if n == prefix else F.length("form") == n)
        cut = lambda c, n=n: F.left(F.col(c), F.lit(n))
        longer = mine.withColumn("_p", cut("form")).join(names.select(*by, F.col("place_id").alias("rival_id"), "name").withColumn("_p", cut("name")), [*by, "_p"])
        longer = longer.where(F.expr("startswith(name, form)") & (F.col("name") != F.col("form")) & (F.col("rival_id") != F.col("linked_id")))
        found = found.unionByName(longer.join(beneath, ["linked_id", "rival_id"], "left_anti").select(*out))
    return found.distinct()


def act_trail(acts: DataFrame, actors: DataFrame, targets: DataFrame) -> DataFrame:
    """Acts newest first with actor and target names, and the fields that moved: before -> after."""
    moved = F.filter(F.transform(F.map_entries("after"), lambda e: F.struct(e.key.alias("field"), F.col("before")[e.key].alias("old"), e.value.alias("new"))), lambda m: ~m.old.eqNullSafe(m.new))
    return acts.join(actors, "actor_id", "left").join(targets, "target_id", "left").withColumn("moved", moved).orderBy(F.desc("acted_at"), F.desc("act_id"))
