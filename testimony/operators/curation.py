"""Checks, verdicts, merges and folds over whole tables: each returns rows, accepted or refused, never a rewrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.durable import broadcast_if_small, settle
from testimony.operators.history import upsert_last
from testimony.operators.names import unexplained_names


def _reasons(**rules) -> F.Column:
    """Array of the names of the rules that hold, in their order."""
    return F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda r: r.isNotNull())


def validate_claims(claims: DataFrame, themes: DataFrame, vocabulary: DataFrame, figures: Sequence[str] = (), id_col: str = "claim_id") -> DataFrame:
    """Claims with ``reasons``: why each is refused; empty for those that pass.

    claims: an id, event_id, theme_id (null for none), kind, subject, nuance, confidence, actor_kind. themes: id, event_id,
    nature, lifecycle. vocabulary: event_id, name (``names.gazetteer_names``). An agent states a confidence from 0 to 1, a person none.
    Subject and kind may name places of the event only, a nuance public figures (``figures``) too. Null texts name nobody.
    """
    of = lambda c: claims.select(F.struct(F.col(id_col).alias("id"), F.lit(c).alias("field")).alias("id"), "event_id", F.col(c).alias("text"))
    strict = unexplained_names(of("subject").unionByName(of("kind")), vocabulary)
    found = strict.unionByName(unexplained_names(of("nuance"), vocabulary, figures))
    flags = found.groupBy(F.col("id.id").alias("_id")).agg(F.collect_set("id.field").alias("_fields"))
    claims = claims.join(broadcast_if_small(settle(flags)), F.col(id_col) == F.col("_id"), "left").drop("_id")
    known = themes.select(F.col("id").alias("theme_id"), F.col("event_id").alias("_event"), F.col("nature").alias("_nature"), F.col("lifecycle").alias("_life"))
    rows = claims.join(broadcast_if_small(known), "theme_id", "left")
    given = F.col("theme_id").isNotNull()
    named = lambda c: F.array_contains("_fields", c)
    agent = F.col("actor_kind") == "agent"
    reasons = _reasons(
        theme_missing=given & F.col("_life").isNull(),
        theme_of_other_event=F.col("_event") != F.col("event_id"),
        theme_not_active=F.col("_life") != "active",
        theme_is_topic=F.col("_nature") == "topic",
        subject_names_person=named("subject"),
        kind_names_person=named("kind"),
        nuance_names_person=named("nuance"),
        confidence_missing=agent & F.col("confidence").isNull(),
        confidence_given=(F.col("actor_kind") == "person") & F.col("confidence").isNotNull(),
        confidence_out_of_range=(F.col("confidence") < 0) | (F.col("confidence") > 1),
    )
    return rows.withColumn("reasons", reasons).drop("_event", "_nature", "_life", "_fields")


def same_event_check(rows: DataFrame, references: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """(id, field, problem) of references that do not exist or belong to another event.

    rows: id, event_id and the fields. references: field -> DataFrame(id, event_id). Null fields refer to nothing.
    """
    out = None
    for field, target in references.items():
        named = rows.where(F.col(field).isNotNull()).select(F.col(id_col).alias("id"), "event_id", F.col(field).alias("_ref"))
        met = named.join(target.select(F.col("id").alias("_ref"), F.col("event_id").alias("_event"), F.lit(True).alias("_found")), "_ref", "left")
        problem = F.when(F.col("_found").isNull(), "does not exist").when(~F.col("_event").eqNullSafe(F.col("event_id")), "another event")
        part = met.select("id", F.lit(field).alias("field"), problem.alias("problem")).where("problem is not null")
        out = part if out is None else out.unionByName(part)
    return out


def reference_check(moves: DataFrame, places: DataFrame, closure: DataFrame) -> DataFrame:
    """Moves (id, event_id, new_parent_id) with ``reasons``: missing, of another event, not active, itself, beneath itself."""
    target = places.select(F.col("id").alias("new_parent_id"), F.col("event_id").alias("_event"), F.col("lifecycle").alias("_life"))
    below = closure.where("depth > 0").select(F.col("ancestor").alias("id"), F.col("descendant").alias("new_parent_id"), F.lit(True).alias("_below"))
    rows = moves.join(target, "new_parent_id", "left").join(below, ["id", "new_parent_id"], "left")
    reasons = _reasons(
        missing=F.col("_life").isNull(),
        other_event=F.col("_event") != F.col("event_id"),
        not_active=F.col("_life") != "active",
        itself=F.col("id") == F.col("new_parent_id"),
        beneath_itself=F.col("_below").isNotNull(),
    )
    return rows.withColumn("reasons", reasons).drop("_event", "_life", "_below")


# --- verdicts -------------------------------------------------------------------------------------


def pair_verdicts(offered: DataFrame, readings: DataFrame) -> DataFrame:
    """Offered pairs (pair_id) with ``verdict`` from their readings (pair_id, order, verdict).

    SAME in both orders is same, in one split; none, an unreadable or a missing reading is different.
    """
    said = readings.where("`order` in ('straight', 'swapped')").groupBy("pair_id").agg(F.count_distinct(F.when(F.upper(F.trim("verdict")) == "SAME", F.col("order"))).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return offered.join(said, "pair_id", "left").withColumn("verdict", F.when(n == 2, "same").when(n == 1, "split").otherwise("different")).drop("_n")


def audit_residue(entries: DataFrame, verdicts: DataFrame, themes: DataFrame) -> DataFrame:
    """Entries (entry_id) with outcome (real, covered), theme and unaudited.

    verdicts: entry_id, verdict, theme. COVERED counts only with the name of an active theme; an entry without a verdict is real and unaudited.
    """
    live = themes.where("lifecycle = 'active'").groupBy(T.fold(F.col("name")).alias("_f")).agg(F.min("name").alias("_name"))
    said = verdicts.select("entry_id", "verdict", T.fold(F.col("theme")).alias("_f"), F.lit(True).alias("_read"))
    rows = entries.join(said, "entry_id", "left").join(broadcast_if_small(live), "_f", "left")
    covered = F.coalesce((F.col("verdict") == "COVERED") & F.col("_name").isNotNull(), F.lit(False))
    return rows.select(*entries.columns, F.when(covered, "covered").otherwise("real").alias("outcome"), F.when(covered, F.col("_name")).alias("theme"), F.col("_read").isNull().alias("unaudited"))


def score_adjudicated(rulings: DataFrame, verdicts: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(totals, misses): per stratum the ruled claims and how many verdicts agree with the ruling; and the claims whose verdict does not, a row each.

    misses: ``by``, claim_id, ruled, said. A claim without a verdict, or with a null one on either side, is a miss.
    """
    met = rulings.join(verdicts.select("claim_id", F.col("verdict").alias("said")), "claim_id", "left").withColumnRenamed("verdict", "ruled")
    right = F.coalesce(F.col("said") == F.col("ruled"), F.lit(False))
    totals = met.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(right).alias("right"))
    return totals, met.where(~right).select(*by, "claim_id", "ruled", "said")


# --- merges ---------------------------------------------------------------------------------------


def merge_claims(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """(claim_id, successor_id) of the later claim of each pair (a, b), by first_seen_at, inserted_at and id.

    Pairs are disjoint rulings; a claim that loses twice is closed by its earliest winner.
    """
    when = claims.select("claim_id", F.struct("first_seen_at", "inserted_at", "claim_id").alias("w"))
    both = pairs.select("a", "b").where("a <> b").join(when.select(F.col("claim_id").alias("a"), F.col("w").alias("wa")), "a").join(when.select(F.col("claim_id").alias("b"), F.col("w").alias("wb")), "b")
    closed = both.select(F.greatest("wa", "wb")["claim_id"].alias("claim_id"), F.least("wa", "wb").alias("win"))
    return closed.groupBy("claim_id").agg(F.min("win")["claim_id"].alias("successor_id"))


def merged_links(links: DataFrame, closed: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Links (claim_id, item, ...) after a merge: the closed claims' links go to their successors, whose own win ties."""
    moved = links.join(closed, "claim_id", "left").withColumn("_own", F.col("successor_id").isNull()).withColumn("claim_id", F.coalesce("successor_id", "claim_id")).drop("successor_id")
    return upsert_last(moved, ["claim_id", item], ["_own", *order]).drop("_own")


def merge_persons(persons: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, merged_into_id, n): who is folded into whom when pairs (n, a, b) are applied in the order of n.

    persons: id, full_name, inserted_at. The fuller name survives: more words, then longer, then earlier, then smaller id.
    A pair that touches a person already folded is skipped. A person is folded by the first pair it loses whose winner is
    not folded before; winners outrank losers, so this settles in as many rounds as the longest chain of ranks.
    """
    better = F.struct(-F.size(T.words(F.col("full_name"), r"\s+")), -F.length("full_name"), "inserted_at", "id")
    p = persons.select("id", better.alias("r"))
    both = pairs.where("a <> b").join(p.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(p.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    first = F.col("ra") < F.col("rb")
    lost = settle(both.select("n", F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner")))
    folded = settle(lost.groupBy("id").agg(F.min(F.struct("n", "winner")).alias("f")))
    while True:
        until = folded.select(F.col("id").alias("winner"), F.col("f.n").alias("_until"))
        alive = lost.join(until, "winner", "left").where("_until is null or _until > n")
        new = settle(alive.groupBy("id").agg(F.min(F.struct("n", "winner")).alias("f")))
        old = folded.select("id", F.col("f").alias("g"))
        if new.join(old, "id", "full").where("not (f <=> g)").isEmpty():
            return new.select("id", F.col("f.winner").alias("merged_into_id"), F.col("f.n").alias("n"))
        folded = new


def fold_places(places: DataFrame, names: DataFrame, links: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, names, links) after folds (id, into): children move up, names are carried unless held, links become manual.

    places: id, parent_id, lifecycle, replaced_by_id. names: place_id, name, kind. links: claim_id, place_id, how_resolved, confidence. A fold's target is not folded itself.
    """
    f = folds.where("id <> into").select(F.col("id").alias("_id"), "into")
    moved = places.join(f.select(F.col("_id").alias("parent_id"), F.col("into").alias("_up")), "parent_id", "left").withColumn("parent_id", F.coalesce("_up", "parent_id"))
    closed = moved.join(f, F.col("id") == F.col("_id"), "left")
    gone = F.col("_id").isNotNull()
    out = closed.withColumns({"lifecycle": F.when(gone, "deprecated").otherwise(F.col("lifecycle")), "replaced_by_id": F.when(gone, F.col("into")).otherwise(F.col("replaced_by_id"))}).select(*places.columns)
    carried = names.join(f, F.col("place_id") == F.col("_id")).withColumn("place_id", F.col("into")).select(*names.columns)
    held = names.select("place_id", T.fold(F.col("name")).alias("_f")).distinct()
    fresh = carried.withColumn("_f", T.fold(F.col("name"))).join(held, ["place_id", "_f"], "left_anti").dropDuplicates(["place_id", "_f"]).select(*names.columns)
    relinked = links.join(f, F.col("place_id") == F.col("_id"), "left")
    here = F.col("_id").isNotNull()
    relinked = relinked.withColumns({"place_id": F.coalesce("into", "place_id"), "how_resolved": F.when(here, "manual").otherwise(F.col("how_resolved")), "confidence": F.when(~here, F.col("confidence")), "_moved": here})
    once = Window.partitionBy("claim_id", "place_id").orderBy(F.desc("_moved"), F.desc("confidence"))
    return out, names.unionByName(fresh), relinked.withColumn("_k", F.row_number().over(once)).where("_k = 1").select(*links.columns)
