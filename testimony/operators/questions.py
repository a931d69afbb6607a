"""The nine questions that the record asks people, assembled for all events, and the runs that it can show.

A question has a count and a bounded sample of what it is about: a sample is the feature, the counts cover all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators import duplicates, graphs, report
from testimony.operators.durable import settle
from testimony.operators.resolution import parse_mention

SPOT_CHECKS, LISTED, UNSURE = 3, 8, 0.7

# The kinds of question in the order they are asked.
KINDS = ["proposed_vocabulary", "ambiguous", "low_confidence", "unresolved", "pending_persons", "flagged", "proposed_places", "duplicate_place", "duplicate_claims"]


def headline(rows: DataFrame, by: list[str], item: Column, order: list[Column | str], k: int) -> DataFrame:
    """Per key: how many rows, and the first k items in order. The ranks are cut before the shuffle, the count is summed in parts."""
    keyed = rows.withColumn("_item", item.cast("string"))
    counted = keyed.groupBy(*by).agg(F.count("*").alias("n"))
    top = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k)
    shown = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_item"))), lambda x: x["_item"]).alias("sample"))
    return counted.join(shown, by)


def mention_links(claims: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, form, claim_id, at, place_id, how_resolved): each mention's first form with the link of the same rank.

    claims: id, event_id, place_mention. links: claim_id, ord, place_id, how_resolved. A 'manual' link is an answer, not a question.
    """
    said = claims.select("event_id", "place_mention").where("place_mention is not null").distinct()
    said = said.select("event_id", "place_mention", F.posexplode(parse_mention(F.col("place_mention"))).alias("at", "m"))
    form = claims.join(said, ["event_id", "place_mention"]).select("event_id", F.col("id").alias("claim_id"), "at", F.get(F.col("m.forms"), F.lit(0)).alias("form"))
    ranked = links.withColumn("at", F.row_number().over(Window.partitionBy("claim_id").orderBy("ord", "place_id")) - 1)
    return form.join(ranked.select("claim_id", "at", "place_id", "how_resolved"), ["claim_id", "at"]).where("place_id is not null and not how_resolved <=> 'manual'")


def ambiguous_names(claims: DataFrame, links: DataFrame, names: DataFrame, closure: DataFrame) -> DataFrame:
    """(event_id, form, claim_id) of mentions whose name other places answer to, or begin with.

    names: event_id, place_id, name (folded). The place a form is linked to is that of its smallest claim.
    """
    said = settle(mention_links(claims, links))
    linked = said.groupBy("event_id", "form").agg(F.min_by("place_id", F.struct("claim_id", "at")).alias("linked_id"))
    tied = report.rivals(linked, names, closure, by=["event_id"]).select("event_id", "form").distinct()
    return said.join(tied, ["event_id", "form"], "left_semi").select("event_id", "form", "claim_id")


def review_queues(
    themes: DataFrame, claims: DataFrame, links: DataFrame, names: DataFrame, closure: DataFrame, persons: DataFrame,
    places: DataFrame, place_pairs: DataFrame, claim_pairs: DataFrame, acts: DataFrame, withdrawn: DataFrame,
) -> DataFrame:
    """(event_id, number, kind, subject, n, sample) of all nine questions, numbered from 1 within each event.

    themes: event_id, id, name, lifecycle. claims (current): id, event_id, place_mention, support. links: claim_id, ord,
    place_id, how_resolved, confidence. names: event_id, place_id, name (folded). persons: event_id, id, status,
    merged_into_id. places: event_id, id, lifecycle. place_pairs: event_id, place_id, other_id, score. claim_pairs: event_id, elder_id,
    younger_id. acts: kind, target_id, other (what the act names: the other id, or the accepted verdict). withdrawn:
    (a, b) claims that a judge took back. Rulings hold for a pair in either order. Questions about nothing are not asked.
    """
    unclear = settle(ambiguous_names(claims, links, names, closure))
    covered = unclear.select(F.col("claim_id").alias("id")).distinct()
    event = claims.select("id", "event_id", "place_mention", "support")
    weak = links.where((F.col("confidence") < UNSURE) & F.col("place_id").isNotNull() & (F.coalesce("how_resolved", F.lit("")) != "mention_ancestor"))
    weak = weak.withColumnRenamed("claim_id", "id").join(event, "id").join(covered, "id", "left_anti")
    lost = event.where("place_mention <> ''").join(links.select(F.col("claim_id").alias("id")).distinct(), "id", "left_anti")
    accepted = acts.where("kind = 'accept_support'").select(F.col("target_id").alias("claim_id"), F.col("other").alias("support"))
    flagged = report.accepted_verdicts(event.where("support in ('overstated', 'unsupported')").withColumn("claim_id", F.col("id").cast("string")), accepted)
    ruled = lambda kind: acts.where(F.col("kind") == kind).select(F.col("target_id").alias("a"), F.col("other").alias("b"))
    text = lambda rows, a, b: rows.withColumns({"a": F.col(a).cast("string"), "b": F.col(b).cast("string")})
    twice = duplicates.pair_exclusion(text(place_pairs, "place_id", "other_id"), ruled("distinguish_places"))
    told = duplicates.pair_exclusion(text(claim_pairs, "elder_id", "younger_id"), ruled("distinguish_claims"))
    told = settle(duplicates.pair_exclusion(told, withdrawn.select(F.col("a").cast("string"), F.col("b").cast("string"))).select("event_id", "a", "b"))
    groups = graphs.connected(told).groupBy("component").agg(F.count("*").alias("_size"))
    groups = told.join(groups, F.least("a", "b") == F.col("component"), "left_semi").select("event_id", F.least("a", "b").alias("component")).distinct().join(groups, "component")

    def asked(kind: str, rows: DataFrame, item: Column, order: list, k: int, subject: Column | None = None) -> DataFrame:
        rows = rows.withColumn("subject", F.lit("") if subject is None else subject)
        return headline(rows, ["event_id", "subject"], item, order, k).select("event_id", F.lit(KINDS.index(kind)).alias("_q"), F.lit(kind).alias("kind"), "subject", "n", "sample")

    c = F.col
    parts = [
        asked("proposed_vocabulary", themes.where("lifecycle = 'proposed'"), c("name"), ["name", "id"], LISTED),
        asked("ambiguous", unclear.distinct(), c("claim_id"), ["claim_id"], SPOT_CHECKS, c("form")),
        asked("low_confidence", weak, c("id"), ["confidence", "id", "place_id"], SPOT_CHECKS),
        asked("unresolved", lost, c("id"), ["id"], LISTED),
        asked("pending_persons", persons.where("status = 'pending_review' and merged_into_id is null"), c("id"), ["id"], SPOT_CHECKS),
        asked("flagged", flagged, c("id"), ["id"], LISTED),
        asked("proposed_places", places.where("lifecycle = 'proposed'"), c("id"), ["id"], LISTED),
        asked("duplicate_place", twice, F.concat_ws("~", "other_id", "place_id"), [F.desc("score"), "other_id", "place_id"], LISTED),
        asked("duplicate_claims", groups, c("component"), [F.desc("_size"), "component"], LISTED),
    ]
    # An event asks one question of each kind and one for each unclear name, so a number is a short window.
    w = Window.partitionBy("event_id").orderBy("_q", F.desc("n"), "subject")
    return reduce(DataFrame.unionByName, parts).withColumn("number", F.row_number().over(w)).select("event_id", "number", "kind", "subject", "n", "sample")


SUMMARY = "beat struct<prose: string, sources: array<struct<n: int, x_id: string>>>, extract struct<drafted: long, skipped: long>, resolve struct<linked: long, proposed: long>, verify struct<supported: long, unsupported: long>"


def run_table(runs: DataFrame) -> DataFrame:
    """Runs (event_id, run_id, status, started_at, summary as JSON) with their stages' counts; a stage that did not run has nulls."""
    s = runs.withColumn("_s", F.from_json("summary", SUMMARY))
    counts = ["extract.drafted", "extract.skipped", "resolve.linked", "resolve.proposed", "verify.supported", "verify.unsupported"]
    return s.select("event_id", "run_id", "status", "started_at", *[F.col(f"_s.{c}").alias(c.split(".")[1]) for c in counts], F.col("_s.beat").alias("beat"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Per event the newest completed run that carries a beat: run_id, prose and its numbered sources."""
    told = run_table(runs).where("status = 'completed' and beat is not null")
    last = told.groupBy("event_id").agg(F.max_by(F.struct("run_id", "beat"), F.struct("started_at", "run_id")).alias("r"))
    return last.select("event_id", F.col("r.run_id").alias("run_id"), F.col("r.beat.prose").alias("prose"), F.col("r.beat.sources").alias("sources"))


def folded_names(places: DataFrame, names: DataFrame) -> DataFrame:
    """(event_id, place_id, name) under which active places are known, folded, once each."""
    live = places.where("lifecycle = 'active'").select("event_id", F.col("id").alias("place_id"), F.col("canonical_name").alias("name"))
    other = live.drop("name").join(names.select("place_id", "name"), "place_id").select("event_id", "place_id", "name")
    return live.unionByName(other).withColumn("name", T.fold(F.col("name"))).where("name <> ''").distinct()
