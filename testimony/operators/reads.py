"""Reading the corpus and the record: scoped lists, what has been read, gates, sweeps, the vocabulary as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.durable import broadcast_if_small
from testimony.operators.history import upsert_last

VERDICTS = ["supported", "overstated", "unsupported"]
FLAGGED = ["overstated", "unsupported"]


# --- lists ----------------------------------------------------------------------------------------------


def list_by_event(rows: DataFrame, event, at: str, id_col: str = "id", newest_first: bool = False) -> DataFrame:
    """An event's rows in order of time, then id; posts, acts and runs are read newest first, others oldest first."""
    order = [F.desc(at), F.desc(id_col)] if newest_first else [F.asc(at), F.asc(id_col)]
    return rows.where(F.col("event_id") == F.lit(event)).orderBy(*order)


def active_vocabulary(rows: DataFrame) -> DataFrame:
    """Places, themes or tags that are active."""
    return rows.where("lifecycle = 'active'")


def claims_at_place(claims: DataFrame, links: DataFrame, place, at: str = "first_seen_at", id_col: str = "claim_id") -> DataFrame:
    """Claims linked to a place itself, once each, oldest first."""
    here = links.where(F.col("place_id") == F.lit(place)).select(id_col).distinct()
    return claims.join(here, id_col, "left_semi").orderBy(at, id_col)


def newest_claims(claims: DataFrame, at: str = "first_seen_at", id_col: str = "claim_id", k: int = 60) -> DataFrame:
    """The last k claims, newest first, each with ``rest``: how many older ones there are."""
    n = claims.agg(F.count("*").alias("_n"))
    last = claims.orderBy(F.desc(at), F.desc(id_col)).limit(k)
    return last.crossJoin(F.broadcast(n)).withColumn("rest", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n").orderBy(F.desc(at), F.desc(id_col))


def not_unplaced_check(placements: DataFrame, events: DataFrame) -> DataFrame:
    """Placements (id, event_id, place_id) with ``refused``: the place is the event's Unplaced place. events: id, unplaced_place_id."""
    known = events.select(F.col("id").alias("event_id"), F.col("unplaced_place_id").alias("_un"))
    return placements.join(broadcast_if_small(known), "event_id", "left").withColumn("refused", F.coalesce(F.col("place_id") == F.col("_un"), F.lit(False))).drop("_un")


# --- what has been read ---------------------------------------------------------------------------------


def spoken_posts(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(post_id): posts cited by a current claim that has a theme. claims: claim_id, theme_id, superseded_at. citations: claim_id, post_id."""
    speak = claims.where("superseded_at is null and theme_id is not null").select("claim_id")
    return citations.join(speak, "claim_id", "left_semi").select("post_id").distinct()


def read_set(claims: DataFrame, citations: DataFrame, theme_judgments: DataFrame, theme_nones: DataFrame) -> DataFrame:
    """(post_id): posts that were read: spoken of, judged on topic, or read and found without a theme; current answers only.

    theme_judgments, theme_nones: post_id, superseded_at.
    """
    current = lambda rows: rows.where("superseded_at is null").select("post_id")
    return spoken_posts(claims, citations).union(current(theme_judgments)).union(current(theme_nones)).distinct()


def unread_posts(posts: DataFrame, read: DataFrame, at: str = "posted_at", id_col: str = "post_id") -> DataFrame:
    """Posts that are not in ``read`` (post_id), oldest first."""
    return posts.join(read.select(F.col("post_id").alias(id_col)), id_col, "left_anti").orderBy(at, id_col)


def posts_in_window(posts: DataFrame, spoken: DataFrame, start, end, at: str = "posted_at", id_col: str = "post_id") -> DataFrame:
    """Posts of the half-open interval that no claim that can speak cites, oldest first."""
    inside = posts.where((F.col(at) >= F.lit(start).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))
    return unread_posts(inside, spoken, at, id_col)


def post_batches(posts: DataFrame, by: list[str], at: str, id_col: str, text: Column, size: int = 25) -> DataFrame:
    """(*by, batch, posts): consecutive posts in batches of ``size``, each rendered as lines in order of time.

    Positions come from ranges of the order, so a key with very many posts does not pass through one task.
    """
    from testimony.operators.beats import numbered

    rows = numbered(posts.select(*by, F.col(at).alias("_at"), F.col(id_col).alias("_id"), text.alias("_line")), [*by, "_at", "_id"], "_n")
    first = rows.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_n").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    placed = rows.join(broadcast_if_small(first), same).select(*by, "_n", "_line", F.floor((F.col("_n") - F.col("_first")) / size).alias("batch"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"])
    return placed.groupBy(*by, "batch").agg(F.array_join(lines, "\n").alias("posts"))


# --- the vocabulary as text -------------------------------------------------------------------------------


def vocabulary_block(themes: DataFrame, happenings: str = "HAPPENINGS", topics: str = "TOPICS") -> DataFrame:
    """(event_id, block): an event's active themes as one text: happenings, then topics, each by family.

    themes: event_id, id, parent_id, name, nature, lifecycle, applies_when. A family is the name of an active parent, in capitals; families come in
    order of name, themes without one last; themes in order of name. Of repeated themes each has a line.
    """
    active = active_vocabulary(themes)
    family = active.select(F.col("id").alias("parent_id"), F.col("event_id").alias("_e"), F.col("name").alias("family"))
    of = active.join(family, (active["parent_id"] == family["parent_id"]) & (active["event_id"] == family["_e"]), "left")
    happening = F.coalesce(F.col("nature") == "happening", F.lit(False))
    line = F.concat(F.lit("- «"), F.coalesce("name", F.lit("")), F.lit("» — applies when: "), F.coalesce("applies_when", F.lit("")))
    rows = of.select("event_id", happening.alias("h"), F.col("family").isNull().alias("loose"), "family", "name", active["id"].alias("id"), line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "id", "line"))), lambda x: x["line"])
    kin = rows.groupBy("event_id", "h", "loose", "family").agg(F.array_join(lines, "\n").alias("text"))
    headed = F.when(F.col("loose"), F.col("text")).otherwise(F.concat(F.lit("  "), F.upper("family"), F.lit("\n"), F.col("text")))
    parts = F.collect_list(F.when(F.col("h"), F.struct("loose", "family", headed.alias("t")))), F.collect_list(F.when(~F.col("h"), F.struct("loose", "family", headed.alias("t"))))
    both = kin.groupBy("event_id").agg(parts[0].alias("a"), parts[1].alias("b"))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), "\n\n")
    return both.select("event_id", F.concat(F.lit(f"{happenings}\n"), text("a"), F.lit(f"\n\n{topics}\n"), text("b")).alias("block"))


def render_prompts(batches: DataFrame, blocks: DataFrame, instructions: str) -> DataFrame:
    """Batches (event_id, batch, posts) with ``prompt``: instructions, the event's vocabulary, the posts. An event without a vocabulary gets none."""
    known = blocks.select(F.col("event_id").alias("_e"), "block")
    said = batches.join(broadcast_if_small(known), F.col("event_id") == F.col("_e"), "left")
    return said.withColumn("prompt", F.concat_ws("\n\n", F.lit(instructions), F.coalesce("block", F.lit("")), "posts")).drop("_e", "block")


# --- gates and verdicts -----------------------------------------------------------------------------------


def gate_queues(persons: DataFrame, places: DataFrame, claims: DataFrame) -> DataFrame:
    """(event_id, queue, id, n): what waits for a person, one row an item, with how many the queue holds.

    persons: event_id, id, status, merged_into_id; places: event_id, id, lifecycle; claims: event_id, id, support, superseded_at.
    Persons folded into another and claims that are closed do not wait.
    """
    kinds = {
        "persons_pending_review": persons.where("merged_into_id is null and status = 'pending_review'"),
        "places_proposed": places.where("lifecycle = 'proposed'"),
        "claims_not_supported": claims.where(F.col("superseded_at").isNull() & F.col("support").isin(FLAGGED)),
    }
    parts = [rows.select("event_id", F.lit(name).alias("queue"), F.col("id").cast("string").alias("id")) for name, rows in kinds.items()]
    every = parts[0].union(parts[1]).union(parts[2])
    counts = every.groupBy(F.col("event_id").alias("_e"), F.col("queue").alias("_q")).agg(F.count("*").alias("n"))
    return every.join(broadcast_if_small(counts), F.col("event_id").eqNullSafe(F.col("_e")) & (F.col("queue") == F.col("_q"))).drop("_e", "_q")


def preflight_events(asked: DataFrame, events: DataFrame, places: DataFrame, posts: DataFrame, claims: DataFrame) -> DataFrame:
    """Requests (event_id, place_id, forced) with ``reason`` why they may not run, null if they may, and n_places, n_posts.

    events: id, unplaced_place_id. places: id, event_id, lifecycle. posts: event_id. claims: event_id, superseded_at. The first reason holds:
    place_not_found, place_not_in_event, no_active_gazetteer (the Unplaced place does not count), no_posts_in_scope, already_told
    (the event has a current claim and is not forced).
    """
    spot = places.select(F.col("id").alias("place_id"), F.col("event_id").alias("_of"), F.lit(True).alias("_found"))
    live = places.where("lifecycle = 'active'").join(broadcast_if_small(events.select(F.col("unplaced_place_id").alias("id"))), "id", "left_anti")
    count = lambda rows, name: rows.groupBy("event_id").agg(F.count("*").alias(name))
    out = asked.join(spot, "place_id", "left")
    for rows, name in ((live, "n_places"), (posts, "n_posts"), (claims.where("superseded_at is null"), "_told")):
        out = out.join(broadcast_if_small(count(rows, name)), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    reason = (
        F.when(F.col("_found").isNull(), "place_not_found").when(~F.col("_of").eqNullSafe(F.col("event_id")), "place_not_in_event")
        .when(F.col("n_places") == 0, "no_active_gazetteer").when(F.col("n_posts") == 0, "no_posts_in_scope")
        .when((F.col("_told") > 0) & ~F.coalesce("forced", F.lit(False)), "already_told")
    )
    return out.withColumn("reason", reason).drop("_of", "_found", "_told")


def support_verdicts(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """Answers (claim_id, at, raw) with support, note and ``refused``: no_such_claim, no_ratified_rule, invalid_json or bad_verdict.

    claims: claim_id, theme_id. A claim without a theme has no rule to be judged by. A verdict is one of VERDICTS, as JSON, fenced or not.
    """
    known = claims.select("claim_id", F.col("theme_id").alias("_theme"), F.lit(True).alias("_known"))
    body = T.strip_fence(F.coalesce("raw", F.lit("")))
    read = F.from_json(body, "verdict string, note string", {"mode": "PERMISSIVE"})
    rows = answers.join(known, "claim_id", "left").withColumns({"_v": read["verdict"], "_note": read["note"], "_json": F.try_parse_json(body).isNotNull()})
    fine = F.coalesce(F.col("_v").isin(VERDICTS), F.lit(False))
    refused = (
        F.when(F.col("_known").isNull(), "no_such_claim").when(F.col("_theme").isNull(), "no_ratified_rule")
        .when(~F.col("_json"), "invalid_json").when(~fine, "bad_verdict")
    )
    rows = rows.withColumn("refused", refused)
    ok = F.col("refused").isNull()
    return rows.withColumns({"support": F.when(ok, F.col("_v")), "note": F.when(ok, F.col("_note"))}).drop("_theme", "_known", "_v", "_note", "_json")


def latest_support(verdicts: DataFrame) -> DataFrame:
    """(claim_id, support, note): the last accepted verdict of each claim; a later pass overwrites."""
    return upsert_last(verdicts.where("refused is null"), ["claim_id"], ["at", "raw"]).select("claim_id", "support", "note")


def ruled_on(runs: DataFrame) -> DataFrame:
    """(a, b), a <= b: pairs of claims that a completed run has ruled on, whatever the ruling.

    runs: kind, status, summary (JSON with lists of pairs under same, different and split).
    """
    s = F.from_json("summary", "same array<array<string>>, different array<array<string>>, split array<array<string>>")
    done = runs.where("kind = 'pair_judge' and status = 'completed'").select(s.alias("s"))
    none = F.array().cast("array<array<string>>")
    pairs = done.select(F.explode(F.concat(*[F.coalesce(F.col(f"s.{k}"), none) for k in ("same", "different", "split")])).alias("p")).where("size(p) = 2")
    return pairs.select(F.array_min("p").alias("a"), F.array_max("p").alias("b")).distinct()


# --- sweeps -----------------------------------------------------------------------------------------------


def sweep_summary(batches: DataFrame) -> DataFrame:
    """One row: batches, posts, drafted, routed, skipped, residue, residue_per_100 (null without posts).

    batches: posts, drafted, skipped, topics (map of name to count), unfitted (array).
    """
    routed = F.aggregate(F.map_values("topics"), F.lit(0).cast("long"), lambda n, x: n + x)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = batches.agg(
        F.count("*").alias("batches"), zero(F.sum("posts")).alias("posts"), zero(F.sum("drafted")).alias("drafted"), zero(F.sum(routed)).alias("routed"),
        zero(F.sum("skipped")).alias("skipped"), zero(F.sum(F.greatest(F.size("unfitted"), F.lit(0)))).alias("residue"),
    )
    return total.withColumn("residue_per_100", F.round(F.col("residue") * 100 / F.nullif("posts", F.lit(0)), 1))


def topic_totals(batches: DataFrame) -> DataFrame:
    """(topic, n) over all batches, most frequent first."""
    return batches.select(F.explode("topics").alias("topic", "k")).groupBy("topic").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "topic")


def unfiled_kinds(claims: DataFrame) -> DataFrame:
    """(kind, n): kinds of current claims that reach no theme, most frequent first. claims: kind, theme_id, superseded_at."""
    return claims.where("superseded_at is null and theme_id is null").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")
