"""What people decide about the record, applied as whole tables: corrections, names, links, and the log of it all.

Decisions carry ``n``, their order. Later ones see what earlier ones left, so one batch gives what the same
decisions give one by one. Nothing is rewritten: each function returns the rows after, and who was refused and why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.curation import _reasons
from testimony.operators.durable import settle

# The fields of a claim that a correction may change.
CORRECTABLE = ["kind", "subject", "magnitude", "place_mention", "status", "nuance"]

# Each verb, what it is about, the field it moves, what that becomes (null: the decision's own value),
# and how it moves: open (from proposed), close (from active), drop (from proposed or active), set, add, replace, or none.
VERBS = [
    ("promote_place", "place", "lifecycle", "active", "open"),
    ("reparent_place", "place", "parent", None, "set"),
    ("retype_place", "place", "type", None, "set"),
    ("rename_place", "place", "canonical_name", None, "set"),
    ("deprecate_place", "place", "lifecycle", "deprecated", "close"),
    ("fold_place", "place", "lifecycle", "deprecated", "close"),
    ("discard_place", "place", "lifecycle", "discarded", "drop"),
    ("distinguish_places", "place", "not", None, "none"),
    ("link_claim_place", "claim", "places", None, "add"),
    ("relink_claim_place", "claim", "places", None, "replace"),
    ("correct_claim", "claim", "state", "superseded", "close"),
    ("retract_claim", "claim", "state", "superseded", "close"),
    ("merge_claims", "claim", "state", "superseded", "close"),
    ("distinguish_claims", "claim", "not", None, "none"),
    ("accept_support", "claim", "support", None, "none"),
    ("approve_person", "person", "status", "approved", "set"),
    ("withhold_person", "person", "status", "withheld", "set"),
    ("set_person_handle", "person", "display_handle", None, "set"),
    ("set_person_kind", "person", "kind", None, "set"),
    ("promote_theme", "theme", "lifecycle", "active", "open"),
    ("reparent_theme", "theme", "parent", None, "set"),
    ("deprecate_theme", "theme", "lifecycle", "deprecated", "close"),
    ("discard_theme", "theme", "lifecycle", "discarded", "drop"),
    ("rename_theme", "theme", "name", None, "set"),
    ("redefine_theme", "theme", "applies_when", None, "set"),
]
TARGETS = ["place", "claim", "person", "theme"]


def correct_claims(claims: DataFrame, corrections: DataFrame, actors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, drafts) of corrections (n, claim_id, fields map<string,string>, actor_id).

    claims: claim_id, event_id, first_seen_at, superseded_at and the correctable fields as strings. actors: actor_id, kind, event_id.
    outcomes: n, claim_id, refused (the first rule that refuses, or null), successor_id. The first correction of a claim that
    passes closes it, so later ones find it not current. drafts: the successors' rows, unverified, without a theme, with
    ``moved`` (was the place mention corrected, so that places stay behind); see ``carried``.
    """
    who = actors.select("actor_id", F.col("kind").alias("_kind"), F.col("event_id").alias("_event"))
    held = claims.select("claim_id", "event_id", "first_seen_at", "superseded_at", F.create_map(*[x for c in CORRECTABLE for x in (F.lit(c), F.col(c).cast("string"))]).alias("_held"))
    rows = corrections.join(held, "claim_id", "left").join(who, "actor_id", "left")
    unknown = F.exists(F.map_keys("fields"), lambda k: ~k.isin(*CORRECTABLE))
    changed = F.map_filter("fields", lambda k, v: ~F.try_element_at("_held", k).eqNullSafe(v))
    rows = rows.withColumn("_changed", changed)
    refused = (
        F.when(F.col("_held").isNull(), "missing")
        .when(F.coalesce(unknown, F.lit(False)), "not_correctable")
        .when(~F.col("_kind").eqNullSafe("person"), "not_a_person")
        .when(~F.col("_event").eqNullSafe(F.col("event_id")), "different_events")
        .when(F.col("superseded_at").isNotNull(), "not_current")
        .when(F.coalesce(F.size("_changed"), F.lit(0)) <= 0, "no_change")
    )
    rows = settle(rows.withColumn("_r", refused))
    winner = rows.where("_r is null").groupBy("claim_id").agg(F.min("n").alias("_first"))
    told = rows.join(winner, "claim_id", "left")
    # What the claim is closed for comes before the question whether a later correction changes anything.
    late = F.col("_first").isNotNull() & (F.col("n") > F.col("_first")) & (F.col("_r").isNull() | (F.col("_r") == "no_change"))
    told = told.withColumn("refused", F.when(late, "not_current").otherwise(F.col("_r")))
    successor = F.sha2(F.concat_ws("\u0001", F.col("claim_id").cast("string"), F.col("n").cast("string")), 256)
    told = told.withColumn("successor_id", F.when(F.col("refused").isNull(), successor))
    new = told.where("refused is null").withColumn("_now", F.map_concat(F.map_filter("_held", lambda k, v: ~F.map_contains_key("_changed", k)), "_changed"))
    drafts = new.select(
        F.col("successor_id").alias("claim_id"), F.col("claim_id").alias("corrects_id"), "event_id", "first_seen_at", "actor_id", F.lit("unverified").alias("support"),
        *[F.try_element_at("_now", F.lit(c)).alias(c) for c in CORRECTABLE], F.map_contains_key("_changed", F.lit("place_mention")).alias("moved"),
    )
    return told.select("n", "claim_id", "refused", "successor_id"), drafts


def carried(rows: DataFrame, drafts: DataFrame, places: bool = False) -> DataFrame:
    """The corrected claims' citations, persons or places (claim_id, ...) as rows of their successors; places only
    where the place mention stands."""
    to = drafts.where("not moved") if places else drafts
    to = to.select(F.col("corrects_id").alias("_old"), F.col("claim_id").alias("_new"))
    return rows.join(to, F.col("claim_id") == F.col("_old")).withColumn("claim_id", F.col("_new")).select(*rows.columns)


def rename_places(places: DataFrame, names: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, names) after renames (n, id, name): the last name stands, each former one is kept as an error.

    places: id, canonical_name. names: place_id, name, kind, emission. A former name that the place holds already becomes kind
    'error', emission 'recognition_only' where it is; another is added so. Nothing is forgotten.
    """
    told = renames.join(places.select("id", F.col("canonical_name").alias("_own")), "id")
    told = settle(told.withColumn("was", F.coalesce(F.lag("name").over(Window.partitionBy("id").orderBy("n")), "_own")))
    last = told.groupBy("id").agg(F.max_by("name", "n").alias("_name"))
    renamed = places.join(last, "id", "left").withColumn("canonical_name", F.coalesce("_name", "canonical_name")).select(*places.columns)
    former = told.groupBy(F.col("id").alias("place_id"), T.fold(F.col("was")).alias("_f")).agg(F.min_by("was", "n").alias("_was"))
    marked = names.withColumn("_f", T.fold(F.col("name"))).join(former, ["place_id", "_f"], "left")
    wrong = F.col("_was").isNotNull()
    kept = marked.withColumns({"kind": F.when(wrong, "error").otherwise(F.col("kind")), "emission": F.when(wrong, "recognition_only").otherwise(F.col("emission"))})
    new = former.join(names.select("place_id", T.fold(F.col("name")).alias("_f")), ["place_id", "_f"], "left_anti")
    new = new.select("place_id", F.col("_was").alias("name"), F.lit("error").alias("kind"), F.lit("recognition_only").alias("emission"))
    return renamed, kept.select("place_id", "name", "kind", "emission").unionByName(new)


def relink_claims(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """Links (claim_id, place_id, how_resolved, confidence) after decisions (n, kind, claim_id, place_id).

    'relink_claim_place' drops the claim's other links, 'link_claim_place' adds one. A link a person made is 'manual', without confidence.
    """
    cut = decisions.where("kind = 'relink_claim_place'").groupBy("claim_id").agg(F.max("n").alias("_cut"))
    made = decisions.join(cut, "claim_id", "left").where("_cut is null or n >= _cut").select("claim_id", "place_id").distinct()
    stay = links.join(cut.select("claim_id"), "claim_id", "left_anti").join(made, ["claim_id", "place_id"], "left_anti")
    none = F.lit(None).cast(links.schema["confidence"].dataType)
    return stay.select("claim_id", "place_id", "how_resolved", "confidence").unionByName(made.select("claim_id", "place_id", F.lit("manual").alias("how_resolved"), none.alias("confidence")))


def audit_log(decisions: DataFrame, actors: DataFrame, targets: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(acts, rejects, changes) of decisions of 25 kinds.

    decisions: n, kind, place_id, claim_id, person_id, theme_id (exactly one of them given), value, actor_id, reason.
    actors: actor_id, kind, event_id. targets: about, target_id, event_id. state: about, target_id, field, value
    before the first decision (claims have field 'state', 'current' or 'superseded'; ids are strings).

    acts: one row for each accepted decision, with ``before`` and ``after`` as maps of the field; verbs that move nothing have no after.
    rejects: n and the reasons in a fixed order. changes: the fields that moved, with their last value.
    """
    verbs = decisions.sparkSession.createDataFrame(VERBS, "kind string, about string, field string, becomes string, move string")
    who = actors.select("actor_id", F.col("kind").alias("_who"), F.col("event_id").alias("_their"))
    rows = decisions.join(F.broadcast(verbs), "kind", "left").join(who, "actor_id", "left")
    ids = [F.col(f"{t}_id").cast("string") for t in TARGETS]
    given = sum((i.isNotNull().cast("int") for i in ids), F.lit(0))
    own = F.coalesce(*[F.when(F.col("about") == t, i) for t, i in zip(TARGETS, ids, strict=True)])
    rows = rows.withColumns({"_given": given, "target_id": own}).join(targets.withColumnRenamed("event_id", "_event"), ["about", "target_id"], "left")
    first = state.withColumnRenamed("value", "_initial")
    rows = rows.join(first, ["about", "target_id", "field"], "left")
    reasons = _reasons(
        unknown_kind=F.col("about").isNull(),
        not_one_target=F.col("_given") != 1,
        wrong_target=(F.col("_given") == 1) & F.col("about").isNotNull() & F.col("target_id").isNull(),
        target_missing=F.col("target_id").isNotNull() & F.col("_event").isNull(),
        no_reason=F.trim(F.coalesce("reason", F.lit(""))) == "",
        not_a_person=~F.col("_who").eqNullSafe("person"),
        other_event=F.col("_event").isNotNull() & F.col("_their").isNotNull() & (F.col("_event") != F.col("_their")),
        value_missing=F.col("becomes").isNull() & F.col("move").isin("set", "add", "replace") & F.col("value").isNull(),
    )
    rows = settle(rows.withColumn("reasons", reasons))
    sound = rows.where("size(reasons) = 0")
    # A lifecycle opens once and ends once: the first opening, and the first end that its state then allows.
    slot = Window.partitionBy("about", "target_id", "field")
    sound = sound.withColumn("_open", F.min(F.when((F.col("move") == "open") & (F.col("_initial") == "proposed"), F.col("n"))).over(slot))
    lives = F.col("_initial").isin("active", "current")
    ends = ((F.col("move") == "drop") & (lives | (F.col("_initial") == "proposed"))) | ((F.col("move") == "close") & (lives | (F.col("n") > F.col("_open"))))
    sound = sound.withColumn("_end", F.min(F.when(ends, F.col("n"))).over(slot))
    opens = (F.col("n") == F.col("_open")) & (F.col("_end").isNull() | (F.col("n") < F.col("_end")))
    legal = F.when(F.col("move") == "open", opens).when(F.col("move").isin("close", "drop"), F.col("n") == F.col("_end")).otherwise(F.lit(True))
    sound = settle(sound.withColumn("_legal", F.coalesce(legal, F.lit(False))))
    order = slot.orderBy("n")
    done = sound.where("_legal").withColumn("_run", F.sum((F.col("move") == "replace").cast("int")).over(order))
    # Places of a claim pile up from the last relink on; before the first they pile on those it had.
    piled = F.collect_list(F.when(F.col("move").isin("add", "replace"), F.col("value"))).over(Window.partitionBy("about", "target_id", "field", "_run").orderBy("n"))
    piled = F.array_join(F.array_distinct(F.concat(F.when((F.col("_run") == 0) & F.col("_initial").isNotNull(), F.split("_initial", ", ")).otherwise(F.array().cast("array<string>")), piled)), ", ")
    after = F.when(F.col("move").isin("add", "replace"), piled).when(F.col("move") != "none", F.coalesce("becomes", "value"))
    done = done.withColumn("_after", after)
    done = done.withColumn("_before", F.when(F.col("move") == "none", F.col("value")).when(F.row_number().over(order) == 1, F.col("_initial")).otherwise(F.lag("_after").over(order)))
    done = settle(done)
    acts = done.select("n", "kind", "about", "target_id", F.col("_event").alias("event_id"), "actor_id", "reason", F.create_map("field", "_before").alias("before"), F.when(F.col("move") != "none", F.create_map("field", "_after")).alias("after"))
    bad = rows.where("size(reasons) > 0").select("n", "kind", "reasons")
    bad = bad.unionByName(sound.where("not _legal").select("n", "kind", F.array(F.lit("illegal_transition")).alias("reasons")))
    changes = done.where("move <> 'none'").groupBy("about", "target_id", "field").agg(F.max_by("_after", "n").alias("value"))
    return acts, bad, changes
