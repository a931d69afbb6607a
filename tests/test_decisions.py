"""Decisions against the same decisions applied one by one; questions on empty and odd tables."""

import random

from testimony.operators import decisions, questions, report

ACTORS = [(1, "person", 1), (2, "agent", 1), (3, "person", 2)]
CLAIMS = "claim_id long, event_id int, first_seen_at timestamp, superseded_at timestamp, kind string, subject string, magnitude string, place_mention string, status string, nuance string"


def actors(spark):
    return spark.createDataFrame(ACTORS, "actor_id int, kind string, event_id int")


def test_corrections(spark):
    claims = spark.createDataFrame([(i, 1, None, None, "rescate", "un hombre", None, "La Guaira", None, None) for i in (1, 2, 3)], CLAIMS)
    told = [
        (1, 1, {"kind": "rescate"}, 1), (2, 1, {"kind": "derrumbe", "subject": "un hombre"}, 1), (3, 1, {"status": "viva"}, 1), (4, 2, {"place_mention": None}, 1), (5, 3, {"support": "supported"}, 1),
        (6, 3, {"kind": "x"}, 2), (7, 3, {"kind": "x"}, 3), (8, 9, {"kind": "x"}, 1), (9, 3, None, 1),
    ]
    outcomes, drafts = decisions.correct_claims(claims, spark.createDataFrame(told, "n int, claim_id long, fields map<string,string>, actor_id int"), actors(spark))
    refused = {r.n: r.refused for r in outcomes.collect()}
    assert refused == {1: "no_change", 2: None, 3: "not_current", 4: None, 5: "not_correctable", 6: "not_a_person", 7: "different_events", 8: "missing", 9: "no_change"}
    new = {r.corrects_id: r for r in drafts.collect()}
    assert (new[1].kind, new[1].subject, new[1].place_mention, new[1].support, new[1].moved) == ("derrumbe", "un hombre", "La Guaira", "unverified", False)
    assert (new[2].kind, new[2].place_mention, new[2].moved) == ("rescate", None, True)
    links = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "claim_id long, place_id string").withColumn("claim_id", questions.F.col("claim_id").cast("string"))
    assert [r.place_id for r in decisions.carried(links, drafts, places=True).collect()] == ["p"]
    assert sorted(r.place_id for r in decisions.carried(links, drafts).collect()) == ["p", "q"]


def test_renames_keep_what_was(spark):
    places = spark.createDataFrame([(1, "Caribe"), (2, "Coral")], "id int, canonical_name string")
    names = spark.createDataFrame([(1, "CARIBE", "official", "raw"), (1, "Playa", "alias", "raw"), (2, "Coral", "official", "raw")], "place_id int, name string, kind string, emission string")
    moves = spark.createDataFrame([(1, 1, "Caribé Norte"), (2, 1, "Caribe Norte 2"), (3, 1, "Caribe Sur"), (4, 9, "nowhere")], "n int, id int, name string")
    after, kept = decisions.rename_places(places, names, moves)
    assert {r.id: r.canonical_name for r in after.collect()} == {1: "Caribe Sur", 2: "Coral"}
    assert sorted(tuple(r) for r in kept.collect()) == [
        (1, "CARIBE", "error", "recognition_only"), (1, "Caribe Norte 2", "error", "recognition_only"), (1, "Caribé Norte", "error", "recognition_only"), (1, "Playa", "alias", "raw"), (2, "Coral", "official", "raw"),
    ]


def test_log_is_that_of_one_decision_after_another(spark):
    rng = random.Random(7)
    kinds = [v for v in decisions.VERBS if v[1] in ("place", "claim")]
    life = {i: ("proposed" if i % 2 else "active") for i in range(6)}
    told = []
    for n in range(300):
        kind, about = rng.choice(kinds)[:2]
        told.append((n, kind, rng.randrange(6) if about == "place" else None, rng.randrange(6) if about == "claim" else None, None, None, rng.choice("abc"), 1, "seen"))
    told += [(900, "paint_place", 1, None, None, None, "x", 1, "seen"), (901, "rename_place", 1, 1, None, None, "x", 1, "seen"), (902, "rename_place", None, 1, None, None, "x", 1, "seen"), (903, "rename_place", 77, None, None, None, "x", 1, "seen")]
    told += [(904, "rename_place", 1, None, None, None, None, 1, "seen"), (905, "rename_place", 1, None, None, None, "x", 2, None), (906, "rename_place", 1, None, None, None, "x", 3, "seen")]
    state = {("place", str(i), "lifecycle"): v for i, v in life.items()} | {("claim", str(i), "state"): "current" for i in range(6)} | {("claim", "0", "places"): "z"}
    now, want, illegal = dict(state), {}, set()
    moves = {v[0]: v[1:] for v in decisions.VERBS}
    for n, kind, place, claim, _, _, value, _, _ in told[:300]:
        about, field, becomes, move = moves[kind]
        key = (about, str(place if about == "place" else claim), field)
        before = now.get(key)
        if (move, before) in {("open", "active"), ("open", "deprecated"), ("open", "discarded")} or (move == "close" and before not in ("active", "current")) or (move == "drop" and before not in ("active", "proposed")):
            illegal.add(n)
            continue
        after = becomes or value
        if move == "add":
            held = before.split(", ") if before else []
            after = ", ".join(held if value in held else [*held, value])
        want[n] = (value, None) if move == "none" else (before, after)
        if move != "none":
            now[key] = after
    schema = "n int, kind string, place_id int, claim_id int, person_id int, theme_id int, value string, actor_id int, reason string"
    targets = spark.createDataFrame([(a, str(i), 1) for a in ("place", "claim") for i in range(6)], "about string, target_id string, event_id int")
    rows = spark.createDataFrame([(*k, v) for k, v in state.items()], "about string, target_id string, field string, value string")
    acts, bad, changes = decisions.audit_log(spark.createDataFrame(told, schema), actors(spark), targets, rows)
    one = lambda m: next(iter(m.values())) if m else None
    assert {r.n: (one(r.before), one(r.after)) for r in acts.collect()} == want
    refused = {r.n: r.reasons for r in bad.collect()}
    assert {n for n, why in refused.items() if why == ["illegal_transition"]} == illegal
    assert {n: why for n, why in refused.items() if n >= 900} == {
        900: ["unknown_kind"], 901: ["not_one_target"], 902: ["wrong_target"], 903: ["target_missing"], 904: ["value_missing"], 905: ["no_reason", "not_a_person"], 906: ["other_event"],
    }
    assert {(r.about, r.target_id, r.field): r.value for r in changes.collect()} == {k: v for k, v in now.items() if state.get(k) != v or k[2] not in ("lifecycle", "state", "places")}


def test_links_after_decisions(spark):
    links = spark.createDataFrame([(1, "a", "mention_exact", 0.9), (1, "b", "mention_exact", 0.9), (2, "a", "mention_fuzzy", 0.6)], "claim_id int, place_id string, how_resolved string, confidence double")
    told = spark.createDataFrame([(1, "link_claim_place", 1, "x"), (2, "relink_claim_place", 1, "b"), (3, "link_claim_place", 1, "c"), (4, "link_claim_place", 2, "a")], "n int, kind string, claim_id int, place_id string")
    got = sorted(tuple(r) for r in decisions.relink_claims(links, told).collect())
    assert got == [(1, "b", "manual", None), (1, "c", "manual", None), (2, "a", "manual", None)]


def test_rivals_of_short_forms(spark):
    forms = spark.createDataFrame([(1, "el", "p"), (2, "el", "p"), (1, "sur", "s")], "event_id int, form string, linked_id string")
    names = spark.createDataFrame([(1, "p", "el"), (1, "q", "el palmar"), (1, "r", "el roble"), (2, "t", "el mar"), (1, "s", "sur"), (1, "u", "sur")], "event_id int, place_id string, name string")
    closure = spark.createDataFrame([("p", "r", 1)], "ancestor string, descendant string, depth int")
    got = sorted(tuple(r) for r in report.rivals(forms, names, closure, by=["event_id"]).collect())
    assert got == [(1, "el", "p", "q"), (1, "sur", "s", "u"), (2, "el", "p", "t")]


def test_questions_about_nothing_are_not_asked(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    asked = questions.review_queues(
        empty("event_id int, id int, name string, lifecycle string"), empty("id int, event_id int, place_mention string, support string"), empty("claim_id int, ord int, place_id int, how_resolved string, confidence double"),
        empty("event_id int, place_id int, name string"), empty("ancestor int, descendant int, depth int"), spark.createDataFrame([(1, i, "pending_review", None) for i in range(5)], "event_id int, id int, status string, merged_into_id int"),
        empty("event_id int, id int, lifecycle string"), empty("event_id int, place_id int, other_id int, score double"), empty("event_id int, elder_id int, younger_id int"), empty("kind string, target_id string, other string"), empty("a int, b int"),
    )
    assert [(r.event_id, r.number, r.kind, r.n, r["sample"]) for r in asked.collect()] == [(1, 1, "pending_persons", 5, ["0", "1", "2"])]


def test_latest_run_carries_a_beat(spark):
    beat = '{"beat": {"prose": "En la costa.", "sources": [{"n": 1, "x_id": "9"}]}, "extract": {"drafted": 2, "skipped": 1}}'
    runs = spark.createDataFrame([(1, 1, "completed", 1, beat), (1, 2, "completed", 2, "{}"), (1, 3, "failed", 3, beat), (2, 4, "completed", 1, "not json"), (3, 5, "completed", 1, None)], "event_id int, run_id int, status string, started_at int, summary string")
    assert [(r.event_id, r.run_id, r.prose, r.sources[0].x_id) for r in questions.latest_run(runs).collect()] == [(1, 1, "En la costa.", "9")]
    table = {r.run_id: (r.drafted, r.skipped, r.linked) for r in questions.run_table(runs).collect()}
    assert table == {1: (2, 1, None), 2: (None, None, None), 3: (2, 1, None), 4: (None, None, None), 5: (None, None, None)}
