"""Mentions, themes, folds and answers on the named cases, and folds against applying them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from testimony.operators import answers, curation, resolution, trees

TREE = [("P1", None, "Caraballeda", "active"), ("S1", "P1", "Tanaguarena", "active"), ("S2", "P1", "Los Cocos", "active"), ("S3", "P2", "Los Cocos", "active"), ("P2", None, "Macuto", "active"), ("E1", "P1", "Residencias Caribe", "active"), ("E2", "S1", "OPP 25", "active"), ("E3", "S1", "Torre Celta Mar 1", "active"), ("X", "P1", "Roca Vieja", "proposed")]


def parsed(spark, text):
    return spark.createDataFrame([(text,)], "v string").select(resolution.parse_mention(F.col("v")).alias("m")).first().m


def test_parse_mention(spark):
    (m,) = parsed(spark, "edificio OPP 25, Tanaguarena, Caraballeda")
    assert (m.original, m.raw_name, m.type, m.forms, m.ancestors) == ("edificio OPP 25", "OPP 25", "edificio", ["edificio opp 25", "opp 25"], ["tanaguarena", "caraballeda"])
    assert parsed(spark, "Caraballeda, edificio Roca Azul")[0].original == "edificio Roca Azul"
    assert parsed(spark, "Playa Los Cocos, estado La Guaira")[0].original == "Playa Los Cocos"
    assert [m.original for m in parsed(spark, "Tanaguarena y Los Cocos, Caraballeda")] == ["Tanaguarena", "Los Cocos"]
    assert parsed(spark, None) == parsed(spark, " , ") == []


def test_resolve_places(spark):
    said = ["edificio OPP 25, Tanaguarena, Caraballeda", "Residencia Caribe, Caraballeda", "Los Cocos, Caraballeda", "Tanaguarena y Los Cocos, Caraballeda", "edificio Roca Park, Tanaguarena", "Roca Park, Tanaguarena", "edificio Celta Mar II", "Roca Vieja, Caraballeda", None, "Tanaguarena", "Los Cocos"]
    claims = spark.createDataFrame([(i, 1, s) for i, s in enumerate(said)], "claim_id long, event_id int, place_mention string")
    places = spark.createDataFrame([(i, 1, p, n, life, k) for k, (i, p, n, life) in enumerate(TREE)], "id string, event_id int, parent_id string, canonical_name string, lifecycle string, inserted_at int")
    names = spark.createDataFrame([("E3", "edificio celtamar")], "place_id string, name string")
    held = spark.createDataFrame([(9, "manual")], "claim_id long, how_resolved string")
    out, new = resolution.resolve_places(claims, held, places, names, trees.tree_closure(places))
    got = {(r.claim_id, r.original): (r.outcome, r.how_resolved, r.place_id, r.confidence) for r in out.collect()}
    (proposal,) = new.collect()
    assert (proposal.canonical_name, proposal.parent_id, proposal.type) == ("Roca Park", "S1", "edificio")
    assert got == {
        (0, "edificio OPP 25"): ("linked", "mention_exact", "E2", 0.9),
        (1, "Residencia Caribe"): ("linked", "mention_fuzzy", "E1", 0.65),
        (2, "Los Cocos"): ("linked", "mention_exact", "S2", 0.85),
        (3, "Tanaguarena"): ("linked", "mention_exact", "S1", 0.9),
        (3, "Los Cocos"): ("linked", "mention_exact", "S2", 0.85),
        (4, "edificio Roca Park"): ("proposed", "mention_ancestor", proposal.id, 0.5),
        (5, "Roca Park"): ("proposed", "mention_ancestor", proposal.id, 0.5),
        (6, "edificio Celta Mar II"): ("unresolved", None, None, None),
        (7, "Roca Vieja"): ("proposed", "mention_ancestor", "X", 0.5),
        (10, "Los Cocos"): ("linked", "mention_exact", "S2", 0.5),
    }


@pytest.mark.parametrize(("kind", "want"), [("rescatada con vida una persona", "Persona rescatada con vida"), ("rescate", None), ("colapso", None), ("saqueo", None), ("", None), ("de la", None)])
def test_file_themes(spark, kind, want):
    themes = spark.createDataFrame([(1, n, n, nature, "active") for n, nature in [("Persona rescatada con vida", "happening"), ("Rescate de animal", "happening"), ("Colapso estructural", "happening"), ("Saqueo", "topic")]], "event_id int, id string, name string, nature string, lifecycle string")
    row = resolution.file_themes(spark.createDataFrame([(1, kind)], "event_id int, kind string"), themes).first()
    assert (row and row.theme_id) == want


def test_merges_of_persons_are_those_applied_in_order(spark):
    rng = random.Random(3)
    people = [(i, " ".join("ab"[: rng.randint(1, 2)] for _ in range(rng.randint(1, 4))), rng.randint(0, 5)) for i in range(120)]
    pairs = [(n, rng.randrange(120), rng.randrange(120)) for n in range(400)]
    rank = {i: (-len(name.split()), -len(name), at, i) for i, name, at in people}
    want = {}
    for n, a, b in pairs:
        if a != b and a not in want and b not in want:
            keep, fold = sorted((a, b), key=rank.get)
            want[fold] = (keep, n)
    got = curation.merge_persons(spark.createDataFrame(people, "id long, full_name string, inserted_at int"), spark.createDataFrame(pairs, "n long, a long, b long"))
    assert {r.id: (r.merged_into_id, r.n) for r in got.collect()} == want


def test_answers_are_read_leniently(spark):
    told = [
        (1, 1, '```json\n{"claims": [{"theme": "rescate", "subject_role": "un hombre, Ana", "names": ["Ana"], "confidence": "0.8", "citations": [99, "id 11", 12]}, {"theme": "rescate", "citations": ["77"]}], "topics": [{"topic": "unknown", "citations": ["13"]}]}\n```'),
        (1, 2, "sorry"),
        (1, 3, '{"topics": []}'),
        (1, 4, None),
    ]
    told = spark.createDataFrame(told, "event_id int, batch int, answer string")
    posts = spark.createDataFrame([(1, "11", 11), (1, "12", 12), (1, "13", 13), (1, "14", 14), (2, "15", 15)], "batch int, x_id string, post_id long").withColumn("posted_at", F.timestamp_seconds("post_id"))
    themes = spark.createDataFrame([(1, "t", "Rescate", "happening", "active")], "event_id int, id string, name string, nature string, lifecycle string")
    assert {r.batch: r.status for r in answers.parse_answers(told).collect()} == {1: "ok", 2: "invalid", 3: "missing_claims", 4: "invalid"}
    got = answers.ingest_answers(told, posts, themes)
    claims = {r.n: (r.outcome, r.subject, r.confidence, r.first_seen_at and r.first_seen_at.second) for r in got["claims"].collect()}
    assert claims == {0: ("drafted", "un hombre", 0.8, 11), 1: ("no_valid_citations", None, None, None)}
    assert [r.post_id for r in got["citations"].orderBy("post_id").collect()] == [11, 12]
    assert [r.post_id for r in got["silent"].collect()] == [14] and got["topics"].count() == 0
    (row,) = [r for r in answers.post_accounting(posts, got).collect() if r.batch == 1]
    assert (row.posts, row.cited, row.judged, row.silent, row.unread) == (4, 2, 0, 1, 1)


def test_residue_needs_a_live_theme(spark):
    entries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "entry_id long")
    verdicts = spark.createDataFrame([(1, "COVERED", "saqueo"), (2, "COVERED", "other"), (3, "NEW", "Saqueo")], "entry_id long, verdict string, theme string")
    themes = spark.createDataFrame([("Saqueo", "active")], "name string, lifecycle string")
    got = {r.entry_id: (r.outcome, r.theme, r.unaudited) for r in curation.audit_residue(entries, verdicts, themes).collect()}
    assert got == {1: ("covered", "Saqueo", False), 2: ("real", None, False), 3: ("real", None, False), 4: ("real", None, True)}
