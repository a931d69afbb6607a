"""Readers of JSON files, payloads, positions of names, and the prose of a beat."""

import json

from pyspark.sql import functions as F

from testimony.operators import beats, duplicates
from testimony.sources import corpus, vocabulary


def test_payloads(spark):
    rows = spark.createDataFrame([('{"text": "hola", "created_at": "2026-07-01T10:00:00Z"}',), ("broken",), (None,)], "payload string")
    got = corpus.payload_fields(rows).collect()
    assert [(r.text, r.posted_at and r.posted_at.hour) for r in got] == [("hola", 10), (None, None), (None, None)]


def test_vocabularies_are_topped_up(spark, tmp_path):
    themes, nodes = tmp_path / "themes.json", tmp_path / "nodes.json"
    themes.write_text(json.dumps({"themes": [
        {"name": "rescate", "applies_when": "a", "not_to_be_confused_with": "b", "parent": "hub", "nature": "happening"}, {"name": "colapso", "applies_when": "c", "not_to_be_confused_with": None, "parent": "held"},
        {"name": "held", "applies_when": "d"}, {"name": "hub", "applies_when": "e"}, {"name": "hub", "applies_when": "e"},
    ]}))
    known = spark.createDataFrame([(7, 1, "held"), (8, 2, "hub")], "id long, event_id long, name string")
    new, counts = vocabulary.load_taxonomy(vocabulary.read_themes(spark, str(themes)), 1, known)
    got = {r.name: r for r in new.collect()}
    assert {n: r.applies_when for n, r in got.items()} == {"rescate": "a Not to be confused with: b", "colapso": "c", "hub": "e"} and counts.first()[:] == (3, 2)
    assert got["rescate"].parent_id == got["hub"].id and got["colapso"].parent_id == "7" and got["hub"].parent_id is None
    again = vocabulary.load_taxonomy(vocabulary.read_themes(spark, str(themes)), 1, known.unionByName(new.select("id", "event_id", "name").withColumn("id", F.lit(9))))
    assert again[0].count() == 0 and again[1].first()[:] == (0, 5)


def test_gazetteers_are_loaded_parents_first(spark, tmp_path):
    path = tmp_path / "nodes.json"
    name = lambda n, k=None, e=None: {"name": n, "kind": k, "emission": e}
    path.write_text(json.dumps({"nodes": [
        {"old_id": "c", "parent_old_id": "b", "canonical": "Los Corales", "type": "sector", "names": [name("Corales", "alias", "raw"), name("CORALES", "alias", "raw"), name("Córales", "odd", "odd")]},
        {"old_id": "b", "parent_old_id": "a", "canonical": "Caraballeda", "type": "parroquia", "names": []}, {"old_id": "a", "parent_old_id": None, "canonical": "La Guaira", "type": "estado", "names": [name("Vargas", "historical", "anchored")]},
        {"old_id": "d", "parent_old_id": "b", "canonical": "los  corales", "type": "sector", "names": [name("corales", "alias", "raw"), name("LC", "acronym", "raw")]}, {"old_id": "e", "parent_old_id": "zz", "canonical": "Caribe", "type": "sector", "names": None},
        {"old_id": "x", "parent_old_id": "y", "canonical": "loop", "type": "sector"}, {"old_id": "y", "parent_old_id": "x", "canonical": "loop", "type": "sector"},
    ]}))
    places = spark.createDataFrame([(1, 1, None, "la guaira", "estado"), (2, 2, None, "Caribe", "sector"), (3, 1, 1, "Caribe", "sector")], "id long, event_id long, parent_id long, canonical_name string, type string")
    names = spark.createDataFrame([(1, "vargas", "historical", "anchored")], "place_id long, name string, kind string, emission string")
    new, added, counts = vocabulary.load_gazetteer(vocabulary.read_nodes(spark, str(path)), 1, places, names)
    got = {r.canonical_name: r for r in new.collect()}
    assert set(got) == {"Caraballeda", "Los Corales", "Caribe"} and counts.first()[:] == (3, 2, 3)
    assert got["Caraballeda"].parent_id == "1" and got["Los Corales"].parent_id == got["Caraballeda"].id and got["Caribe"].parent_id is None
    assert {(r.name, r.kind, r.emission) for r in added.collect()} == {("CORALES", "alias", "raw"), ("Córales", "alias", "recognition_only"), ("LC", "acronym", "raw")}
    held = places.selectExpr("cast(id as string) id", "event_id", "cast(parent_id as string) parent_id", "canonical_name", "type").unionByName(new.select("id", F.col("event_id").cast("long").alias("event_id"), "parent_id", "canonical_name", "type"))
    every = names.withColumn("place_id", F.col("place_id").cast("string")).unionByName(added)
    assert vocabulary.load_gazetteer(vocabulary.read_nodes(spark, str(path)), 1, held, every)[2].first()[:] == (0, 5, 0)


def test_report_and_residue_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "flagged", "c"), (2, "ambiguous", "d")], "event_id int, kind string, subject string")
    corpus.write_report(rows, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).where("event_id = 2").select("subject").first()[0] == "d"
    for _ in range(2):
        corpus.append_residue(rows, str(tmp_path / "residue"))
    assert spark.read.parquet(str(tmp_path / "residue")).where("logged_at is not null").count() == 4


def test_position_matches(spark):
    persons = spark.createDataFrame([(1, "Belkis Tejera"), (2, "Belkys Yaneth Tejera"), (3, "Ana Tejera"), (4, "Belkis")], "id int, full_name string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int")
    assert [tuple(r) for r in duplicates.position_matches(pairs, persons).collect()] == [(1, 2)]


def test_prose_of_a_beat(spark):
    rows = [(1, "Caribe", "se registró un colapso", [1, 2]), (2, "Caribe", "hubo un rescate", [3]), (3, None, "se buscaba a Ana", [])]
    clauses = spark.createDataFrame(rows, "position int, place_name string, text string, cite_ns array<int>")
    assert beats.render_beat(clauses).select(F.col("prose")).first()[0] == "En Caribe, se registró un colapso[1][2]; hubo un rescate[3]. Se buscaba a Ana."


def test_orders_are_numbered_without_one_task_for_all(spark):
    ordered = spark.range(400).select(F.col("id").alias("claim_id"), (F.col("id") + 1).alias("position"), F.when(F.col("id") % 90 > 3, (F.col("id") / 37).cast("int")).alias("place"), (F.col("id") / 150).cast("int").alias("part"))
    cited = spark.range(1200).select((F.col("id") * 7 % 400).alias("claim_id"), (F.col("id") % 5).alias("ord"), F.col("id").alias("post_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers, whole, parts = beats.citation_numbers(ordered, cited), beats.clause_runs(ordered, [], "place"), beats.clause_runs(ordered, ["part"], "place")
        for made in (numbers, whole):
            assert made.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < made.count()
        at = {r.claim_id: r.position for r in ordered.collect()}
        order = sorted((at[r.claim_id], r.ord, r.post_id) for r in cited.collect())
        assert {(r.position, r.ord, r.post_id): r.n for r in numbers.collect()} == {x: i + 1 for i, x in enumerate(order)}
        for made, by in ((whole, lambda r: 0), (parts, lambda r: r.part)):
            last = None
            for r in sorted(made.collect(), key=lambda r: r.position):
                run = 1 if last is None or by(last) != by(r) else last.run + (last.place != r.place)
                assert r.run == run
                last = r
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_begin_anew_in_one_sort(spark):
    """Numbers by beat need one shuffle of the rows, null beats too, and no window over them."""
    rows = spark.range(500).selectExpr("nullif(id % 3, 2) as beat", "id * 7919 % 500 as at")
    numbers = beats.numbered(rows, ["beat", "at"], "n", ["beat"])
    got = sorted((r.beat is None, r.beat or 0, r.at, r.n) for r in numbers.collect())
    want = []
    for beat in (0, 1, None):
        mine = sorted(i * 7919 % 500 for i in range(500) if (None if i % 3 == 2 else i % 3) == beat)
        want += [(beat is None, beat or 0, at, k + 1) for k, at in enumerate(mine)]
    assert got == sorted(want) and "Window" not in numbers._jdf.queryExecution().optimizedPlan().toString()
