"""Similar strings, names in long texts, hubs, model calls, name blocks, widened searches and posts kept for good, against brute force and on odd rows."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from testimony.functions import similarity as S
from testimony.functions import text as T
from testimony.operators import acquisition, answers, beats, curation, duplicates, graphs, names
from testimony.streaming import streams

SYLLABLES = "ma ri jo se lu is pe dro ca ro li na an to nio vi cen te gar cia lo pez dri guez her nan dez".split()


def three_words(rng):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 3))) for _ in range(3))


@pytest.mark.parametrize("bar", [0.6, 0.82, 0.92])
def test_alike_against_all_pairs(spark, bar, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    rng = random.Random(1)
    rows = [(three_words(rng)[: rng.randint(1, 24)], i % 3) for i in range(240)]
    rows += [("", 0), ("", 1), (None, 1), ("x", None), ("é" * 9, 0), ("e" * 9, 0), ("a" * 300, 2), ("a" * 299 + "b", 2), ("\U0001f600ab", 1), ("\U0001f600ba", 1)]
    left = spark.createDataFrame(rows, "a string, g int")
    by = defaultdict(set)
    for a, g in rows:
        if a is not None and g is not None:
            by[g].add(a)
    want = {(g, a, b) for g, v in by.items() for a in v for b in v if S.jaro_of(a, b) >= bar}
    got = [(r.g, r.a, r.b) for r in S.alike(left, left.toDF("b", "g"), bar, ["g"]).collect()]
    assert set(got) == want and len(got) == len(want)


def test_few_pairs_are_compared():
    rng = random.Random(2)
    some = S.Profile([three_words(rng) for _ in range(2_000)])
    assert len(S.candidates(some, some, 0.92)[0]) < 0.01 * 2_000**2


def test_long_runs_of_capitals(spark):
    many = " ".join(f"Nombre{'abcdefghij'[i % 10]}" for i in range(20_000))
    texts = spark.createDataFrame([(1, 1, many), (2, 1, "vino Juan Pérez y Ana de Sosa al Parque Central"), (3, 1, None), (4, 1, ""), (5, None, "Juan Pérez"), (6, 1, "El La Los Juan")], "id long, event_id int, text string")
    known = spark.createDataFrame([(1, "parque central"), (1, ""), (2, "juan perez")], "event_id int, name string")
    began = time.time()
    got = {(r.id, r.name) for r in names.unexplained_names(texts, known).collect()}
    assert got == {(1, many), (2, "Juan Pérez"), (2, "Ana de Sosa")} and time.time() - began < 60


def test_names_explain_both_ways(spark, monkeypatch):
    monkeypatch.setattr(names, "AUTOMATON_BYTES", 200)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    one, other = [(i % 2, word()) for i in range(150)], [(i % 2, word() + rng.choice(["", " "]) + word()) for i in range(150)]
    got = names.inclusions(spark.createDataFrame(one, "event_id int, s string"), spark.createDataFrame(other, "event_id int, s string")).collect()
    want = {(e, a, b) for e, a in one for f, b in other if e == f and a in b}
    assert {(r.event_id, r.sought, r.within) for r in got} == want and len(got) == len(want)


def test_neighbourhoods_round_a_hub(spark):
    spokes = 20_000
    hub = spark.range(1, spokes + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = graphs.neighbourhoods(hub.union(spark.createDataFrame([(1, 2), (30_000, 30_001)], "a long, b long"))).collect()
    assert sorted(len(r.members) for r in got) == [2, spokes + 1]


def test_neighbourhoods_against_all_sets(spark):
    rng = random.Random(4)
    for n in (6, 14):
        pairs = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(2 * n)]
        near = defaultdict(set)
        for a, b in pairs:
            near[a] |= {a, b}
            near[b] |= {a, b}
        sets = {tuple(sorted(s)) for s in near.values()}
        want = {s for s in sets if not any(set(s) < set(o) for o in sets)}
        assert {tuple(r.members) for r in graphs.neighbourhoods(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def test_calls_in_batches(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model(texts):
        (calls / f"{random.random()}").write_text(str(len(texts)))
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return texts[1:] if "short" in texts else [None if t == "mute" else t.upper() for t in texts]

    rows = [(i, f"p{i}") for i in range(20)] + [(20, None), (21, "bad"), (22, "short"), (23, "mute"), (3, "p3")]
    prompts = spark.createDataFrame(rows, "k long, prompt string")
    got = answers.infer_batches(prompts, model, ["k"], batch_size=1, calls_per_task=3)
    made = len(list(calls.iterdir()))
    said = sorted((r.k, r.answer or "", r.refused or "") for r in got.collect())
    assert said == sorted([(i, f"P{i}", "") for i in [*range(20), 3]] + [(20, "", "no prompt"), (21, "", "failed: ValueError: no"), (22, "", "failed: 0 answers to 1 prompts"), (23, "", "no answer")])
    assert made == 24 and got.count() == 25 and len(list(calls.iterdir())) == made
    again = answers.infer_batches(prompts, model, ["k"], batch_size=4, held=got)
    assert again.count() == 25 and len(list(calls.iterdir())) == made + 1
    assert {r.k for r in again.where("refused is not null").collect()} == {20, 21, 22, 23}
    whole = answers.infer_batches(prompts.where("k > 18"), model, ["k"], batch_size=10)
    assert {(r.k, r.answer) for r in whole.collect()} == {(k, None) for k in (19, 20, 21, 22, 23)}
    assert answers.infer_batches(prompts.limit(0), model, ["k"]).count() == 0


def test_positions_settle_blocks(spark):
    people = [
        (1, "Belkys Barreto"), (2, "Belkys Josefina Barreto García"), (3, "Belkis Barreto"), (4, "Valentina Juliette Azocar Milano"), (5, "Victoria Antonela Azocar Milano"),
        (6, "José Luis Pérez"), (7, "José Luis Ramírez"), (8, "Adriana"), (9, "Adriana Patricia Flores"), (10, "María Fernanda Rey Rujano"), (11, "María Fernanda Reyrujan"), (12, None), (13, ""),
    ]
    persons = spark.createDataFrame(people, "id long, full_name string")
    blocks = spark.createDataFrame([("all", i) for i, _ in people] + [("two", 1), ("two", 4), ("two", 4), ("two", 99)], "block string, id long")
    settled, residue = duplicates.position_blocks(blocks, persons)
    assert {(r.block, r.a, r.b) for r in settled.collect()} == {("all", 1, 2), ("all", 1, 3), ("all", 2, 3), ("all", 10, 11)}
    assert {(r.block, r.id) for r in residue.collect()} == {("all", i) for i in (4, 5, 6, 7, 8, 9, 12, 13)} | {("two", 1), ("two", 4), ("two", 99)}
    rng = random.Random(6)
    many = [(i, " ".join(rng.choice(["ana", "anna", "luz", "rey", "rei", "sol", "reysol", "mata"]) for _ in range(rng.randint(1, 4)))) for i in range(80)]
    settled, _ = duplicates.position_blocks(spark.createDataFrame([(i % 2, i) for i, _ in many], "block int, id long"), spark.createDataFrame(many, "id long, full_name string"))
    table = spark.createDataFrame(many, "id long, full_name string")
    pairs = table.alias("x").join(table.alias("y"), F.expr("x.id < y.id and x.id % 2 = y.id % 2")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    assert {(r.a, r.b) for r in settled.collect()} == {(r.a, r.b) for r in duplicates.position_matches(pairs, table).collect()}


def test_searches_widen_in_steps(spark):
    searches = spark.createDataFrame([(1, 0, 3600, 1200, "latest")], "search_id int, s long, e long, slice_seconds int, result_mode string").select("search_id", F.timestamp_seconds("s").alias("window_start"), F.timestamp_seconds("e").alias("window_end"), "slice_seconds", "result_mode")
    place_names = spark.createDataFrame([(p, n, "raw") for p, n in ((1, "Uno"), (2, "Dos"), (3, "Tres"), (3, "Drei"))], "place_id int, name string, emission string")
    terms, none = spark.createDataFrame([(1, "agua")], "search_id int, term string"), spark.createDataFrame([], "ancestor int, descendant int, depth int")
    types, empty = spark.createDataFrame([], "id int, type string"), spark.createDataFrame([], "search_id int, query_text string")
    scope = lambda *ps: spark.createDataFrame([(1, p) for p in ps], "search_id int, place_id int")
    widen = lambda places, window, held: acquisition.extend_search(searches.withColumn("window_end", F.timestamp_seconds(F.lit(window))), places, place_names, terms, none, types, F.current_timestamp(), held)
    held, seen = empty, []
    for places, window in ((scope(1), 3600), (scope(1, 2), 3600), (scope(1, 2, 3), 7200), (scope(1, 2, 3), 7200)):
        new = widen(places, window, held)["queries"].select("search_id", "query_text")
        seen.append(new.count())
        held = duplicates.settle(held.union(new))
    assert seen == [3, 3, 12, 0]
    once = widen(scope(1, 2, 3), 7200, empty)
    assert {r.query_text for r in held.collect()} == {r.query_text for r in once["queries"].collect()}
    assert once["query_names"].count() == 24 and once["query_terms"].count() == 18


def test_posts_are_kept_for_good(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "k long, at timestamp, text string"
    put = lambda rows: spark.createDataFrame(rows, "k long, s long, text string").select("k", F.timestamp_seconds("s").alias("at"), "text").coalesce(1).write.mode("append").parquet(source)
    put([(1, 100, "a"), (2, 100, "b"), (2, 50, "older in the batch"), (None, 1, "none")])
    stream = spark.readStream.schema(kind).parquet(source)
    run = lambda: streams.posts_for_ever(stream, ["k"], ["at", "text"], out, buckets=4)
    kept = lambda: {(r.k, r.text) for r in streams.stored_posts(stream, out).collect()}
    run()
    first = {(1, "a"), (2, "older in the batch"), (None, "none")}
    assert kept() == first
    put([(1, 10**6, "after days"), (3, 10**6, "c"), (None, 7, "again")])
    run()
    assert kept() == first | {(3, "c")}
    # A batch that failed in the middle of its writing is run again: its commit is gone, part of its files are there.
    commits = sorted((tmp_path / "out" / "offsets" / "commits").glob("1"))
    for c in commits:
        c.unlink()
        (c.parent / ".1.crc").unlink(missing_ok=True)
    run()
    assert commits and kept() == first | {(3, "c")} and streams.stored_posts(stream, out).count() == 4


def test_beats_of_many_places(spark):
    claims = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3}", f"k{i}") for i in range(6)], "claim_id long, d string, kind string").withColumn("first_seen_at", F.to_timestamp("d")).drop("d")
    closure = spark.createDataFrame([("R", "R", 0), ("R", "A", 1), ("R", "B", 1), ("A", "A", 0), ("B", "B", 0)], "ancestor string, descendant string, depth int")
    links = spark.createDataFrame([(0, "A"), (1, "B"), (2, "B"), (2, "A"), (3, "R"), (3, "A"), (4, "R"), (5, "B")], "claim_id long, place_id string")
    asked = spark.createDataFrame([("all", "R", "2024-01-01", "2024-01-09"), ("b", "B", "2024-01-02", "2024-01-03"), ("none", "B", "2025-01-01", "2025-01-02")], "beat string, root string, start string, end string")
    ordered = beats.order_beats(claims, links, closure, asked)
    got = defaultdict(list)
    for r in sorted(ordered.collect(), key=lambda r: r.position):
        got[r.beat].append((r.position, r.claim_id, r.anchor))
    assert got == {"all": [(1, 0, "A"), (2, 3, "A"), (3, 2, "A"), (4, 1, "B"), (5, 5, "B"), (6, 4, "R")], "b": [(1, 1, "B"), (2, 2, "B"), (3, 5, "B")]}
    cites = spark.createDataFrame([(0, 7, 1), (0, 8, 2), (3, 7, 1), (2, 9, 1)], "claim_id long, post_id long, ord int")
    sources = beats.beat_sources(ordered, cites)
    assert sorted((r.beat, r.n, r.post_id) for r in sources.collect()) == [("all", 1, 7), ("all", 2, 8), ("all", 3, 7), ("all", 4, 9), ("b", 1, 9)]
    marks = sources.groupBy("beat", "claim_id").agg(F.array_sort(F.collect_list("n")).alias("cite_ns"))
    clauses = ordered.join(marks, ["beat", "claim_id"], "left").select("beat", "position", F.when(F.col("anchor") != "R", F.col("anchor")).alias("place_name"), F.col("kind").alias("text"), "cite_ns")
    assert {(r.beat, r.clauses, r.prose) for r in beats.render_beats(clauses, ["beat"]).collect()} == {("all", 6, "En A, k0[1][2]; k3[3]; k2[4]. En B, k1; k5. K4."), ("b", 3, "En B, k1; k2[1]; k5.")}


def test_people_of_a_claim_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BESIDE_BLOCK", 4)
    rng = random.Random(5)
    rows = [(c, p) for c, n in ((1, 60), (2, 5), (3, 1), (4, 30)) for p in rng.sample(range(80), n)]
    rows += [*rows[:9], (None, 1), (5, None), (5, 2), (6, 90), (6, 91)]
    of = defaultdict(set)
    for c, p in rows:
        if c is not None and p is not None:
            of[c].add(p)
    want = defaultdict(int)
    for people in of.values():
        for a in people:
            for b in people - {a}:
                want[a, b] += 1
    table = spark.createDataFrame(rows, "claim_id int, person_id int").withColumn("other", F.lit(1))
    got = [tuple(r) for r in duplicates.beside_pairs(table).collect()]
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    assert {r.person: r.others for r in duplicates.beside(table).collect()} == {a: sorted(b for x, b in want if x == a) for a, _ in want}
    assert duplicates.beside_pairs(table.limit(0)).collect() == []


def test_misses_are_rows(spark):
    rulings = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "a", None), (5, "a", "y")], "claim_id int, verdict string, stratum string")
    verdicts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (9, "a")], "claim_id int, verdict string")
    totals, misses = curation.score_adjudicated(rulings, verdicts, ["stratum"])
    assert {tuple(r) for r in totals.collect()} == {("x", 3, 1), (None, 1, 1), ("y", 1, 0)}
    assert {tuple(r) for r in misses.collect()} == {("x", 2, "b", "a"), ("x", 3, None, "a"), ("y", 5, "a", None)}


def test_note_language_counts_markers(spark):
    texts = spark.createDataFrame([("the claim says it was not in the post",), ("el reclamo dice que no está en la publicación",), ("",)], "t string")
    assert [r.l for r in texts.select(T.note_language(F.col("t")).alias("l")).collect()] == ["en", "es", "es"]


def test_first_query_sends_the_earliest_on(spark, tmp_path):
    """Rows are thinned where they are read; ties of time go to the lesser id, and later batches may bring earlier rows."""
    from testimony.streaming import streams

    path, rows = str(tmp_path / "in"), [(i, i % 3, f"q{i}", 50 - i // 6) for i in range(60)]
    spark.createDataFrame(rows, "i long, post int, q string, s long").selectExpr("i", "post", "q", "timestamp_seconds(s) as at").repartition(3, "i").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    told = streams.stream_first_query(stream, "at", "post", "q", "i")
    assert "MapInPandas" in told._jdf.queryExecution().logical().toString()
    best = {}
    for r in sorted(streams.settle_stream(told).collect(), key=lambda r: r.version):
        best[r.post] = r.query
    assert best == {str(p): min((s, i, q) for i, post, q, s in rows if post == p)[2] for p in range(3)}
