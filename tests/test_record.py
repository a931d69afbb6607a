"""The record's functions on named cases, and its registered queries' shape."""

import pytest
from pyspark.sql import functions as F

from testimony.functions import similarity as S
from testimony.functions import text as T
from testimony.operators import duplicates, graphs, trees


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.fold, "  La   Guaira ", "la guaira"),
        (T.fold, "Maiquetía", "maiquetia"),
        (T.marks, "Residencia Caraballeda I", ["1"]),
        (T.marks, "El Palmar Este", ["este"]),
        (T.marks, "Residencias Coral Bella", []),
        (T.marks, "Edificio Opp27", ["27"]),
        (T.reduce_name, "Avenida La Costanera", "la costanera"),
        (T.reduce_name, "Torre II", "2"),
        (T.phonetic_es, "Belkys", "belkis"),
        (T.operator_count, 'Palmar (Caraballeda OR "La Guaira") since_time:1 until_time:2 queryType=Latest', 6),
        (T.parse_confidence, "0.8 or so", 0.8),
        (T.parse_confidence, "high", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_handles(spark):
    rows = {"Aaron Levi Cantillo Vargas": ("Aaron C.", None), "Yaneth Tejera": ("Yaneth T.", None), "Aaron": (None, "too_few_tokens"), "María de la Cruz": (None, "has_particle"), None: (None, "not_a_string")}
    for name, want in rows.items():
        got = one(spark, name, T.derive_handle)
        assert (got["handle"], got["reason"]) == want


def test_query_text(spark):
    row = spark.range(1).select(
        T.query_text(F.array(F.lit("Caraballeda")), F.array().cast("array<string>"), F.array().cast("array<string>"), F.timestamp_seconds(F.lit(1782338400)), F.timestamp_seconds(F.lit(1782339000)), F.lit("latest")).alias("q")
    ).first()
    assert row.q == "Caraballeda since_time:1782338400 until_time:1782339000 queryType=Latest"


def test_contradicting_marks(spark):
    row = spark.range(1).select(T.marks_contradict(F.lit("Celta Mar II"), F.lit("Celta Mar 1")).alias("a"), T.marks_contradict(F.lit("Albatros"), F.lit("Albatros 2")).alias("b")).first()
    assert row.a and not row.b


def test_jaro():
    assert S.jaro_of("", "") == 1.0 and S.jaro_of("a", "") == 0.0
    assert round(S.jaro_of("el palmar este", "el palmar oeste"), 3) == 0.978


def test_place_names_pair_up(spark):
    names = ["La Costanera", "Avenida La Costanera", "Cueva de Uría", "Cueva de Urie", "El Palmar Este", "El Palmar Oeste", "Torre II", "Torres 2", "Residencias Caraballeda", "Residencia Caraballeda I"]
    got = {(r.a, r.b) for r in duplicates.name_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got == {("Avenida La Costanera", "La Costanera"), ("Cueva de Urie", "Cueva de Uría"), ("Torre II", "Torres 2")}


def test_neighbourhoods_drop_inner_sets(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert {tuple(r.members) for r in graphs.neighbourhoods(pairs).collect()} == {(1, 2, 3), (5, 6)}
    assert {tuple(r.members) for r in graphs.pair_groups(pairs).collect()} == {(1, 2, 3), (5, 6)}


def test_redirects(spark):
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 4)], "id long, next_id long")
    got = {r.id: (r.final, r.loops) for r in trees.follow_redirects(rows).collect()}
    assert got[1] == got[2] == got[3] == (3, False) and got[4][1] and got[5][1] and got[6][1]


def test_queries_run_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_redirects_of_any_length_and_loops(spark):
    chain = [(i, i + 1) for i in range(1000)] + [(1000, None)]
    loop = [(2000 + i, 2000 + (i + 1) % 200) for i in range(200)] + [(3000, 2005), (3001, 3000)]
    odd = [(4000, 4000), (4001, 9999)]
    got = {r.id: (r.final, r.loops) for r in trees.follow_redirects(spark.createDataFrame(chain + loop + odd, "id long, next_id long")).collect()}
    assert all(got[i] == (1000, False) for i in range(1001))
    assert all(got[i][1] for i in [*range(2000, 2200), 3000, 3001, 4000]) and got[4001] == (9999, False)
    assert trees.follow_redirects(spark.createDataFrame([], "id long, next_id long")).count() == 0


def test_alike_finds_every_pair_that_plain_jaro_does(spark):
    import random

    dice = random.Random(3)
    names = ["".join(dice.choice("abcdeé ñ") for _ in range(dice.randint(0, 14))) for _ in range(250)]
    names += [w[:3] + "z" + w[4:] for w in names] + ["", "a", "ab", "ba"]
    names = sorted(set(names))
    pairs = [(x, y) for x in names for y in names]
    score = [S.jaro_of(x, y) for x, y in pairs]
    assert S.jaro_pairs([x for x, _ in pairs], [y for _, y in pairs]).tolist() == score
    table = spark.createDataFrame([(w,) for w in [*names, None]], "a string")
    for least in (0.8, 0.92):
        got = {(r.a, r.b) for r in S.alike(table, table.withColumnRenamed("a", "b"), least).collect()}
        assert got == {p for p, s in zip(pairs, score) if s >= least}


def test_places_of_unknown_type_count_and_types_are_folded(spark):
    claims = spark.createDataFrame([(i, 1, "derrumbe", "torre", at, i) for i, at in ((1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-01"), (4, "2024-01-02"))], "id long, event_id long, kind string, subject string, first_seen_at string, inserted_at long")
    claims = claims.withColumn("first_seen_at", F.to_timestamp("first_seen_at"))
    at = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 8)], "claim_id long, place_id long")
    places = spark.createDataFrame([(7, None), (8, "PAÍS")], "id long, type string")
    people = spark.createDataFrame([], "claim_id long, name string")
    assert [(r.elder_id, r.younger_id) for r in duplicates.duplicate_claims(claims, at, places, people).collect()] == [(1, 2)]


def test_names_are_explained_by_places_and_figures(spark):
    from testimony.operators import names

    texts = spark.createDataFrame([(1, 1, "Vi a Pedro Roca Park"), (2, 1, "Los Corales Norte y Ana Paz"), (3, 2, "Roca Park"), (4, 1, None), (5, 1, "El Hospital Vargas Luna"), (6, None, "Ana Paz")], "id long, event_id long, text string")
    places = spark.createDataFrame([(1, 1, "Roca Park", "active"), (2, 1, "Urbanización Los Corales Norte", "active"), (3, 1, "Ana Paz", "proposed"), (4, 1, " ", "active")], "id long, event_id long, canonical_name string, lifecycle string")
    surface = spark.createDataFrame([(1, "Hospital Vargas")], "place_id long, name string")
    known = names.gazetteer_names(places, surface)
    got = {(r.id, r.name) for r in names.unexplained_names(texts, known).collect()}
    assert got == {(2, "Ana Paz"), (3, "Roca Park")}
    assert {(r.id, r.name) for r in names.unexplained_names(texts, known, ["ANA PAZ"]).collect()} == {(3, "Roca Park")}
    assert names.unexplained_names(texts.limit(0), known).count() == 0


def test_closure_of_deep_trees_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)] + [(900, 17), (901, 5555)], "id long, parent_id long")
    got = {(r.ancestor, r.descendant): r.depth for r in trees.tree_closure(chain).collect()}
    want = {(a, d): d - a for d in range(300) for a in range(d + 1)} | {(a, 900): 18 - a for a in range(18)} | {(900, 900): 0, (901, 901): 0}
    assert got == want
    with pytest.raises(ValueError):
        trees.tree_closure(spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)] + [(200, 3)], "id long, parent_id long")).count()


def test_late_rows_are_kept_and_their_slices_counted_again(spark, tmp_path):
    import os

    from testimony.streaming import streams

    at = lambda minutes: f"2024-01-01 {minutes // 60:02d}:{minutes % 60:02d}:00"
    batches = [[(1, 0), (2, 60), (3, 61)], [(4, 55), (5, 12), (6, 70)], [(7, 13), (8, 75)]]
    source = str(tmp_path / "in")
    os.makedirs(source)
    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, at(m)) for i, m in rows], "id long, at string").selectExpr("id", "cast(at as timestamp) as at").coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        part = next(f for f in os.listdir(tmp_path / f"b{n}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"b{n}" / part, os.path.join(source, f"{n}.parquet"))
        os.utime(os.path.join(source, f"{n}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))
    rows = spark.readStream.schema("id long, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    keep, late = str(tmp_path / "keep"), str(tmp_path / "late")
    streams.late_posts(rows, "at", keep, late)
    kept, found = spark.read.parquet(keep), spark.read.parquet(late)
    assert {r.id for r in kept.collect()} == set(range(1, 9)) and {r.id for r in found.collect()} == {5, 7}
    again = streams.recounted_slices(kept, found, "at", 600, at(0)).selectExpr("cast(slice_start as string) as s", "n").collect()
    assert [(r.s, r.n) for r in again] == [(at(10), 2)]
