"""Pairs of persons and places by classes of names: large classes, nulls, and no pair of theirs is shuffled."""

from itertools import product

from testimony.functions import similarity as S
from testimony.operators import duplicates, trees


def _after_last_shuffle(df):
    """The physical plan above its uppermost exchange."""
    return df._jdf.queryExecution().sparkPlan().toString().split("RepartitionBy")[0].split("Exchange")[0]


def test_class_pairs_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CLASS_BLOCK", 7)
    members = spark.createDataFrame([(1, "p", i) for i in range(60)] + [(1, "q", 100 + i) for i in range(3)] + [(2, "q", 200), (None, "p", 300)], "e int, c string, v long")
    links = spark.createDataFrame([(1, "p", "p", 1.0), (1, "p", "q", 0.9), (2, "q", "q", 1.0), (3, "p", "q", 0.9)], "e int, c string, d string, score double")
    got = [tuple(r) for r in duplicates.class_pairs(members, links, ["e"]).collect()]
    want = [(1, x, y, 1.0) for x, y in product(range(60), range(60))] + [(1, x, 100 + y, 0.9) for x, y in product(range(60), range(3))] + [(2, 200, 200, 1.0)]
    assert sorted(got) == sorted(want)
    assert duplicates.class_pairs(members.limit(0), links, ["e"]).collect() == []


def test_name_edges_meet_as_classes(spark):
    names = ["Ana Mata", "Ana Matta", "Mata Ana", "Ana Luz Mata", "Ana", None, "Rosa Gil", ""]
    people = [(i, i % 2 + 1 if i else None, names[i % len(names)]) for i in range(80)]
    edges = duplicates.person_name_edges(spark.createDataFrame(people, "id long, event_id int, full_name string"))
    assert "Join" not in _after_last_shuffle(edges) and "Generate" in _after_last_shuffle(edges)
    words = {n: (n or "").lower().replace("tt", "t").split() for n in names}
    recall = lambda u, v: sum(max(S.jaro_of(x, y) for y in v) for x in u) / len(u)
    want = {}
    for (i, e, m), (j, f, n) in product(people, people):
        u, v = words[m], words[n]
        if e == f and e and i < j and min(len(u), len(v)) > 1:
            score = recall(u, v) if len(u) <= len(v) else recall(v, u)
            if score >= duplicates.PERSON_BAR:
                want[i, j] = round(score, 9)
    got = edges.collect()
    assert {(r.a, r.b): round(r.score, 9) for r in got} == want and len(got) == len(want) > 100


def test_places_meet_as_classes(spark):
    # 1 is above 11, 11 above 111; 2 stands beside; insertion times are null, equal and different, kinds known and unknown.
    rows = [(1, None, "La Quebrada", "calle", 5), (11, 1, "La Quebradas", None, 1), (111, 11, "La Quebradaz", None, None), (2, None, "La  Quebrada", "barrio", 5), (3, None, "la quebrada", None, None), (4, None, "Otro", None, 0)]
    places = spark.createDataFrame([(i, up, "e", n, t, at, "active") for i, up, n, t, at in rows], "id long, parent_id long, event_id string, name string, type string, inserted_at int, lifecycle string")
    found = duplicates.duplicate_places(places, trees.tree_closure(places))
    over = {(1, 11), (1, 111), (11, 111)}
    age = lambda r: (r[4] is not None, r[4] or 0, r[0])
    want = {(y[0], x[0]) for x, y in product(rows[:5], rows[:5]) if age(x) < age(y) and tuple(sorted((x[0], y[0]))) not in over and {x[3], y[3]} != {"calle", "barrio"}}
    assert {(r.place_id, r.other_id) for r in found.where("certainty = 'candidate'").collect()} == want and len(want) == 6
    assert "left_anti" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftanti", "left_anti")


def test_claims_meet_as_classes(spark):
    from datetime import datetime

    # Claims of two events with the same marks and subject; people who are one, another, or not named, and null names.
    who = [["Ana"], ["Luis"], [], ["Ana", "Eva"], [None]]
    rows = [(i, i % 2, "Incendio", "Casa 4" if i % 3 else "casa 4", datetime(2024, 1, 1 + i % 5), None) for i in range(40)]
    claims = spark.createDataFrame(rows, "id long, event_id int, kind string, subject string, first_seen_at timestamp, inserted_at timestamp")
    people = spark.createDataFrame([(i, n) for i in range(40) for n in who[i % 5]], "claim_id long, name string")
    none = spark.createDataFrame([], "claim_id long, place_id long")
    found = duplicates.duplicate_claims(claims, none, none.select(none.place_id.alias("id"), none.place_id.cast("string").alias("type")), people)
    same = lambda a, b: not a or not b or bool({x for x in a if x} & {x for x in b if x})
    want = {(x[0], y[0]) for x, y in product(rows, rows) if x[1] == y[1] and (x[4], x[0]) < (y[4], y[0]) and same(who[x[0] % 5], who[y[0] % 5])}
    got = found.collect()
    assert {(r.elder_id, r.younger_id) for r in got} == want and len(got) == len(want) > 100
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan.split("Union")[1].split("Exchange")[0].split("RepartitionBy")[0].split("Scan")[0]


def test_position_residue_makes_no_pair(spark):
    names = ["Ana Mata", "Ana Matta", "Luz Gil", "Rosa", None, "Eva Sol"]
    people = spark.createDataFrame([(i, names[i % 5] if i < 50 else "Eva Sol") for i in range(51)], "id long, full_name string")
    blocks = spark.createDataFrame([(i % 2, i) for i in range(51)], "block int, id long")
    settled, residue = duplicates.position_blocks(blocks, people)
    paired = {(r.block, i) for r in settled.collect() for i in (r.a, r.b)}
    want = {(i % 2, i) for i in range(51)} - paired
    alone = duplicates.position_residue(blocks, people)
    assert {(r.block, r.id) for r in residue.collect()} == {(r.block, r.id) for r in alone.collect()} == want and (0, 50) in want
    assert "explode" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_grow_with_rows(spark, monkeypatch):
    """What one task holds does not grow with the tables, though shuffle partitions stay."""
    monkeypatch.setattr(duplicates, "_BESIDE_A_TASK", 100)
    monkeypatch.setattr(trees, "_ROWS_A_TASK", 20)
    named = spark.createDataFrame([(i // 5, i % 37) for i in range(1000)], "claim_id long, person_id long")
    of = {}
    for i in range(1000):
        of.setdefault(i // 5, set()).add(i % 37)
    want = {(a, b) for c in of.values() for a in c for b in c if a != b}
    pairs = duplicates.beside_pairs(named)
    assert {(r.person, r.other) for r in pairs.collect()} == want and pairs.rdd.getNumPartitions() == 50
    assert {r.person: r.others for r in duplicates.beside(named).collect()} == {a: sorted(b for x, b in want if x == a) for a, _ in want}
    nodes = spark.range(200).selectExpr("id", "case when id >= 10 then id div 10 end as parent_id")
    moves = spark.range(200).selectExpr("id", "id * 3 % 200 as new_parent_id")
    guarded = trees.cycle_guard(moves, trees.tree_closure(nodes))
    over = lambda a, d: a == d or (d >= 10 and over(a, d // 10))
    assert {(r.id, r.refused) for r in guarded.collect()} == {(i, over(i, i * 3 % 200)) for i in range(200)} and guarded.rdd.getNumPartitions() > 4


def test_one_position_of_many_lists_is_divided(spark):
    ids = spark.range(4000).selectExpr("array(named_struct('k', id, 'c', 1)) as ids")
    rows = spark.range(4000).selectExpr("named_struct('k', id, 'c', 1) as id", "id as v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = trees.order_by_ids(rows, ids).rdd.glom().map(len).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(parts) == 4000 and max(parts) < 2500


def test_ordered_pairs_are_left_out_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CLASS_BLOCK", 7)
    members = spark.createDataFrame([(1, "p", i) for i in range(60)] + [(1, "q", 30 + i) for i in range(3)], "e int, c string, v long")
    links = spark.createDataFrame([(1, "p", "p", 1.0), (1, "p", "q", 0.9), (1, "q", "p", 0.9)], "e int, c string, d string, score double")
    got = [(r.x, r.y, r.score) for r in duplicates.class_pairs(members, links, ["e"], ordered=True).collect()]
    p, q = range(60), range(30, 33)
    want = [(x, y, 1.0) for x, y in product(p, p) if x < y] + [(x, y, 0.9) for a, b in ((p, q), (q, p)) for x, y in product(a, b) if x < y]
    assert sorted(got) == sorted(want)


def test_places_of_two_kinds_are_no_pair(spark, monkeypatch):
    """Links are between names with kinds: none joins two known kinds, so what is refused is never made."""
    asked, made = [], duplicates.class_pairs
    monkeypatch.setattr(duplicates, "class_pairs", lambda members, links, by, **more: asked.append(links) or made(members, links, by, **more))
    kinds = ["calle", "barrio", None, "avenida"]
    rows = [(i, None, "e", "La Quebrada", kinds[i % 4], i % 3, "active") for i in range(40)]
    places = spark.createDataFrame(rows, "id long, parent_id long, event_id string, name string, type string, inserted_at int, lifecycle string")
    found = {(r.place_id, r.other_id) for r in duplicates.duplicate_places(places, trees.tree_closure(places), digits=6).collect()}
    kind = {"calle": 1, "avenida": 1, "barrio": 2, None: 0}
    one = lambda x, y: kind[x[4]] == kind[y[4]] or 0 in (kind[x[4]], kind[y[4]])
    assert found == {(y[0], x[0]) for x, y in product(rows, rows) if (x[5], x[0]) < (y[5], y[0]) and one(x, y)}
    links = asked[0].collect()
    assert len(links) == 7 and all(r.c.k == r.d.k or r.c.none or r.d.none for r in links)


def test_context_edges_of_places_of_many(spark, monkeypatch):
    """Persons meet at their places with their times, few or many of them: pairs are no longer joined with lists of times."""
    from datetime import datetime, timedelta

    names = ["Rosa Gil", "Rosas Mata", "Gil Rosa", "Eva Sol", "Ana Gil", None]
    people = [(i, i % 2, i % 3, names[i % 6]) for i in range(60)]
    start = datetime(2024, 1, 1)
    rows = [(i, c, start + timedelta(hours=c * 13 % 24000)) for i in range(60) for c in (i * 7 % 90, i * i % 90)]
    at = [(c, c % 4) for c in range(90) if c % 9]
    persons = spark.createDataFrame(people, "id long, event_id int, inserted_at int, full_name string")
    arcs, places = spark.createDataFrame(rows, "person_id long, claim_id int, at timestamp"), spark.createDataFrame(at, "claim_id int, place_id int")
    where, when = {}, {}
    for i, c, t in rows:
        when.setdefault(i, set()).add(t)
        where.setdefault(i, set()).update(p for q, p in at if q == c)
    words = lambda n: (n or "").lower().split()
    like = lambda m, n: any(len(u) >= 4 and S.jaro_of(u, v) >= 0.86 for u in words(m) for v in words(n))
    near = lambda i, j: any(abs((s - t).total_seconds()) < 25 * 3600 for s in when[i] for t in when[j])
    want = {(x[0], y[0]) for x, y in product(people, people) if x[1] == y[1] and (x[2], x[0]) < (y[2], y[0]) and where[x[0]] & where[y[0]] and like(x[3], y[3]) and near(x[0], y[0])}
    for most in (512, 3):
        monkeypatch.setattr(duplicates, "PLACE_PEOPLE", most)
        found = duplicates.person_context_edges(persons, arcs, places)
        got = [tuple(r) for r in found.collect()]
        assert set(got) == want and len(got) == len(want) > 5


def test_neighbourhoods_are_intervals(spark, monkeypatch):
    """Neighbourhoods by name are intervals of classes, so no name edge is made; names that recall one another one way alone, of one word, and null too."""
    import random
    from datetime import datetime, timedelta

    names = ["red rod", "red anvil", "hot rod", "Red  Rod", "red", "large bolt", "larje bolt", None, "hot red rod"]
    rng = random.Random(5)
    people = [(i, rng.choice([1, 1, 2, None]), names[rng.randrange(9)], i % 3, 1 if i % 11 == 0 else None) for i in range(150)]
    start = datetime(2024, 1, 1)
    arcs = [(rng.randrange(150), c, start + timedelta(hours=rng.randrange(2000))) for c in range(500)]
    persons = spark.createDataFrame(people, "id long, event_id int, full_name string, inserted_at int, merged_into_id int")
    told, places = spark.createDataFrame(arcs, "person_id long, claim_id int, at timestamp"), spark.createDataFrame([(c, rng.randrange(90)) for c in range(500)], "claim_id int, place_id int")
    live = persons.where("merged_into_id is null")
    edges = {(r.a, r.b) for r in duplicates.person_name_edges(live).collect()} | {(r.a, r.b) for r in duplicates.person_context_edges(live, told, places).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    sets = {frozenset(s) for s in near.values()}
    large = [s for s in sets if not any(s < x for x in sets)]
    of = {s: min(i for i in near if near[i] == s) for s in large}
    name = {i: n for i, _, n, _, _ in people}
    want = {(of[s], len(s), tuple(sorted((name[i], i) for i in s))) for s in large}

    def refused(*_, **__):
        raise AssertionError("name edges are made")

    monkeypatch.setattr(duplicates, "person_name_edges", refused)
    monkeypatch.setattr(duplicates, "_PAIRS_A_TASK", 200)
    monkeypatch.setattr(duplicates.intervals, "SET_BLOCK", 8)
    monkeypatch.setattr(duplicates.intervals, "_MEMBERS_AT_ONCE", 50)
    got = duplicates.duplicate_persons(persons, told, places).collect()
    assert {(r.block, r.size, tuple(tuple(m) for m in r.members)) for r in got} == want and len(got) == len(want) > 3
    assert [r.place for r in sorted(got, key=lambda r: (-r.size, r.block))] == list(range(1, len(got) + 1))
    assert any(s < x for s in sets for x in sets)
