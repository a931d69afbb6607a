"""The pipeline's stages on a small corpus, each against what it must do to its own input."""

from collections import Counter

import corpus_pipeline
from testimony.llm import decontamination, quality
from tests.llm.test_llm import exact_components, fill, shingles, words

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 5"))
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == columns
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        seen.append((docs, out))
        docs = out
    before, after = seen[1]
    assert after.groupBy("doc_id").count().where("count > 1").isEmpty() and after.groupBy("text").count().where("count > 1").isEmpty()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = set().union(*(decontamination.windows_of(t, 10) for t in items))
    hit = {r.doc_id for r in seen[2][0].collect() if decontamination.windows_of(r.text, 10) & known}
    assert {r.doc_id for r in seen[2][1].collect()} == {r.doc_id for r in seen[2][0].collect()} - hit
    mixed = Counter(r.doc_id for r in seen[3][1].collect())
    assert max(mixed.values()) == 2
    last = seen[4][1].collect()
    assert Counter(r.doc_id for r in last) == mixed and {r.shard for r in last} <= set(range(24))


ODD = [
    (1, None, "a"), (2, "", "a"), (3, "one", None), (4, "two words", "a"), (4, "two words", "a"), (None, "x " * 40, "b"), (5, "long " * 9000, "b"),
    (6, "Long " * 9000, "b"), (None, None, None), (None, None, None), (7, "one", "c"), (7, "one", "c"), (7, "other", "c"),
]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _q_predicted int, _d_contaminated boolean, _m_id long, _m_copies int, _go_id long, _own_key long, _found0 int, shard int, node long"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, True, 7, 7, 7, 7, 7, 7, 7) for i, t, s in rows], CLASHING)


def kinds(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and long texts, repeated rows and clashing names, and no rows at all, through each stage."""
    stages, given, table = dict(corpus_pipeline.STAGES), kinds(odd(spark, ODD).collect()), odd(spark, ODD)
    for stage in stages.values():
        assert stage(spark, table.limit(0), SF).collect() == []
    good = stages["quality"](spark, table, SF).collect()
    judged = quality.score_quality(table, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert kinds(good) == kinds(r for r in judged if r.predicted == 1)
    once = stages["near_duplicates"](spark, table, SF).collect()
    assert kinds(once) == Counter({(1, None): 1, (2, ""): 1, (None, None): 2, (3, "one"): 1, (4, "two words"): 1, (None, "x " * 40): 1, (5, "long " * 9000): 1, (7, "other"): 1})
    clean = stages["decontamination"](spark, table, SF).collect()
    assert kinds(clean) == given
    for rows in (good, once, clean):
        assert all(tuple(r)[4:] == (None, 7, True, 7, 7, 7, 7, 7, 7, 7) for r in rows)
    mix = stages["mixing"](spark, table, SF)
    assert mix.columns == table.columns and set(kinds(mix.collect())) <= set(given) and all(n <= 2 * given[k] for k, n in kinds(mix.collect()).items())
    shards = stages["sharding"](spark, table, SF).collect()
    assert Counter(r.doc_id for r in shards) == Counter(i for i, _, _ in ODD) and len({(r.shard, r.slot) for r in shards}) == len(ODD)


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()}
    sets = {r.doc_id: shingles(r.text, 5) for r in docs.collect()}
    component = exact_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
    assert got == {i for i, c in component.items() if i == c}


def test_mixing_takes_each_sources_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in docs.collect():
        sizes[r.source] += size[r.doc_id]
    for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF).collect():
        taken[r.source] += size[r.doc_id]
    want = fill(sizes, 1.5, 2.0)
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in sizes)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_mixing_shares_copies_among_repeated_rows(spark):
    """Rows of one id, source and text that differ elsewhere: equal parts, and what is left one each."""
    text = "one two three"
    rows = [(1, text, "en", "a", i) for i in range(3)] + [(1, text, "xx", "a", 7)] * 2 + [(2, "four five", "en", "b", 1)] * 3 + [(3, "six", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from testimony.llm import mixing

    planned = Counter()
    for r in mixing.mix_sources(docs).collect():
        planned[r.doc_id] += r.copies
    got = Counter(tuple(r) for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF).collect())
    given = Counter(rows)
    assert Counter({i: sum(n for r, n in got.items() if r[0] == i) for i in planned}) == planned
    for i, n in planned.items():
        k = sum(c for r, c in given.items() if r[0] == i)
        for r, c in given.items():
            if r[0] == i:
                assert c * (n // k) <= got[r] <= c * (n // k + 1)
