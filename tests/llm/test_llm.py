"""The ten operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from testimony.llm import decontamination, embeddings, licences, minhash, mixing, queries, quality, sharding, substrings, urls, warc
from testimony.llm.common import ROWS_AT_ONCE, components, hashed_words, map_slices

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, target double, node string"


def words(text):
    return (text or "").encode().split()


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, "en", s, None, 7, 7, 7.0, "x") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "two words", "a"), (4, "two words", "a"), (None, "x " * 40, "b"), (5, "long " * 9000, "b"), (None, None, None)]
OPERATORS = {
    "mix": mixing.mix_sources,
    "repeats": substrings.remove_repeats,
    "shard": sharding.shard,
    "near": minhash.near_duplicates,
    "licences": licences.scan_licences,
    "decontaminate": lambda d: decontamination.decontaminate(d, d.sparkSession.createDataFrame([(1, "two words"), (2, None)], "item_id long, text string")),
    "quality": lambda d: quality.score_quality(d, d.sparkSession.createDataFrame([(4, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")),
}


@pytest.fixture(scope="module")
def odd(spark):
    """All operators' rows on odd rows, collected with every column, and on no rows."""
    got = {name: f(frame(spark, ODD)).collect() for name, f in OPERATORS.items()}
    assert all(f(frame(spark, ODD).limit(0)).collect() == [] for f in OPERATORS.values())
    return got


def by_id(rows, *names):
    return Counter((r.doc_id, *(r[n] for n in names)) for r in rows)


def test_odd_rows_mix(odd):
    rows = odd["mix"]
    want = {(1, 0, 0), (2, 0, 0), (3, 1, 2), (4, 2, 4), (None, 0, 0)}
    assert want <= {(r.doc_id, r.size, r.taken) for r in rows} and by_id(rows, "size")[4, 2] == 2
    assert {(r.source, r.source_size, r.target) for r in rows} == {("a", 4, 8.0), ("b", 9040, 13557.5), (None, 1, 2.0)}
    assert sum(r.taken for r in rows if r.source == "b") == 13558


def test_odd_rows_repeats(odd):
    empty, sha = hashlib.sha256(b"").hexdigest(), lambda t: hashlib.sha256(t).hexdigest()
    assert by_id(odd["repeats"], "n_words", "n_removed", "kept_sha256") == Counter({
        (1, 0, 0, empty): 1, (2, 0, 0, empty): 1, (None, 0, 0, empty): 1, (3, 1, 0, sha(b"one")): 1, (4, 2, 0, sha(b"two words")): 2,
        (None, 40, 39, sha(b"x")): 1, (5, 9000, 8999, sha(b"long")): 1,
    })


def test_odd_rows_shard(odd):
    rows = odd["shard"]
    assert by_id(rows, "size") == Counter({(1, 8): 1, (2, 8): 1, (None, 8): 1, (3, 11): 1, (4, 17): 2, (None, 88): 1, (5, 45_008): 1})
    shards, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and r.text_crc32 == zlib.crc32({1: b"", 2: b"", 3: b"one", 4: b"two words"}.get(r.doc_id, r.text_crc32.to_bytes(4, "big"))) or r.doc_id in (None, 5)
        shards[r.text_key].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_odd_rows_near(odd):
    assert by_id(odd["near"], "n_shingles", "component_id", "kept") == Counter({
        (1, 0, 1, True): 1, (2, 0, 2, True): 1, (3, 1, 3, True): 1, (4, 1, 4, True): 2, (5, 1, 5, True): 1, (None, 1, None, None): 1, (None, 0, None, None): 1,
    })


def test_odd_rows_licences(odd):
    assert all((r.licences, r.n_lines, r.best) == ([], 0, None) for r in odd["licences"]) and len(odd["licences"]) == len(ODD)


def test_odd_rows_decontaminate(odd):
    rows, none = odd["decontaminate"], hashlib.sha256(b"").hexdigest()
    assert by_id(rows, "n_words", "n_hit", "items_sha256", "contaminated") == Counter({
        (1, 0, 0, none, False): 1, (2, 0, 0, none, False): 1, (None, 0, 0, none, False): 1, (3, 1, 0, none, False): 1,
        (4, 2, 2, hashlib.sha256(b"1").hexdigest(), True): 2, (None, 40, 0, none, False): 1, (5, 9000, 0, none, False): 1,
    })
    assert all((r.lang, r.size, r.node) == ("en", 7, "x") for r in rows)


def test_odd_rows_quality(odd):
    rows = odd["quality"]
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert len({(r.text, round(r.score, 5)) for r in rows}) == len({r.text for r in rows}) and all((r.size, r.node) == (7, "x") for r in rows)


def test_word_hashes():
    texts = [b"a bb  A", b"", b" \t", b"bb\x0ba"]
    h, ends = hashed_words(texts)
    assert ends.tolist() == [3, 3, 3, 5] and h[0] == h[4] and h[1] == h[3] and h[0] != h[2]
    folded, _ = hashed_words(texts, fold=True)
    assert folded[0] == folded[2]


def test_texts_go_to_workers_in_slices(spark):
    """Whatever the session's batches: few rows at once, whole numbers beyond 2^53 beside nulls, empty tables."""

    def sized(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": pdf["text"], "rows": len(pdf), "ids": [[1, 2]] * len(pdf)})

    schema = "id long, text string, rows int, ids array<long>"
    far = (1 << 62) + 1
    rows = [(far + i if i % 3 else None, None if i % 5 == 0 else "é" * (i % 7)) for i in range(3 * ROWS_AT_ONCE + 1)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = map_slices(docs, sized, schema).collect()
    assert [(r.id, r.text) for r in got] == rows
    assert max(r.rows for r in got) <= ROWS_AT_ONCE and all(r.ids == [1, 2] for r in got)
    assert map_slices(docs.where("false"), sized, schema).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10] + [(100, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got[9] == got[1] == got[100] == 1 and got[20] == 11 and got[40] == 31


def fill(sizes, share, epochs):
    """Targets by resharing until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        level = rest / (sum(w[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and level * w[s] >= epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = fill(sizes, 1.5, 2.0)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_targets_of_odd_sizes(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 3}, {"x": 0, "y": 8}, {"a": 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(fill(sizes, 1.5, 2.0))


def test_sharding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs, shards=24).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data)) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
        of[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())


def plain_best_fit(sizes, capacity):
    """One size after the other into the fullest bin with room; equal bins by their number."""
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(left) if r >= s]
        if fit:
            left[min(fit)[1]] -= s
        else:
            left.append(max(capacity, s) - s)
    return left


@pytest.mark.parametrize("seed", range(6))
def test_packing_by_classes_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40 + 30 * seed, 300).tolist() + [500]
    items = sorted(Counter(sizes).items(), reverse=True)
    for capacity in (100 + 40 * seed, 1000):
        bins, used = sharding.best_fit_decreasing(items, capacity)
        full = Counter()
        for (size, n), own in zip(items, bins):
            assert sum(k for _, k in own) == n
            for at, k in own:
                full[at] += size * k
        left = plain_best_fit(sizes, capacity)
        assert used == len(left) and sorted(max(capacity, full[b]) - full[b] for b in full) == sorted(left)


def test_packing():
    rng = np.random.default_rng(1)
    items = [*Counter(rng.integers(1, 50, 3000).tolist()).items(), (9000, 1)]
    total, placed = Counter(), Counter()
    for size, own in sharding.pack(items, 24).items():
        for at, k in own:
            total[at] += size * k
            placed[size] += k
    rest = [v for v in total.values() if v != 9000]
    assert placed == dict(items) and len(total) == 24 and max(rest) - min(rest) < 0.05 * max(rest)


def test_shards_are_near_equal_and_like_a_packing_of_all_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = Counter()
    for r in docs.collect():
        of[r.text] += len((r.text or "").encode()) + 8
    got = Counter()
    for r in sharding.shard(docs).collect():
        got[r.shard] += r.size
    largest = max(of.values())
    assert len(got) == 24 and max(got.values()) - min(got.values()) <= 0.01 * max(got.values())
    capacity = max(largest, math.ceil(sum(of.values()) / 24))
    while len(plain_best_fit(of.values(), capacity)) > 24:
        capacity += capacity // 1000
    assert max(got.values()) <= 1.003 * capacity
    few = Counter()
    for r in sharding.shard(docs, capacity=2 * largest).collect():
        few[r.shard] += r.size
    assert max(few.values()) <= 2 * largest and len(few) <= math.ceil(1.01 * len(plain_best_fit(of.values(), 2 * largest)))


def exact_components(sets, ok):
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if ok(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in sets}


def shingles(text, n):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = words(text and text)
    w = [x.translate(low) for x in w]
    m = min(n, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    near = [(10_000 + i, " ".join(f"w{j}" if (j + i) % (40 - i) else f"x{i}{j}" for j in range(200)), "s") for i in range(30)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string, s string").select("doc_id", "text"))
    sets = {r.doc_id: shingles(r.text, n) for r in table.collect()}
    want = exact_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
    for r in minhash.near_duplicates(table, shingle=n).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_large_groups_are_cut_into_blocks(spark, monkeypatch):
    for f in (minhash.in_blocks, minhash._links):
        monkeypatch.setattr(f, "__defaults__", (8,))
    rows = [(i, " ".join(["base"] * 0 + [f"w{j}" for j in range(60)] + [f"end{i}"]), "s") for i in range(100)]
    got = minhash.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert {r.component_id for r in got} == {0}


def test_minhash_open_members_of_large_groups_meet_all(spark, monkeypatch):
    """Chains of documents, each alike to its neighbours only, in a common family: the first member leaves most of it open."""
    for f in (minhash.in_blocks, minhash._links):
        monkeypatch.setattr(f, "__defaults__", (4,))
    rows = [(c * 100 + i, " ".join(f"c{c % 2}w{j}" for j in range(5 * i + c, 5 * i + 60 + c)), "s") for c in range(4) for i in range(14)]
    sets = {i: shingles(t, 2) for i, t, _ in rows}
    want = exact_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert got == want and len(set(want.values())) == 2


def test_shingle_numbers_are_exact():
    texts = [b"A b a B c", b"a b", b"", b"x", b"X", b"b a b c a b", " ".join(f"w{i % 700}" for i in range(9000)).encode()]
    for n in (1, 2, 5, 7):
        codes = minhash.shingle_codes(texts, n)
        sets = [shingles(t.decode(), n) for t in texts]
        assert [len(np.unique(c)) for c in codes] == [len(s) for s in sets]
        for i in range(len(texts)):
            for j in range(i):
                assert len(np.intersect1d(codes[i], codes[j])) == len(sets[i] & sets[j])


def test_short_sets_are_estimated_within_the_margin():
    """4 of 5, and 8 of 10 shared shingles: an estimate as low as the cut is as rare as five standard errors are."""
    rng, low, n = np.random.default_rng(12), 0, 200
    a, b = minhash._seeds(n)
    cut = 0.8 - 5 * np.sqrt(0.16 / n + 0.2 / 3 / n)
    for shared, own in ((4, 1), (8, 2)):
        for _ in range(1500):
            s = rng.integers(0, 1 << 63, shared + own, dtype=np.uint64)
            one, other = (np.frombuffer(minhash.pack(minhash.minima(x, a, b), 2), np.uint8) for x in (s, s[:shared]))
            low += minhash.agreement(one, other[None], 2, n)[0] < cut
    assert low == 0


def test_keep_first(spark):
    base = "a b c d e f g h i j"
    rows = [(3, base, "s"), (2, base, "s"), (2, base, "s"), (9, "other words here", "s"), (7, None, "s"), (7, None, "s"), (None, base, "s")]
    got = minhash.keep_first(frame(spark, rows))
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(2, base), (9, "other words here")]
    assert got.count() == 4 and got.columns == frame(spark, rows).columns


def test_agreement_is_corrected_for_chance():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 32, (2, 20_000), dtype=np.uint32)
    b[:14_000] = a[:14_000]
    one, other = (np.frombuffer(minhash.pack(x, 2), np.uint8) for x in (a, b))
    assert abs(minhash.agreement(one, other[None], 2, 20_000)[0] - 0.7) < 0.02


def test_substrings_repeats_inside_and_across(spark):
    rng = np.random.default_rng(4)
    w = [f"v{i}" for i in rng.integers(0, 1000, 400)]
    texts = {1: "q " * 60, 2: " ".join(w[:100]), 3: " ".join(["z"] + w[30:90] + ["y"] + w[10:40]), 4: " ".join(w[200:230] * 3), 5: None, 6: " ".join(w[:19]), 7: " ".join(w[:100])}
    seen, gone = set(), defaultdict(set)
    for d in sorted(texts):
        ws = words(texts[d])
        for p in range(len(ws) - 19):
            g = tuple(ws[p : p + 20])
            if g in seen:
                gone[d] |= set(range(p, p + 20))
            seen.add(g)
    for r in substrings.remove_repeats(frame(spark, [(d, t, "s") for d, t in texts.items()]), bitmap_bits=16).collect():
        ws = words(texts[r.doc_id])
        kept = [x for i, x in enumerate(ws) if i not in gone[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(ws), len(gone[r.doc_id]), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_substrings_under_a_hot_half(spark):
    """A phrase in all documents with other words around it: its windows meet by their own hashes, with the results of brute force."""
    rng = np.random.default_rng(8)
    phrase, other = [f"p{i}" for i in range(14)], [" ".join(f"o{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(300)]
    texts = {d: " ".join([other[d], *phrase, other[(d * 7 + 1) % 40 if d % 3 == 0 else 299 - d]]) for d in range(250)}
    texts |= {d: " ".join([other[d % 20], *phrase, other[d % 5]] * 2) for d in range(250, 280)}
    seen, gone = set(), defaultdict(set)
    for d in sorted(texts):
        ws = words(texts[d])
        for p in range(len(ws) - 19):
            g = tuple(ws[p : p + 20])
            if g in seen:
                gone[d] |= set(range(p, p + 20))
            seen.add(g)
    rows = [(d, t, "s") for d, t in texts.items()] + [(d, texts[d], "s") for d in (0, 3, 260)]
    for hot in (2, 10**6):
        got = substrings.remove_repeats(frame(spark, rows), bitmap_bits=16, hot_pieces=hot, remembered=5).collect()
        assert len(got) == len(rows)
        for r in got:
            ws = words(texts[r.doc_id])
            kept = [x for i, x in enumerate(ws) if i not in gone[r.doc_id]]
            assert (r.n_removed, r.kept_sha256) == (len(gone[r.doc_id]), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_a_task_remembers_a_bounded_part_of_the_windows_under_hot_halves():
    known, sent = {}, []
    for batch in range(4):
        window = np.arange(50) + 50 * (batch % 2)
        sent.append(substrings._single(window, np.full(50, 9 - batch), np.zeros(50, np.int64), np.arange(50), known, 60))
        assert len(known) <= 60
    # The third batch comes before the first, whose windows are forgotten or later; all of it goes on.
    assert [(x["n"] == 0).sum() for x in sent] == [50, 50, 50, 50]
    again = substrings._single(np.arange(50) + 50, np.full(50, 20), np.zeros(50, np.int64), np.arange(50), known, 60)
    assert again[["n", "first"]].values.tolist()[0][0] > 0 and (again["n"] == 0).sum() < 50


def thue_morse(flip):
    """A word of 1,024 letters over {a, b}, or its complement: equal under every polynomial hash modulo 2^64."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    texts = {1: f"{thue_morse(0)} {rest}", 2: f"{thue_morse(1)} {rest}", 3: f"{rest} {thue_morse(1)}"}
    got = substrings.remove_repeats(frame(spark, [(d, t, "s") for d, t in texts.items()])).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    texts = {1: " ".join([thue_morse(0)] * 2), 2: " ".join([thue_morse(1)] * 2)}
    got = minhash.near_duplicates(frame(spark, [(d, t, "s") for d, t in texts.items()]), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}


def test_substrings_are_done_anew_when_hashes_collide(spark, monkeypatch):
    """Under the first draw's hashes 20 windows of other words look like repeats; the words say no, and the next draw is right."""
    ws = [f"w{i}" for i in range(30)]
    texts = {1: " ".join(ws), 2: " ".join(f"x{i}" for i in range(30)), 3: " ".join(ws[:25])}
    late = substrings._late

    def confused(spark, texts, length, seed, *options):
        found = late(spark, texts, length, seed, *options)
        if seed:
            return found
        key = {r.ord: r.text_key for r in texts.select("ord", "text_key").collect()}
        return found.union(spark.createDataFrame([(2, key[2], 0, 5, 1, key[1], 0)], substrings._RUN))

    monkeypatch.setattr(substrings, "_late", confused)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, [(d, t, "s") for d, t in texts.items()])).collect()}
    assert got == {1: 0, 2: 0, 3: 25}


@pytest.mark.parametrize("length", [3, 9, 10, 21])
def test_substrings_of_other_lengths(spark, length):
    rng = np.random.default_rng(length)
    texts = {d: " ".join(f"a{x}" for x in rng.integers(0, 3 if d % 2 else 40, 60)) for d in range(12)}
    seen, gone = set(), defaultdict(set)
    for d in sorted(texts):
        ws = words(texts[d])
        for p in range(len(ws) - length + 1):
            g = tuple(ws[p : p + length])
            if g in seen:
                gone[d] |= set(range(p, p + length))
            seen.add(g)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, [(d, t, "s") for d, t in texts.items()]), length=length).collect()}
    assert got == {d: len(gone[d]) for d in texts}


def test_embeddings(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    rows += [(1000 + i, (np.array(rows[i][1]) + rng.normal(0, 0.06, 64)).tolist()) for i in range(100)]
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, []), (2004, [1.0, None]), (2005, [1.0, 0.0]), (None, rows[0][1])]
    got = {r.vec_id: r for r in embeddings.link_embeddings(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), rows_per_block=100).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ok = x @ x.T >= 0.9
    ids = [i for i, _ in rows]
    sets = {i: k for k, i in enumerate(ids)}
    want = exact_components(sets, lambda a, b: ok[a, b])
    for i, k in sets.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (ok[k].sum() - 1, want[i], want[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in odd)
    assert embeddings.link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    """Over pairs of a cosine the estimate's mean is that cosine, and its errors are those stated; recall is 1."""
    rng, dims = np.random.default_rng(5), 64
    for cos in (0.9, 0.5, 0.0):
        x = rng.normal(size=(4000, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = rng.normal(size=x.shape)
        o -= np.einsum("ij,ij->i", x, o)[:, None] * x
        y = cos * x + np.sqrt(1 - cos**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
        a, b = embeddings.encode(x, 1), embeddings.encode(y, 2)
        take = lambda v, i: {k: w[i : i + 500] for k, w in v.items()}
        got = np.concatenate([np.diag(embeddings.estimates(take(a, i), take(b, i), dims)) for i in range(0, 4000, 500)])
        sd = embeddings.deviations(a["factor"], b["step"], dims, cos)
        bits = lambda w: sum(int(v) << 64 * k for k, v in enumerate(w))
        for i in range(5):
            planes = b["planes"][i].reshape(embeddings.LEVELS, -1)
            assert embeddings.inner(take(a, i), take(b, i), dims)[0, 0] == sum((bits(a["code"][i]) & bits(p)).bit_count() << k for k, p in enumerate(planes))
        least = embeddings.least_inner(take(a, 0), take(b, 0), dims, 0.7, 3.0) <= embeddings.inner(take(a, 0), take(b, 0), dims)
        sure = embeddings.estimates(take(a, 0), take(b, 0), dims) + 3 * embeddings.deviations(a["factor"][:500, None], b["step"][None, :500], dims, 0.7) >= 0.7
        assert (least | ~sure).all()
        assert abs(got.mean() - cos) < 0.01
        assert (np.abs(got - cos) < 6 * sd).all() and (np.abs(got - cos) < 2 * sd).mean() > 0.94


def test_embeddings_of_few_dimensions_and_extreme_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e200, 1e198]), (3, [1e-200, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 2.0]), (6, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.link_embeddings(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_warc(spark, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://B.example.com/x", tricky), (2, "http://b.example.com/x?q", tricky), (3, None, None), (4, "no scheme\r\n", ""), (5, "http://a.org/", "ñ"), (5, "http://a.org/", "ñ"), (None, "http://a.org/", "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(df, str(tmp_path / "a"), records_per_archive=2).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == len(rows) and [r.url_key for r in got] == sorted(r.url_key for r in got)
    assert by[1, "http://B.example.com/x"].record_type == "revisit" and by[1, "http://B.example.com/x"].refers_to == 2
    assert by[1, "http://B.example.com/x"].payload_bytes == len(tricky) == by[2, "http://b.example.com/x?q"].payload_bytes
    assert by[3, None].refers_to == 4 and by[5, "http://a.org/"].record_type == "response" and by[None, "http://a.org/"].payload_bytes == 1
    assert warc.archive_pages(df.limit(0), str(tmp_path / "b")).count() == 0


def test_warc_archives_are_bounded_and_merged(spark, tmp_path, monkeypatch):
    """Files hold few bytes, revisits say why they are such, each run is in order, and the merge is the order of all."""
    import gzip
    import os

    monkeypatch.setattr(warc, "ENTRIES_PER_RANGE", 50)
    monkeypatch.setattr(warc, "ENTRIES_AT_ONCE", 7)
    rng = np.random.default_rng(9)
    hosts = ["b.example", "a.example", "A.example:80", "x.y.example"]
    rows = [(i, f"http://{hosts[i % 4]}/{rng.integers(0, 5)}?{i % 3}", "p" * int(rng.choice([3, 40, 900, 5000])) + str(i % 50)) for i in range(300)]
    rows += [(300, "http://hot.example/", "same")] * 40 + [(301, None, None), (None, "http://z.example", "z" * 20_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, archive string, rank int")
    path = str(tmp_path / "w")
    got = warc.archive_pages(df.repartition(3), path, archive_bytes=4000, records_per_archive=20).collect()
    key = lambda r: (r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id)
    assert len(got) == len(rows) and [key(r) for r in got] == sorted(map(key, got))
    sizes, runs = [], defaultdict(list)
    for f in os.listdir(path):
        if f.endswith(".gz"):
            records = list(warc.records_of(gzip.open(os.path.join(path, f)).read()))
            sizes.append((sum(len(b) for *_, b in records), len(records)))
            assert all(("warc-profile" in h) == (h["warc-type"] == "revisit") for _, h, _ in records)
    assert all(n == 1 or b <= 4000 and n <= 20 for b, n in sizes) and sum(n for _, n in sizes) == len(rows)
    for r in warc.read_archives(spark, path).collect():
        runs[r.archive].append((r.rank, key(r)))
    assert all(sorted(v) == v and [k for _, k in v] == sorted(k for _, k in v) for v in runs.values())
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    for r in got:
        assert (r.record_type == "revisit") == (r.refers_to is not None)
        assert r.refers_to is None or r.refers_to in largest.values() and r.page_id != r.refers_to


def test_loser_tree():
    rng = np.random.default_rng(6)
    for k in range(0, 9):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_urls(spark):
    rows = ["https://Www.Example.com/de/x?y", "http://xexample.com/de/", "http://net", "http://a.net/", "http://example.net/en/1", None, "net/", "http://a.org/fr", "ftp://ORG/fr/#", "x://é.net/", ""]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, queries.URL_RULES).collect()}
    assert got[0] == ("example.com/de/", "block") and got[1] == (None, "allow") and got[2] == (None, "allow") and got[3] == ("net/", "block")
    assert got[4] == ("example.net/en/", "allow") and got[5] == got[6] == got[7] == got[10] == (None, "allow") and got[8] == ("org/fr/", "allow") and got[9][1] == "block"
    many = [("block", f"host{i}.example/p{i}") for i in range(7000)]
    got = urls.filter_urls(spark.createDataFrame([(1, "http://a.host6999.example/p6999x"), (2, "http://host3.example/p4")], "page_id long, url string"), many).collect()
    assert [r.verdict for r in sorted(got)] == ["block", "allow"]
    assert urls.filter_urls(df.limit(0), []).count() == 0


def test_decontamination_spans(spark):
    items = spark.createDataFrame([(1, "The quick brown FOX"), (2, "a b c d e f g h i j k"), (10, "quick brown fox")], "item_id long, text string")
    text = "Start: the QUICK, brown fox! b c d e f g h i j k end"
    r = decontamination.decontaminate(frame(spark, [(1, text, "s")]), items).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (16, 14, 3, True)
    assert r.items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()
    assert [text[s.start : s.end] for s in r.spans] == ["the QUICK, brown fox! b c d e f g h i j k"]


@pytest.mark.parametrize("nodes", [10**6, 3000])
def test_decontamination_against_brute_force(spark, nodes):
    """Hits, items and the spans' words of all documents, with one automaton and with several."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").limit(40).selectExpr("cast(item_id as string) as item_id", "text")
    items = items.union(spark.createDataFrame([("short", "of the"), ("none", " .!"), ("null", None)], "item_id string, text string"))
    normal = lambda t: (t or "").encode().translate(decontamination.NORMAL).decode().split()
    wins = defaultdict(set)
    for r in items.collect():
        for w in decontamination.windows_of(r.text, 10):
            wins[tuple(w.split())].add(str(r.item_id))
    sizes = {len(w) for w in wins}
    for r in decontamination.decontaminate(docs, items, nodes=nodes).collect():
        ws, hit, who = normal(r.text), set(), set()
        for n in sizes:
            for p in range(len(ws) - n + 1):
                if found := wins.get(tuple(ws[p : p + n])):
                    hit |= set(range(p, p + n))
                    who |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(ws), len(hit), len(who), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        assert [x for s in r.spans for x in normal(r.text[s.start : s.end])] == [ws[p] for p in sorted(hit)]


def test_quality_votes_against_plain_neighbours(spark):
    """Every document's score again: terms counted one by one, cosines to all labelled vectors, the nearest of them voting."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learnt = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    model = quality.fit(docs, spark.createDataFrame(learnt), id_col="doc_id", text_col="text", label_col="quality")
    assert len(model["vectors"]) == len(learnt) and sorted(model["labels"]) == sorted(r.quality for r in learnt)
    for r in quality.score_quality(docs, labels).collect():
        data, v = (r.text or "").encode(), np.zeros(quality.N_TERMS)
        ws = [w.lower() for w in data.split()]
        hashes = {w: int(hashed_words([w])[0][0]) for w in set(ws)}
        for w in ws:
            v[hashes[w] >> (64 - quality.WORD_BITS)] += 1 / len(ws)
        seen = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in data)
        for i in range(len(data) - 2):
            code = int.from_bytes(seen[i : i + 3], "big") * 2654435761 % 2**32 >> (32 - quality.GRAM_BITS)
            v[(1 << quality.WORD_BITS) + code] += 1 / (len(data) - 2)
        if ws:
            near = sum(x == y for x, y in zip(ws, ws[1:])) / (len(ws) - 1) if len(ws) > 1 else 0
            v[-4:] = near, 1 - near, 1 - len(set(ws)) / len(ws), len(set(ws)) / len(ws)
        p = (np.sqrt(v)[model["used"]] * model["idf"]) @ model["base"].astype(float)
        p /= np.linalg.norm(p) or 1
        cos = model["vectors"].astype(float) @ p
        top = np.argsort(-cos)[:16]
        weight = np.maximum(cos[top[:15]], 1e-6) ** 4
        want = (weight * model["labels"][top[:15]]).sum() / weight.sum()
        # The fifteenth neighbour is open where the next one is as near.
        assert abs(r.score - want) < 1e-3 or cos[top[14]] - cos[top[15]] < 1e-5, (r.doc_id, r.score, want)
        assert r.predicted == (r.score >= 0.3)


def test_quality_takes_one_text_of_an_id(spark):
    docs = frame(spark, [(1, t, "s") for t in ("good text here", "good words here")] * 50 + [(2, "$$$ !!! $$$", "s"), (3, "text", "s")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, id_col="doc_id", text_col="text", label_col="quality")
    assert model["labels"].tolist() == [1, 0]


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in got)
    assert len(got) > 50 and right >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_licences(spark):
    rows = [(1, "x\nLicensed under the APACHE licence, version 2.0\nmore", "s"), (2, "Released under the MIT License.", "s"), (3, "the license", "s")]
    got = {r.doc_id: r.licences for r in licences.scan_licences(frame(spark, rows), least=0.6).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT"], 3: []}


def test_licence_passages_inside_lines_and_across_them(spark):
    whole = dict(licences.full_texts())
    rows = [
        (1, "This package is Released under the MIT License. See file for details.", "s"),
        (2, "some words\nLicensed under\nCC BY-NC\n4.0. Other words follow here", "s"),
        (3, "word " * 400 + "Released under the MIT License. " + "word " * 400, "s"),
        (4, "# file\nCopyright 2020 A Person\n" + whole["MIT"] + "import os\n", "s"),
        (5, whole["BSD-3-Clause"].replace("\n", " "), "s"),
        (6, "x y z\n" + whole["Apache-2.0"], "s"),
        (7, "Released under the same terms as the license of MIT", "s"),
    ]
    got = {r.doc_id: (r.licences, r.n_lines) for r in licences.scan_licences(frame(spark, rows)).collect()}
    # The last line's one bigram, "the software", stands before too, so the shortest best window ends a line earlier.
    assert got[1] == got[3] == (["MIT"], 1) and got[2] == (["CC-BY-NC-4.0"], 3) and got[4] == (["MIT"], 14) and got[5] == (["BSD-3-Clause"], 1) and got[7] == ([], 0)
    assert "Apache-2.0" in got[6][0]


def test_licence_passages_against_brute_force():
    rng = np.random.default_rng(5)
    templates = [("a", "p q r s t"), ("b", "q r q s p r t t s"), ("c", "u v"), ("d", "p p p q q")]
    for least in (0.5, 0.8):
        known = licences.Templates(templates, least)
        for n in range(150):
            ws = rng.choice(list("pqrstuvx"[: 4 + n % 5]), 2 + n % 45).tolist()
            ws = ws + "p q r s t".split() * (n % 3) + ws[: n % 7]
            expected = []
            for name, text in templates:
                grams, found = licences.bigrams(text), []
                for i in range(len(ws)):
                    for j in range(i + 1, len(ws)):
                        own = set(zip(ws[i:j], ws[i + 1 : j + 1]))
                        dice = 2 * len(own & grams) / (len(own) + len(grams))
                        if dice >= least:
                            found.append((-dice, j - i, i, j))
                taken = []
                for d, _, i, j in sorted(found):
                    if all(i > y or j < x for _, x, y in taken):
                        taken.append((-d, i, j))
                expected += [(name, *x) for x in taken]
            assert known.match(" ".join(ws)) == expected
