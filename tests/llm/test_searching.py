"""Ranked search, collocations and exact top products against brute force, and on nulls, empty tables, ties, repeated rows and clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from testimony.llm import decontamination, licences, phrases, ranking, search
from testimony.llm.common import Vocabulary, split_words, stop_bytes

LOWER = {c: c + 32 for c in range(65, 91)}


# --- ranking ----------------------------------------------------------------------------------------


def plain_ranks(docs, items, top=10):
    split = lambda t: re.findall(ranking.TERM, (t or "").translate(LOWER))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    wanted, out = defaultdict(set), {}
    for item, text in items:
        wanted[item] |= set(split(text))
    for item, terms in wanted.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:top])]
    return {k: v for k, v in out.items() if v}


def ranked(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return out


def test_ranks_against_all_documents(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ünd", "X9"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 43])]) + rng.choice(["", ",", "."]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(300)]
    docs += [(1000 + i, docs[7][1] + " w1") for i in range(200)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, None), (2000, None), (2001, ""), (2002, ".;"), (2003, "w1 " * 40_000)]
    items = [("a", "w1 W2 w3"), ("b", text(25)), ("b", "X9"), ("c", "nowhere"), ("d", None), (None, "été w39"), ("e", ""), ("f", docs[7][1])]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, score int, rank int, item_id string")
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id string, text string, doc_id int")
    for block in (ranking.TERMS_PER_BLOCK, 10):
        assert ranked(ranking.rank_documents(frame, asked, terms_per_block=block).collect()) == plain_ranks(docs, items)
    assert ranked(ranking.rank_documents(frame, asked, top=3, seed_share=2).collect()) == plain_ranks(docs, items, 3)
    for d, i in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame, asked.where("item_id in ('c', 'd', 'e')"))):
        found = ranking.rank_documents(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("leaf", [1, 3, 1000])
def test_trees_bound_their_documents(leaf, monkeypatch):
    """Every document is in one leaf; no document scores more than any node above it; searches find the best."""
    monkeypatch.setattr(ranking, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(leaf)
    for _ in range(30):
        paths = sorted(sorted(rng.choice(12, rng.integers(1, 6), replace=False).tolist()) for _ in range(rng.integers(1, 60)))
        ends, terms = np.append(0, np.cumsum([len(p) for p in paths])), np.concatenate(paths)
        tfs, m, weight = rng.integers(1, 9, len(terms)), rng.integers(10, 99, len(paths)), rng.integers(0, 9, 12)
        ids = np.stack([np.zeros(len(paths), np.int64), rng.permutation(len(paths))], 1)
        tree = ranking.Tree(ids, m, ends, terms, tfs, weight)
        leaves = [v for v, (a, b) in enumerate(tree.children) if a == b]
        assert sorted(i for v in leaves for i in range(tree.low[v], tree.high[v])) == list(range(len(paths))) and all(tree.high[v] - tree.low[v] <= max(leaf, 1) for v in leaves)
        wanted = rng.random(12) < 0.4
        scores = ranking._sums(wanted, tree.terms, tree.doc_gain, tree.ends, 0, len(paths))
        bounds = ranking._sums(wanted, tree.node_terms, tree.node_gain, tree.node_ends, 0, len(tree.low))
        assert all(scores[tree.low[v] : tree.high[v]].max() <= bounds[v] for v in range(len(tree.low)))
        best = ranking.Best(4)
        tree.search(wanted, best)
        assert list(zip(best.score.tolist(), best.ids[:, 1].tolist(), strict=True)) == [(-s, i) for s, i in sorted((-int(s), int(i)) for s, i in zip(scores, ids[:, 1], strict=True) if s > 0)[:4]]


def test_a_search_leaves_subtrees_out(monkeypatch):
    monkeypatch.setattr(ranking, "LEAF_ROWS", 4)
    paths = sorted([[i // 8, 200 + i] for i in range(800)])
    tree = ranking.Tree(np.stack([np.zeros(800, np.int64), np.arange(800)], 1), np.full(800, 50), np.arange(0, 1601, 2), np.concatenate(paths), np.ones(1600, np.int64), np.full(1000, 7))
    seen, sums = [], ranking._sums
    monkeypatch.setattr(ranking, "_sums", lambda *a: seen.append(a[5] - a[4]) or sums(*a))
    wanted = np.zeros(1000, bool)
    wanted[[3, 4]] = True
    tree.search(wanted, ranking.Best(5))
    assert sum(seen) < 300


def test_vocabulary_confirms_words():
    stops = stop_bytes((0, 32))
    known = Vocabulary([b"a", b"same", b"x" * 100, b"abcdefgh1"], stops)
    found = split_words([b"a b same ", b"", b"x" * 100 + b" " + b"x" * 99 + b" abcdefgh2 abcdefgh1"], stops)
    assert known.number(found).tolist() == [0, -1, 1, 2, -1, -1, 3] and found.ends.tolist() == [3, 3, 7]
    known.hashed[:] = np.sort(known.hashed)
    assert Vocabulary([], stops).number(found).tolist() == [-1] * 7


# --- collocations -----------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, share, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                count[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, f in count.items():
        cands = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        within = Counter()
        for p, n in cands.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        within[p[i:j]] = max(within[p[i:j]], n)
        made = []
        for p, a in cands.items():
            if within[p] and 100 * within[p] >= share * a:
                continue
            cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            made.append((-cut[0], -a, " ".join(p).encode(), cut[2], cut[3]))
        out |= {(lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(made)[:top])}
    return out


def test_collocations_against_plain_counts(spark):
    rng = random.Random(8)
    words = ["a", "b", "B", "c", "é", "y" * 70, "z" * 9, "one", "two"]
    text = lambda n: "".join(rng.choice(words[: rng.choice([3, 9])]) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for _ in range(n))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), text(rng.randint(0, 60))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", " .,\n"), ("en", "one two " * 3000)] + [("en", "hot copy of one text")] * 40
    docs = spark.createDataFrame([(i, t, lang, 3, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, rank int, phrase string, w1 int")
    for longest, least, share, top, size in ((4, 5, 80, 2000, 300), (3, 2, 50, 7, 1 << 20), (5, 4, 100, 50, 2000), (2, 1, 80, 30, 500)):
        got = phrases.collocations(docs, longest=longest, least=least, share=share, top=top, shard_bytes=size).collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_collocations(rows, longest, least, share, top)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_indexes_widen_in_both_directions():
    """Counts and ranges of all phrases of an index are those of the text, to the right and to the left."""
    class All:
        def has(self, values):
            return np.ones(len(values), bool)

    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        texts = [" ".join(rng.choice(list("abcd"), n).tolist()) + ". " + " ".join(rng.choice(list("ab"), n).tolist())]
        row = phrases.index("en", [t.encode() for t in texts], 0, 4)
        names = [None, *row.column("names")[0].as_py()]
        shard = phrases.Shard({c: row.column(c)[0] for c in row.schema.names})
        for depth in (1, 2, 3, 4):
            found = phrases.frequent_phrases(shard, [All()] * (depth - 1))
            got = {tuple(names[w[i]].decode() for w in found.words): int(c) for i, c in enumerate(found.count)}
            want = Counter(tuple(ws[i : i + depth]) for piece in texts[0].split(".") for ws in [piece.split()] for i in range(len(ws) - depth + 1))
            assert got == want


def test_hashes_that_are_alike_are_seen(monkeypatch):
    monkeypatch.setattr(phrases, "word_hashes", lambda found, seed: np.full(len(found.starts), seed % 2, np.uint64))
    assert phrases.index("en", [b"one two"], 0, 4).column("clash")[0].as_py() and not phrases.index("en", [b"one one"], 0, 4).column("clash")[0].as_py()
    assert phrases.index("en", [b" . "], 0, 4) is None


# --- top products -----------------------------------------------------------------------------------


def plain_products(rows, every, top, scale=256):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v):
            q = [math.floor(scale * x) for x in v]
            kept[i] = min(kept.get(i, q), q)
    out = set()
    for i, q in kept.items():
        if i % every == 0:
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            scores = sorted((-clip(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in kept.items() if j != i and len(v) == len(q))[:top]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("shard_rows,pivots", [(2048, 128), (7, 5), (40, 1)])
def test_products_against_all_vectors(spark, shard_rows, pivots):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(12, 8))
    rows = [(i, (centre[i % 12] * (1 + i % 3) + rng.normal(size=8) * 0.1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(-50 * i, rows[i][1]) for i in range(1, 4)]
    odd = [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (2200, [0.0] * 8), (2250, []), (2300, []), (2350, [1.0, 2.0]), (2401, [3.0, -2.0]), (2450, [1e17] * 8), (2500, [-1e17] * 8), (2550, [1e300] * 8)]
    rows += odd + [rows[0], (50, [0.5] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, query_id int, far double")
    got = search.top_products(table, shard_rows=shard_rows, pivots=pivots).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_products(rows, 50, 5)
    assert search.top_products(table.limit(0)).collect() == []


def test_bounds_hold_and_annuli_are_left_out():
    rng = np.random.default_rng(10)
    centre = np.floor(rng.normal(size=(6, 16)) * 200)
    x = np.floor(np.repeat(centre, 300, axis=0) + rng.normal(size=(1800, 16)) * 12)
    pivot = centre[0]
    far = search.distances(x, pivot[None, :])[:, 0]
    order = np.argsort(far)
    shard = search.Shard(order, x[order], far[order], pivot)
    q = x[::97]
    bound = search.upper_bounds(np.repeat(search.distances(q, pivot[None, :]), len(shard.low), axis=1), np.linalg.norm(q, axis=1), shard.low, shard.high, shard.longest)
    score = q @ shard.x.T
    assert all((score[:, a:b].max(axis=1) <= bound[:, k]).all() for k, (a, b) in enumerate(zip(shard.cuts[:-1], shard.cuts[1:], strict=True)))
    compared, products = [], search.products
    try:
        search.products = lambda a, b: compared.append(len(a) * len(b)) or products(a, b)
        found = shard.search(np.full(len(q), -1), q, np.full(len(q), np.iinfo(np.int64).min), 5)
    finally:
        search.products = products
    assert (found.score == -np.sort(-score, axis=1)[:, :5]).all() and sum(compared) < 0.7 * len(q) * len(x)


# --- earlier operators, mended ----------------------------------------------------------------------


def test_licences_repeated_in_one_text_take_little():
    import time
    import tracemalloc

    rng = random.Random(2)
    template = " ".join(f"w{rng.randint(0, 900)}" for _ in range(3_000))
    known = licences.Templates([("long", template)], 0.8)
    tracemalloc.start()
    began = time.time()
    found = known.match("\n".join([template] * 4))
    assert len(found) == 4 and all(x[1] == 1.0 for x in found) and tracemalloc.get_traced_memory()[1] < 150 << 20 and time.time() - began < 60
    tracemalloc.stop()


def test_windows_are_sought_in_stretches_of_known_words():
    known = decontamination.Windows([("i", "one two three"), ("j", "four"), ("k", "")], 10)
    texts = [b"x ONE, two Three four.", None, b"", b"one two x three", b"four four"]
    assert list(decontamination.scan(texts, known)) == [(5, [(1, 5)], ["i", "j"]), (0, [], []), (0, [], []), (4, [], []), (2, [(0, 2)], ["j"])]
    assert list(decontamination.scan([b"a b"], decontamination.Windows([], 10))) == [(2, [], [])] and pa.array([1])
