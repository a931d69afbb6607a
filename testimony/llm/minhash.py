"""MinHash near-duplicates with b-bit signatures.

Of every minimum only the low bits are kept and packed; bands of full minima propose pairs, and the
share of equal packed values, corrected for values that agree by chance, estimates their similarity.
Pairs whose estimate is within its error of the threshold belong to one family; families are small sets
of documents whose full shingle sets are then compared exactly, and only what that confirms is a link.

Documents with equal words in order are one class. The members of a bucket or family are compared with its first one, block by block;
only those that this leaves open meet the others, a pair of blocks in one task. A task returns a
spanning forest, never all its pairs. Hashes only propose: sets are counted and compared by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.llm.common import broadcast_if_small, components, fresh, hashed_words, map_slices, mix, runs_of, settle, utf8, whole_groups

BANDS, ROWS, BITS = 40, 5, 2
#: Members of a family or bucket that meet in one block.
BLOCK = 512


def shingle_codes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Numbers of the word n-grams of each text in order, A-Z folded: equal numbers are equal words, within one call.

    A text of fewer words, but not none, has its whole sequence as the one. Words are numbered, not hashed.
    """
    number: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    parts = []
    for t in texts:
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split()), np.int64))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    code, most = ids, len(number)
    for k in range(1, size):
        if most * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            most = len(code)
        code = code[: len(ids) - k] * len(number) + ids[k:]
        most *= len(number)
    out, at = [], 0
    for p in parts:
        if len(p) >= size:
            out.append(code[at : at + len(p) - size + 1])
        else:
            out.append(np.array([-1 - short.setdefault(tuple(p.tolist()), len(short))] if len(p) else [], np.int64))
        at += len(p)
    return out


def _hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of one text's word hashes; of all of them if they are fewer."""
    n = max(1, min(size, len(words)))
    g = words[: len(words) - n + 1]
    for k in range(1, n):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return g


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over the set, in pieces that bound memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (a * low[None, i : i + 2048] + b).min(axis=1), out=out)
    return out


def pack(values: np.ndarray, bits: int) -> bytes:
    """Low ``bits`` bits of each value, packed.

    Values are spread first, each place in its own way: the low bits of two shingles would else agree in
    all permutations or in none, as those are linear.
    """
    values = mix(values.astype(np.uint64) + np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8)).tobytes()


def agreement(one: np.ndarray, many: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Estimated similarities of packed signatures (uint8 rows) to others, corrected for chance collisions."""
    differ = one ^ many
    if bits == 2:
        differ = (differ | differ >> 1) & 0x55
    elif bits == 4:
        differ = differ | differ >> 1
        differ = (differ | differ >> 2) & 0x11
    equal = 1 - np.bitwise_count(differ).sum(axis=1) / n
    chance = 2.0**-bits
    return (equal - chance) / (1 - chance)


def _sign(size: int, bands: int, rows: int, bits: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _seeds(bands * rows)
        for pdf in batches:
            texts, out = utf8(pdf["text"]), []
            for i, j in runs_of(texts):
                words, ends = hashed_words(texts[i:j], fold=True)
                start = 0
                for text, codes, end in zip(texts[i:j], shingle_codes(texts[i:j], size), ends.tolist(), strict=True):
                    own, start = words[start:end], end
                    if not len(own):
                        out.append((0, None, None, None))
                        continue
                    first = np.unique(codes, return_index=True)[1]
                    m = minima(_hashes(own, size)[first], a, b)
                    wide = m.reshape(bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
                    for k in range(rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, k])
                    said = hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()
                    out.append((len(first), said, pack(m, bits), key.view(np.int64)))
            made = pd.DataFrame(out, columns=["n_shingles", "set_key", "signature", "bands"])
            yield pd.concat([pdf[["doc_id", "text_key"]].reset_index(drop=True), made], axis=1).astype({"doc_id": "Int64"})

    return sign


def _reach(n: int, split: int, near) -> tuple[list[tuple[int, int]], int]:
    """Forest over rows 0..n-1 of pairs for which ``near(i, others)`` holds, breadth first, and how many edges reach from row 0.

    Every row is compared with all rows not yet reached from its set, so a tight group costs about its
    size and the result has the components of all pairs. With ``split`` > 0 only pairs across it count.
    """
    edges, left, first = [], np.arange(n), None
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            others = left if not split else left[left >= split] if i < split else left[left < split]
            if not len(others):
                continue
            hit = others[near(i, others)]
            edges += [(i, int(j)) for j in hit]
            queue += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
        first = len(edges) if first is None else first
    return edges, first or 0


class Spanning:
    """Edges of a task that join sets not yet joined in it: at most one less than its nodes."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p] if p in up else p
            x = p
        return x

    def new(self, pairs) -> pd.DataFrame:
        kept = []
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((a, b))
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")


def _near_first(bits: int, n: int, cut: float):
    """Pairs (least, node) with whether their estimate reaches the cut."""

    def near_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                one, many = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("first_signature", "signature"))
                yield pd.DataFrame({"least": pdf["least"], "node": pdf["node"], "near": agreement(one, many, bits, n) >= cut})

    return near_first


def _similar(bits: int, n: int, cut: float):
    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spanning = Spanning()
        for pdf, starts in whole_groups(batches, ["bucket", "bi", "bj"]):
            sig = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), -1)
            node, block, bi, bj = (pdf[c].to_numpy() for c in ("node", "block", "bi", "bj"))
            pairs = []
            for a, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                split = int((block[a:e] == bi[a]).sum()) if bi[a] != bj[a] else 0
                edges, _ = _reach(e - a, split, lambda i, o, own=sig[a:e]: agreement(own[i], own[o], bits, n) >= cut)
                pairs += [(int(node[a + i]), int(node[a + j])) for i, j in edges]
            yield spanning.new(pairs)

    return similar


def _confirm_block(size: int, percent: int):
    """Edges (a, b) inside a block of a family; of a family of several blocks also its open nodes (a, null)."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, ["bucket", "block"]):
            texts, node, many = utf8(pdf["text"]), pdf["node"].to_numpy(), pdf["blocks"].to_numpy() > 1
            for a, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                # Sorted by node with the family's least one in front; repeated rows come as one node.
                at = a + np.unique(node[a:e], return_index=True)[1]
                edges, first = _reach(len(at), 0, _sharing([texts[i] for i in at], size, percent))
                found = [(node[at[i]], node[at[j]]) for i, j in edges]
                if many[a]:
                    closed = {0, *(j for _, j in edges[:first])}
                    found += [(node[x], None) for i, x in enumerate(at.tolist()) if i not in closed]
                yield pd.DataFrame(found, columns=["a", "b"]).assign(bucket=pdf["bucket"].iat[a]).astype({"a": "int64", "b": "Int64"})[["bucket", "a", "b"]]

    return confirm


def _confirm(size: int, percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spanning = Spanning()
        for pdf, starts in whole_groups(batches, ["bucket", "bi", "bj"]):
            every = utf8(pdf["text"])
            node, block, bi, bj = (pdf[c].to_numpy() for c in ("node", "block", "bi", "bj"))
            for a, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                edges, _ = _reach(e - a, int((block[a:e] == bi[a]).sum()) if bi[a] != bj[a] else 0, _sharing(every[a:e], size, percent))
                yield spanning.new((int(node[a + i]), int(node[a + j])) for i, j in edges)

    return confirm


def _sharing(texts: list[bytes], size: int, percent: int):
    """Test of a text's shingle set against others: 100 * intersection >= percent * union, on their words.

    The sets' elements are sorted once with their owners, so a set's shared counts with all others are
    one bincount over the owners of its elements.
    """
    sets = [np.unique(c) for c in shingle_codes(texts, size)]
    counts = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), counts)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def near(i: int, o: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(sets))[o]
        return 100 * both >= percent * (counts[i] + counts[o] - both)

    return near


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members (bucket, node, open, n_open, n_closed, ...) once for each pair of blocks (bi <= bj) they meet in.

    Open members meet all, closed ones only open ones. Blocks are dealt by hash, those of open members come
    first. The pair is part of the key, so a large bucket spreads over many tasks.
    """
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("open"), F.col("_open")).otherwise(F.col("_closed"))).cast("int")
    dealt = members.withColumns({"_open": F.ceil(F.col("n_open") / block).cast("int"), "_closed": F.ceil(F.col("n_closed") / block).cast("int")})
    dealt = dealt.withColumn("block", F.when(F.col("open"), own).otherwise(own + F.col("_open")))
    last = F.when(F.col("open"), F.col("_open") + F.col("_closed")).otherwise(F.col("_open")) - 1
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumns({"bi": F.least("block", "_other").cast("int"), "bj": F.greatest("block", "_other").cast("int")}).drop("_other", "_open", "_closed", "n_open", "n_closed")


def opened(members: DataFrame) -> DataFrame:
    """Members (bucket, node, open, ...) of buckets with open nodes, with n_open and n_closed."""
    counts = members.groupBy(F.col("bucket").alias("_b")).agg(F.sum(F.col("open").cast("long")).alias("n_open"), F.sum((~F.col("open")).cast("long")).alias("n_closed"))
    return members.join(broadcast_if_small(counts.where("n_open > 0")), F.col("bucket") == F.col("_b")).drop("_b")


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
    errors: float = 5.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, component_id, kept, first_key.

    A document's set is its distinct ``shingle``-word shingles, A-Z lower-cased; with fewer words the
    whole sequence is one. Two documents link when 100 * intersection >= percent * union on the full
    sets. component_id is the least doc_id reachable, itself included; kept marks doc_id = component_id.
    ``first_key`` is the text_key of the component's first document, by (doc_id, text_key).

    Bands find a pair at the threshold with a miss rate of (1 - s^rows)^bands, 1.3e-7 at 0.8 as set;
    an estimate may lie ``errors`` standard errors under the threshold and still pass.

    Documents without words, empty or null, have n_shingles 0 and link with nothing. Null ids stay null
    with kept null, and sort last. Repeated rows are equal documents and get equal results.
    Very long texts are hashed whole. An empty table gives an empty result. Other columns are ignored.
    """
    n = bands * rows
    key = F.xxhash64(F.col(text_col))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key.alias("text_key"))
    signed = settle(map_slices(plain, _sign(shingle, bands, rows, bits), "doc_id long, text_key long, n_shingles long, set_key binary, signature binary, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "text_key"))
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(first.alias("f"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    # Numbers that are unique, as no hash is; they are written with the classes, so they stay.
    classes = settle(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "f.doc_id", "f.text_key", "signature", "bands"))
    similarity = percent / 100
    error = np.sqrt(similarity * (1 - similarity) / n + 2.0**-bits / (1 - 2.0**-bits) * (1 - similarity) / n)
    likely = _likely(classes, bits, n, float(similarity - errors * error))
    families = settle(components(likely).select("node", F.col("component").alias("bucket")))
    links = _links(plain, classes, families, shingle, percent)
    joined = components(links)
    named = classes.join(broadcast_if_small(joined), "node", "left").select("set_key", F.coalesce("component", "node").alias("_c"), "doc_id", "text_key")
    least = named.groupBy("_c").agg(first.alias("f")).select("_c", F.col("f.doc_id").alias("_first"), F.col("f.text_key").alias("_first_key"))
    named = settle(named.join(least, "_c").select(F.col("set_key").alias("_set"), "_first", "_first_key"))
    out = signed.select("doc_id", "text_key", "n_shingles", "set_key").join(broadcast_if_small(named), F.col("set_key") == F.col("_set"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_first")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"),
        F.when(F.col("n_shingles") > 0, F.col("_first_key")).otherwise(F.col("text_key")).alias("first_key"),
    )


def _likely(classes: DataFrame, bits: int, n: int, cut: float) -> DataFrame:
    """(a, b): a forest of the pairs of classes that share a band and whose estimate reaches ``cut``."""
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = settle(banded.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("node").alias("least")).where("_n > 1").drop("_n"))
    members = banded.join(broadcast_if_small(sizes), "bucket")
    # Near copies share most of their buckets and their least members: each pair with a least one is judged once.
    pairs = members.where("node <> least").select("least", "node").distinct()
    own = classes.select("node", "signature")
    pairs = pairs.join(own, "node").join(own.toDF("least", "first_signature"), "least")
    judged = settle(pairs.mapInPandas(_near_first(bits, n, cut), "least long, node long, near boolean"))
    likely = judged.where("near").select(F.col("least").alias("a"), F.col("node").alias("b"))
    if judged.where("not near").isEmpty():
        return likely
    # Those that are near a bucket's least member are one family with it; the open ones meet all others that share a bucket
    # with it, once, in however many buckets they do.
    meet = in_blocks(opened(judged.select(F.col("least").alias("bucket"), "node", (~F.col("near")).alias("open")))).join(own, "node")
    meet = meet.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", F.col("block") != F.col("bi"), "node")
    return settle(likely.union(meet.mapInPandas(_similar(bits, n, cut), "a long, b long")).distinct())


def _links(plain: DataFrame, classes: DataFrame, families: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): a forest of the pairs of each family whose sets are as similar as asked, by their words."""
    sizes = families.groupBy(F.col("bucket").alias("_b")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("node").alias("least"))
    wanted = families.join(broadcast_if_small(sizes), F.col("bucket") == F.col("_b")).drop("_b")
    wanted = settle(wanted.join(classes.select("node", F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")), "node"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))
    texts = plain.join(broadcast_if_small(wanted), same).select("bucket", "blocks", "least", "node", "text")
    # The least one of a family comes to all its blocks.
    own = F.array(F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    every = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    dealt = texts.withColumn("block", F.explode(every)).drop("least").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")
    found = settle(map_slices(dealt, _confirm_block(shingle, percent), "bucket long, a long, b long"))
    links, open_ = found.where("b is not null").select("a", "b"), found.where("b is null").select("bucket", F.col("a").alias("node"))
    if open_.isEmpty():
        return links
    flags = broadcast_if_small(open_.select(F.col("bucket").alias("_b"), F.col("node").alias("_n"), F.lit(True).alias("_is")))
    members = texts.join(flags, (F.col("bucket") == F.col("_b")) & (F.col("node") == F.col("_n")), "left")
    met = in_blocks(opened(members.select("bucket", "node", "text", F.coalesce("_is", F.lit(False)).alias("open"))), block)
    met = met.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", F.col("block") != F.col("bi"), "node")
    return settle(links.union(map_slices(met, _confirm(shingle, percent), "a long, b long")).distinct())


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the first by (id, text).

    Repeated rows count as copies, so one stays, except of rows without words, which link with nothing.
    All columns are kept; rows with a null id are judged by their text like others.
    """
    judged = settle(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("n_shingles > 0"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    go_id, go_key, own_key, turn = fresh(docs, "_go_id", "_go_key", "_own_key", "_turn")
    pair = [F.col("doc_id").alias(go_id), F.col("text_key").alias(go_key)]
    go = settle(judged.where(~first).select(*pair).distinct())
    again = settle(judged.where(first).groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    keyed = docs.withColumn(own_key, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(go_id)) & (F.col(own_key) == F.col(go_key))
    kept = keyed.join(broadcast_if_small(go), same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = broadcast_if_small(again)
    # One of the repeated rows of a pair: rows are numbered apart, and equal in all that counts.
    once = kept.join(again, same).withColumn(turn, F.row_number().over(Window.partitionBy(go_id, go_key).orderBy(F.monotonically_increasing_id()))).where(F.col(turn) == 1)
    return kept.join(again, same, "left_anti").select(*docs.columns).union(once.select(*docs.columns))
