"""Ranked lexical search over a prefix tree of documents.

Each text is read once and cut down to the items' terms with their counts. These restricted vectors, terms in falling order of
document frequency, are sorted and cut into ranges, so that documents with the same leading terms lie together and share a
path. A task builds a tree over its documents, keeps for every node the most occurrences of each term beneath it and the
least length measure ``m``, and so has a bound on any score beneath. For each item it goes down the tree depth first, best child first, and
leaves out every subtree whose bound is below the item's tenth score so far. All is in whole numbers, so bounds are bounds and scores are exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.llm.common import RUN_BYTES, Vocabulary, runs_of, settle, split_words, stop_bytes, text_slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_STOPS = stop_bytes((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most terms, counted with repeats, of the items that are searched for at once. More items are further blocks.
TERMS_PER_BLOCK = 500_000
#: Most documents of one tree, and of one leaf.
TREE_ROWS, LEAF_ROWS = 16_384, 48
#: One in so many documents, by a hash of the id, gives each item a first bound before all are searched.
SEED_SHARE = 64
_known: dict[str, Vocabulary] = {}


# --- restricted vectors ---------------------------------------------------------------------------


def _restricted(shared, key: str):
    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text its number of terms, and the known ones with their counts."""
        if key not in _known:
            _known.clear()
            _known[key] = Vocabulary(shared.value, _STOPS)
        known = _known[key]
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column(1)):
                texts = [t or b"" for t in texts]
                for a, b in runs_of(texts):
                    found = split_words(texts[a:b], _STOPS, fold=True)
                    number = known.number(found)
                    n = np.diff(found.ends, prepend=0)
                    hit = np.flatnonzero(number >= 0)
                    owner = np.repeat(np.arange(b - a), n)[hit]
                    code, tf = np.unique(owner * len(shared.value) + number[hit], return_counts=True)
                    ends = np.searchsorted(code // max(1, len(shared.value)), np.arange(b - a + 1)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in ((code % max(1, len(shared.value))).astype(np.int32), tf.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at + a, b - a), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])
                at += len(texts)

    return restricted


def _paths(shared):
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors by the rank of their terms, lowest first, and the length measure m."""
        rank, n_docs, length = shared.value
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(_sizes(batch.column(2))))
            tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ranked = rank[flat]
            order = np.lexsort((ranked, np.repeat(np.arange(len(n)), np.diff(ends))))
            m = [10 + 90 * int(x) * n_docs // length for x in n]
            offsets = pa.array(ends.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ranked[order].astype(np.int32), tfs[order])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m, pa.int64()), *lists], names=["doc_id", "m", "path", "tfs"])

    return paths


def _sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy(zero_copy_only=False))


# --- the tree -------------------------------------------------------------------------------------


def gain(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms add to a score: grows with tf, falls with m."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Tree:
    """A prefix tree of documents sorted by their paths.

    Nodes are ranges of documents; children follow each other. Paths without a fork are one step, and neighbours that are small together make
    one leaf. ``node_gain`` is the most that a term adds to any score beneath a node.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray):
        self.ids, self.m, self.ends, self.terms = ids, m, ends, terms
        self.doc_gain = gain(weight[terms], tfs, np.repeat(m, np.diff(ends)))
        self.low, self.high, self.children = [0], [len(m)], [(0, 0)]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if self.high[node] - self.low[node] > LEAF_ROWS:
                first = len(self.low)
                for low, high, deeper in self._cut(self.low[node], self.high[node], depth):
                    if high - low > LEAF_ROWS:
                        todo.append((len(self.low), deeper))
                    self.low.append(low)
                    self.high.append(high)
                    self.children.append((0, 0))
                self.children[node] = (first, len(self.low))
        self._sum_up(tfs, weight)

    def _cut(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Ranges of the children of the documents from low to high, which share their first ``depth`` terms."""
        a, b = (self.terms[self.ends[i] : self.ends[i + 1]] for i in (low, high - 1))
        size = min(len(a), len(b))
        apart = np.flatnonzero(a[depth:size] != b[depth:size])
        depth = depth + int(apart[0]) if len(apart) else size
        begin, end = self.ends[low:high], self.ends[low + 1 : high + 1]
        step = np.where(begin + depth < end, self.terms[np.minimum(begin + depth, len(self.terms) - 1)], -1)
        cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), high - low]
        out, held = [], low
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = x + low, y + low
            if step[x - low] < 0 or y - x <= LEAF_ROWS:
                # Equal paths that end here are leaves, however many.
                for z in range(x, y, LEAF_ROWS):
                    upto = min(z + LEAF_ROWS, y)
                    if upto - held > LEAF_ROWS and z > held:
                        out.append((held, z, depth))
                        held = z
                continue
            if x > held:
                out.append((held, x, depth))
            out.append((x, y, depth + 1))
            held = y
        return out + ([(held, high, depth)] if high > held else [])

    def _sum_up(self, tfs: np.ndarray, weight: np.ndarray) -> None:
        rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.low)
        least = np.zeros(len(self.low), np.int64)
        for v in range(len(self.low) - 1, -1, -1):
            a, b = self.children[v]
            if a == b:
                span = slice(self.ends[self.low[v]], self.ends[self.high[v]])
                terms, most, least[v] = self.terms[span], tfs[span], self.m[self.low[v] : self.high[v]].min()
            else:
                terms, most = (np.concatenate([rows[c][k] for c in range(a, b)]) for k in (0, 1))
                least[v] = least[a:b].min()
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            at = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
            rows[v] = terms[at], np.maximum.reduceat(most[order], at)
        self.node_ends = np.append(0, np.cumsum([len(t) for t, _ in rows]))
        self.node_terms = np.concatenate([t for t, _ in rows])
        self.node_gain = gain(weight[self.node_terms], np.concatenate([x for _, x in rows]), np.repeat(least, np.diff(self.node_ends)))

    def search(self, wanted: np.ndarray, best: Best) -> None:
        """Show ``best`` every document that may be among the item's best; wanted: which terms are the item's."""
        stack = [(best.least, 0)]
        while stack:
            bound, v = stack.pop()
            if bound < best.least:
                continue
            a, b = self.children[v]
            if a == b:
                lo, hi = self.low[v], self.high[v]
                score = _sums(wanted, self.terms, self.doc_gain, self.ends, lo, hi)
                fit = np.flatnonzero(score >= best.least)
                if len(fit):
                    best.add(score[fit], self.ids[lo:hi][fit])
            else:
                bounds = _sums(wanted, self.node_terms, self.node_gain, self.node_ends, a, b)
                fit = np.flatnonzero(bounds >= best.least)
                stack += [(int(bounds[i]), a + int(i)) for i in fit[np.argsort(bounds[fit], kind="stable")]]


def _sums(wanted: np.ndarray, terms: np.ndarray, gains: np.ndarray, ends: np.ndarray, a: int, b: int) -> np.ndarray:
    """Sums of the wanted terms' gains in rows a to b; no row is empty."""
    span = slice(ends[a], ends[b])
    return np.add.reduceat(np.where(wanted[terms[span]], gains[span], 0), ends[a:b] - ends[a])


class Best:
    """The ``top`` highest scores of an item, ties to the smaller id, null ids last; ``least`` is what a further document has to reach.

    ``ids`` has two columns: whether the id is null, and the id.
    """

    def __init__(self, top: int, least: int = 1):
        self.top, self.least = top, least
        self.score, self.ids = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.append(self.score, score), np.concatenate([self.ids, ids])
        order = np.lexsort((ids[:, 1], ids[:, 0], -score))[: self.top]
        self.score, self.ids = score[order], ids[order]
        if len(order) == self.top:
            self.least = max(self.least, int(self.score[-1]))


def _searched(shared, bounds, top: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees over consecutive documents; the best of all of them for each item."""
        items, weight = shared.value
        best = [Best(top, least) for least in bounds.value]
        for tree in _trees(batches, weight):
            for terms, own in zip(items, best, strict=True):
                wanted = np.zeros(len(weight), bool)
                wanted[terms] = True
                tree.search(wanted, own)
        for item, own in enumerate(best):
            if len(own.score):
                ids = pa.array(own.ids[:, 1], pa.int64(), mask=own.ids[:, 0] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), ids, pa.array(own.score)], names=["item", "doc_id", "score"])

    return searched


def _trees(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[Tree]:
    """Trees of at most TREE_ROWS documents, and of about 16 MB of vectors at most or one document."""
    held: list[pa.RecordBatch] = []

    def made() -> Tree:
        docs = pa.Table.from_batches(held).combine_chunks()
        path, tfs, given = (docs.column(c).combine_chunks() for c in ("path", "tfs", "doc_id"))
        ids = np.stack([given.is_null().to_numpy(zero_copy_only=False).astype(np.int64), given.fill_null(0).to_numpy()], 1)
        return Tree(ids, docs.column("m").to_numpy(), np.append(0, np.cumsum(_sizes(path))), path.flatten().to_numpy(), tfs.flatten().to_numpy(), weight)

    for batch in batches:
        for at in range(0, len(batch), TREE_ROWS // 8):
            part = batch.slice(at, TREE_ROWS // 8)
            if held and (sum(map(len, held)) + len(part) > TREE_ROWS or sum(b.nbytes for b in [*held, part]) > 8 * RUN_BYTES):
                yield made()
                held.clear()
            held.append(part)
    if held:
        yield made()


# --- the operator ---------------------------------------------------------------------------------


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    top: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    terms_per_block: int = TERMS_PER_BLOCK,
    seed_share: int = SEED_SHARE,
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: item_id, rank (from 1), doc_id (long), score.

    Terms are runs of ASCII letters, digits and all bytes above them, A-Z lower-cased. Of N documents with terms, which have L terms in all,
    df hold a term: its weight is floor(1000 ln((2N + 2) / (2 df + 1))). In a document of n terms it adds weight * (10^9 tf div (1000 tf + 8 m)) with
    m = 10 + 90 n N div L. Documents with a score above 0 are ranked, equal scores by ascending id, null ids last.

    Null and empty texts have no terms: such documents are not counted and such items have no rows. Each row is a document of
    its own, repeated or not; rows of one item id, null too, are one item. Very long texts and items are read whole. Statistics are over all
    documents. No documents or items: none. Other columns are ignored, whatever their names.

    Items are taken in blocks of at most ``terms_per_block`` terms (counted with repeats) or one item; each block reads the texts once.
    """
    spark = docs.sparkSession
    lowered = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), _UPPER, _LOWER)
    wanted = items.select(F.col(item_id_col).alias("item_id"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"))
    wanted = settle(wanted.where(F.size("terms") > 0).groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks, out = int(-(-size // terms_per_block)), None
    for b in range(blocks):
        found = _rank_block(texts, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), top, seed_share)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = wanted.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _rank_block(texts: DataFrame, wanted: DataFrame, top: int, seed_share: int) -> DataFrame:
    spark = texts.sparkSession
    rows = wanted.orderBy("item_id").collect()
    terms = sorted({t for r in rows for t in r.terms})
    number = {t: i for i, t in enumerate(terms)}
    words = spark.sparkContext.broadcast([t.encode("utf-8", "surrogatepass") for t in terms])
    vectors = "doc_id long, n long, terms array<int>, tfs array<long>"
    read = settle(texts.mapInArrow(_restricted(words, uuid.uuid4().hex), vectors).where("n > 0"))
    n_docs, length = read.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    # One row for each term of the block.
    for r in read.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r.t] = r.df
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df[order]], np.int64)
    ranks = spark.sparkContext.broadcast((rank, n_docs, length))
    paths = read.where(F.size("terms") > 0).mapInArrow(_paths(ranks), "doc_id long, m long, path array<int>, tfs array<long>")
    items = spark.sparkContext.broadcast(([rank[[number[t] for t in r.terms]] for r in rows], weight))
    scored = "item int, doc_id long, score long"

    def best(docs: DataFrame, least: list[int]) -> DataFrame:
        found = docs.mapInArrow(_searched(items, spark.sparkContext.broadcast(least), top), scored)
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)

    # The top-th score among some of the documents is a bound for all: a row for each item.
    some = paths.where(F.pmod(F.xxhash64("doc_id"), F.lit(seed_share)) == 0)
    least = [1] * len(rows)
    for r in best(some, least).where(F.col("rank") == top).collect():
        least[r.item] = max(1, r.score)
    sorted_paths = settle(paths.repartitionByRange("path", "doc_id").sortWithinPartitions("path"))
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"_item int, item_id {wanted.schema['item_id'].dataType.simpleString()}")
    found = best(sorted_paths, least)
    return found.join(F.broadcast(names), F.col("item") == F.col("_item")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
