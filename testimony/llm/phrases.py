"""Phrases by bidirectional word indexes, and collocations among them.

Texts are cut into pieces and words. A task numbers the words of about ``shard_bytes`` of texts of one language and keeps their Burrows-Wheeler
transform forwards and backwards, sorted as deep as the longest phrase. A phrase is a range of rows of either; one step widens all phrases of a length by every word that
follows them (or stands before them), which gives the counts of the phrases one longer and their ranges in both directions. Counts are summed
across shards after each step, and only phrases whose parts are frequent over all shards are widened further; a bitmap of bounded size tells most of the others, and
those that it lets through are dropped by their sums.

Words are 64-bit hashes of language and word, which are checked to be unlike for all words of the corpus; if two are alike, all is done with others.
The most frequent words, a bounded number, go by their ranks instead, which are below all hashes in use and take few bytes where phrases are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.llm.common import Bitmap, Words, bitmap_of, broadcast_if_small, mix, settle, split_words, stop_bytes, text_slices, word_hashes

#: Bytes of the texts of one index, about; a longer text is an index of its own.
SHARD_BYTES = 1 << 20
#: Bits of a bitmap at most: 64 MB.
MAP_BITS = 29
#: So many words at most go by their ranks: 2 MB.
RANKED = 1 << 18
#: Languages are ranked in so many parts before they are ranked whole.
_PARTS = 256
_BREAKS = stop_bytes((0x0A, 0x0D), *((b, b) for b in b".,;:!?"))
_STOPS = _BREAKS | stop_bytes((0x20, 0x20), (0x09, 0x09))
_INDEX = "lang string, clash boolean, salt long, names array<binary>, size int, forward binary, backward binary"
_SCHEMA = pa.schema([("lang", pa.string()), ("clash", pa.bool_()), ("salt", pa.int64()), ("names", pa.list_(pa.binary())), ("size", pa.int32()), ("forward", pa.binary()), ("backward", pa.binary())])


# --- indexes --------------------------------------------------------------------------------------


def sorted_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of whole numbers from 0, equal ones by place, and the places in that order where a new pair begins."""
    bits = [int(x.max(initial=0)).bit_length() for x in (first, second)] + [len(first).bit_length()]
    if sum(bits) < 64:
        # One sort of plain numbers that hold pair and place.
        code = np.sort((first.astype(np.int64) << (bits[1] + bits[2])) | (second.astype(np.int64) << bits[2]) | np.arange(len(first)))
        pair = code >> bits[2]
        return code & ((1 << bits[2]) - 1), np.append(True, pair[1:] != pair[:-1])[: len(first)]
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(first)]


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes sorted by their first ``depth`` symbols (rounded up to a power of two)."""
    rank, step = text, 1
    order = np.argsort(text, kind="stable") if depth < 2 else None
    while step < depth:
        after = np.append(rank[step:], np.zeros(min(step, len(rank)), rank.dtype))
        order, new = sorted_pairs(rank, after)
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    return text[order - 1].astype(np.int32)


def spread(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of word hashes."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ c.view(np.uint64))
    return out


def packed(symbols: np.ndarray) -> bytes:
    """Compressed whole numbers of 32 bits: their first bytes, then their second bytes, and so on."""
    return pa.compress(np.ascontiguousarray(symbols.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * size, codec="zstd"), np.uint8).reshape(4, size)
    return np.ascontiguousarray(planes.T).view(np.int32).reshape(size)


class Ranks:
    """Ranks of the most frequent words; ``data`` is a broadcast variable of their hashes, sorted, and the rank of each."""

    def __init__(self, data):
        self.data = data

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each hash, and hashes without a rank as they are."""
        ranked, ranks = self.data.value
        if not len(ranked):
            return hashes
        at = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
        return np.where(ranked[at] == hashes, ranks[at], hashes)


def hashes_of(names: pa.ListScalar, salt: pa.Scalar) -> np.ndarray:
    """Hashes of the words of an index, which are hashed where they lie."""
    held = names.values.cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    joined = np.append(np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.zeros(9, np.uint8))
    return word_hashes(Words(joined, ends[:-1] - ends[0], np.diff(ends), np.zeros(0, np.int64)), salt.as_py())


def index(lang: str, texts: list[bytes], seed: int, depth: int) -> pa.RecordBatch | None:
    """The index of some texts of one language; none if they have no words."""
    words = split_words(texts, _STOPS, fold=True, glue=b"\n")
    if not len(words.starts):
        return None
    salt = int.from_bytes(hashlib.blake2b(f"{seed} {lang}".encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
    _, first, number, often = np.unique(word_hashes(words, salt), return_index=True, return_inverse=True, return_counts=True)
    # Frequent words have small numbers, which compress well.
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first, number = first[order], rank[number]
    clash = not words.same(np.arange(len(number)), words, first[number]).all()
    breaks = np.cumsum(_BREAKS[words.joined], dtype=np.int32)
    new = np.append(True, breaks[words.starts[1:]] != breaks[words.starts[:-1]])
    # 0 stands between pieces, at the start and at the end.
    text = np.zeros(len(number) + int(new.sum()) + 1, np.int32)
    text[np.arange(len(number)) + np.cumsum(new)] = number + 1
    row = [lang, clash, salt, [words.bytes_of(i) for i in first.tolist()], len(text), packed(transform(text, depth)), packed(transform(text[::-1], depth))]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)


def _indexed(seed: int, depth: int, shard_bytes: int):
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def made(lang: str) -> Iterator[pa.RecordBatch]:
            del size[lang]
            if (row := index(lang, held.pop(lang), seed, depth)) is not None:
                yield row

        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for texts in text_slices(batch.column(1)):
                for lang, text in zip(langs[at : at + len(texts)], texts, strict=True):
                    held[lang].append(text)
                    size[lang] += len(text)
                    if size[lang] >= shard_bytes:
                        yield from made(lang)
                at += len(texts)
                # Many languages: the largest goes first, so that no task holds more than a few shards.
                while sum(size.values()) > 4 * shard_bytes:
                    yield from made(max(size, key=size.get))
        for lang in list(held):
            yield from made(lang)

    return indexed


class Direction:
    """One transform, and where the suffix that is one symbol longer stands for each row."""

    def __init__(self, symbols: np.ndarray, many: int):
        self.symbols, self.starts = symbols, np.append(0, np.cumsum(np.bincount(symbols, minlength=many)))
        bits = len(symbols).bit_length()
        order = np.sort((symbols.astype(np.int64) << bits) | np.arange(len(symbols))) & ((1 << bits) - 1)
        self.longer = np.empty(len(symbols), np.int64)
        self.longer[order] = np.arange(len(symbols))


class Phrases:
    """Phrases of one length in one index: columns of word numbers, first rows in both directions, and counts."""

    def __init__(self, words: list[np.ndarray], forward: np.ndarray, backward: np.ndarray, count: np.ndarray):
        self.words, self.forward, self.backward, self.count = words, forward, backward, count

    def only(self, ok: np.ndarray) -> Phrases:
        return Phrases([w[ok] for w in self.words], self.forward[ok], self.backward[ok], self.count[ok])


class Shard:
    """An index in both directions. Words have numbers from 1; 0 stands between pieces."""

    def __init__(self, row: dict[str, pa.Scalar], ranks: Ranks | None = None):
        hashes = hashes_of(row["names"], row["salt"])
        self.codes = np.append(np.uint64(0), ranks.codes(hashes) if ranks else hashes)
        self.forward, self.backward = (Direction(unpacked(row[c].as_buffer(), row["size"].as_py()), len(self.codes)) for c in ("forward", "backward"))

    def words(self) -> Phrases:
        number = np.arange(1, len(self.codes))
        starts = self.forward.starts
        return Phrases([number], starts[number], starts[number], starts[number + 1] - starts[number])

    def widen(self, phrases: Phrases, right: bool, known: Bitmap) -> Phrases:
        """Phrases one word longer at the right (or left), with their ranges in both directions: all of which the part without the old far word is known.

        The rows of a phrase in the backward index hold the words after it. Those of one word are a phrase: the first of them tells where it begins
        backwards, and how many rows of the phrase hold lesser words tells it forwards. To the left the two change roles.
        """
        own, other = (phrases.backward, phrases.forward) if right else (phrases.forward, phrases.backward)
        index = self.backward if right else self.forward
        ends = np.cumsum(phrases.count)
        begin = ends - phrases.count
        owner = np.repeat(np.arange(len(own)), phrases.count)
        rows = np.arange(len(owner)) + (own - begin)[owner]
        order, new = sorted_pairs(owner, index.symbols[rows])
        at = np.flatnonzero(new)
        count, first = np.diff(np.append(at, len(owner))), rows[order[at]]
        owner, word = owner[order[at]], index.symbols[first]
        real = np.flatnonzero(word > 0)
        kept = [w[owner[real]] for w in phrases.words]
        kept = [*kept, word[real]] if right else [word[real], *kept]
        ok = known.has(spread([self.codes[w] for w in (kept[1:] if right else kept[:-1])]))
        real, kept = real[ok], [w[ok] for w in kept]
        mine, its = index.longer[first[real]], other[owner[real]] + at[real] - begin[owner[real]]
        return Phrases(kept, *((its, mine) if right else (mine, its)), count[real])


def frequent_phrases(shard: Shard, maps: list[Bitmap]) -> Phrases:
    """Phrases of len(maps) + 1 words of which every part of n words is in the n-th map: words are widened to the right, pairs to the left, and so on in turn."""
    found = shard.words()
    for n, known in enumerate(maps, 1):
        # Parts of n words of phrases one longer: the phrase itself, and the one without its far word.
        found = found.only(known.has(spread([shard.codes[w] for w in found.words])))
        found = shard.widen(found, n % 2 == 1, known)
    return found


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            word = hashes_of(batch.column("names")[i], batch.column("salt")[i]).view(np.int64)
            n = np.bincount(unpacked(batch.column("forward")[i].as_buffer(), batch.column("size")[i].as_py()), minlength=len(word) + 1)[1:]
            columns = [pa.array([lang] * len(word), pa.string()), pa.array(word), batch.column("names")[i].values.cast(pa.string()), pa.array(n)]
            yield from _in_parts(columns, ["lang", "w1", "word", "f"])


#: Rows of a batch that is sent back.
_SENT_ROWS = 20_000


def _in_parts(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for i in range(0, len(whole), _SENT_ROWS):
        yield whole.slice(i, _SENT_ROWS)


def _counted(maps: list[Bitmap], ranks: Ranks):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard({c: batch.column(c)[i] for c in ("salt", "names", "size", "forward", "backward")}, ranks)
                found = frequent_phrases(shard, maps)
                columns = [pa.array(shard.codes[w].view(np.int64)) for w in found.words]
                columns.append(pa.array(found.count))
                del shard, found
                yield from _in_parts(columns, [*[f"w{k + 1}" for k in range(len(columns) - 1)], "f"])

    return counted


def _spread_col(names: list[str]):
    @F.arrow_udf("long")
    def of(*columns: pa.Array) -> pa.Array:
        return pa.array(spread([c.to_numpy(zero_copy_only=False) for c in columns]).view(np.int64))

    return of(*names)


def _coded(ranks: Ranks, name: str) -> Column:
    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(ranks.codes(column.to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))

    return of(name)


# --- the operator ---------------------------------------------------------------------------------


def mine_phrases(
    docs: DataFrame, *, longest: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals) of all texts.

    words: lang, w1 (its code), word, f of every word with f >= least. phrases: size, key (its words' w1 in order) and f of every phrase of 1 to ``longest`` words of one piece that occurs
    ``least`` times or more in a language; occurrences may overlap. totals: lang and n, all its words. Null languages are 'und'.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    while True:
        shards = settle(texts.mapInArrow(_indexed(seed, longest, shard_bytes), _INDEX))
        every = settle(shards.select("lang", "salt", "names", "size", "forward").mapInArrow(_counted_words, "lang string, w1 long, word string, f long").groupBy("lang", "w1", "word").agg(F.sum("f").alias("f")))
        alike = every.groupBy("w1").count().where("count > 1")
        # No hash may be alike to a rank.
        if shards.where("clash").isEmpty() and alike.isEmpty() and every.where(F.col("w1").between(0, RANKED - 1)).isEmpty():
            break
        seed += 1
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = settle(every.where(F.col("f") >= least))
    most = words.orderBy(F.desc("f"), "w1").limit(RANKED).select("w1").toArrow().column(0).to_numpy().view(np.uint64)
    order = np.argsort(most)
    ranks = Ranks(docs.sparkSession.sparkContext.broadcast((most[order], order.astype(np.uint64))))
    words = settle(words.withColumn("w1", _coded(ranks, "w1")))
    tables, maps = [words.select("w1", "f")], []
    for size in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(size)]
        known = tables[-1].select(_spread_col(names[:-1]).alias("h"))
        maps.append(bitmap_of(known, "h", MAP_BITS))
        schema = ", ".join(f"{n} long" for n in [*names, "f"])
        found = shards.select("salt", "names", "size", "forward", "backward").mapInArrow(_counted(list(maps), ranks), schema).groupBy(*names).agg(F.sum("f").alias("f"))
        tables.append(settle(found.where(F.col("f") >= least)))
    phrases = None
    for size, found in enumerate(tables, 1):
        part = found.select(F.lit(size).alias("size"), F.array(*[f"w{i + 1}" for i in range(size)]).alias("key"), "f")
        phrases = part if phrases is None else phrases.unionByName(part)
    return words, phrases, totals


def _exact(c: str | Column, times: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)") * F.lit(times).cast("decimal(10,0)")


def collocations(
    docs: DataFrame, *, longest: int = 4, least: int = 30, share: int = 80, top: int = 2_000, lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A candidate is a phrase of 2 to ``longest`` words of one piece that occurs a >= ``least`` times. Cut after its first k words it has
    score floor(2000000 a / (l + r)), with l and r the counts of the two parts; the lowest-scoring cut counts, ties to the smallest k. A candidate inside a longer one that has
    at least ``share`` per cent of its occurrences is dropped. Ranked by score, then a, both falling, then phrase in byte order. Sums and products are exact.

    A-Z is lower-cased; pieces end at . , ; : ! ? and line ends; words are separated by spaces and tabs. Null languages are 'und', which is also a name.
    Null and empty texts have no words; repeated rows count each. Very long texts are read whole, and make one index each. No documents: an empty result.
    Other columns are ignored, whatever their names.
    """
    words, phrases, totals = mine_phrases(docs, longest=longest, least=least, lang_col=lang_col, text_col=text_col, shard_bytes=shard_bytes)
    longer = phrases.where("size > 2")
    # A candidate's share in phrases of more words is at most its share in those of one word more.
    around = longer.select(F.explode(F.array(F.expr("slice(key, 1, size - 1)"), F.expr("slice(key, 2, size - 1)"))).alias("key"), "f")
    around = settle(around.groupBy("key").agg(F.max("f").alias("most")))
    kept = phrases.where("size > 1").join(broadcast_if_small(around), "key", "left")
    kept = kept.where(F.col("most").isNull() | (_exact("most", 100) < _exact("f", share))).select("key", "size", F.col("f").alias("a"))
    cut = kept.select("key", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"), "size")
    cut = cut.select("key", "a", "k", F.expr("slice(key, 1, k)").alias("_left"), F.expr("slice(key, k + 1, size - k)").alias("_right"))
    known = settle(phrases)
    left, right = (broadcast_if_small(known.select(F.col("key").alias(f"_{side}"), F.col("f").alias(f))) for side, f in (("left", "l"), ("right", "r")))
    cut = cut.join(left, "_left").join(right, "_right")
    cut = cut.withColumns({"_over": _exact("a", 2_000_000), "_under": F.col("l").cast("decimal(20,0)") + F.col("r")}).withColumn("score", F.expr("_over div _under"))
    best = settle(cut.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("key", "a", "b.score", "b.l", "b.r"))
    spelt = best.select("*", F.posexplode("key").alias("_at", "w1")).join(broadcast_if_small(words.select("lang", "w1", "word")), "w1")
    spelt = spelt.groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "word"))), lambda x: x.word), " ").alias("phrase"),
        *[F.first(c).alias(c) for c in ("a", "l", "r", "score")],
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spelt = spelt.withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(_PARTS)))
    spelt = spelt.withColumn("_first", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_first") <= top)
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(broadcast_if_small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
