"""Pieces that several operators share: word hashing, approximate sets, batches cut by group, slices of texts.

Words are runs of bytes other than 0x20 and 0x09-0x0D, and are hashed for many texts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.operators.durable import broadcast_if_small, settle, shared_dir  # noqa: F401  (used by the operators)
from testimony.operators.graphs import connected as components  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted batches cut between groups of equal keys, each with where its groups start and the end."""
    held: list[pd.DataFrame] = []
    for pdf in _and_end(batches):
        if pdf is not None:
            held.append(pdf)
            # A batch that goes on with the held group alone has no cut.
            if len(held) > 1 and (pdf[keys].iloc[-1] == held[0][keys].iloc[-1]).all():
                continue
        if not held:
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        k = rows[keys].to_numpy()
        starts = np.append(0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)
        cut = len(rows) if pdf is None else int(starts[-1])
        held = [] if pdf is None else [rows.iloc[cut:].reset_index(drop=True)]
        if cut:
            yield rows.iloc[:cut], np.append(starts[starts < cut], cut)


def _and_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from (b for b in batches if len(b))
    yield None


# --- approximate sets of a bounded size -------------------------------------------------------------


class Bitmap:
    """Which 64-bit values may be in a set: a bit for each by its low bits. A miss is certain, a hit is not.

    ``data`` is a broadcast variable of the bits.
    """

    def __init__(self, data, bits: int):
        self.data, self.bits = data, bits

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        byte = np.frombuffer(self.data.value, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
        return (byte >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_of(values: DataFrame, col: str, most_bits: int, per_value: int = 16) -> Bitmap:
    """A bitmap of the values of a long column, ``per_value`` bits each, but 2^most_bits bits at most.

    2^(bits - 15) rows of 4 KB reach the driver.
    """
    n = values.count()
    bits = min(most_bits, max(15, (per_value * n).bit_length()))
    at = F.col(col).bitwiseAND((1 << bits) - 1)
    maps = values.groupBy(F.shiftright(at, 15).cast("int").alias("slot")).agg(F.bitmap_construct_agg(at.bitwiseAND(0x7FFF)).alias("bits"))
    data = bytearray(1 << (bits - 3))
    for r in maps.toLocalIterator():
        data[r.slot * 4096 : r.slot * 4096 + len(r.bits)] = r.bits
    return Bitmap(values.sparkSession.sparkContext.broadcast(bytes(data)), bits)


# --- words of many texts at once ------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed in runs of about this many bytes, which bounds a worker's memory.
RUN_BYTES = 1 << 21
#: Words up to this many bytes are hashed together, 8 bytes of all at a time; longer ones one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(found: Words, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words: every 8 bytes go through ``mix`` in turn, so words of up to 8 bytes and of one length never collide."""
    starts, sizes = found.starts, found.sizes
    words = mix(sizes.astype(np.uint64) + np.uint64(seed % (1 << 32) * int(_K) % (1 << 64)))
    for k in range(0, min(int(sizes.max(initial=0)), LONG_WORD), 8):
        at = np.flatnonzero(sizes > k) if k else slice(None)
        words[at] = mix(words[at] * _K ^ piece(found.eight, starts[at], sizes[at], k))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        made = hashlib.blake2b(found.bytes_of(i), digest_size=8, salt=(seed % (1 << 32)).to_bytes(8, "little"))
        words[i] = int.from_bytes(made.digest(), "little")
    return words


def eights(joined: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    return np.ndarray((len(joined) - 7,), "<u8", joined.tobytes(), 0, (1,))


def piece(eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes k to k + 8 of words longer than k; what lies beyond a word is 0."""
    rest = np.minimum(sizes - k, 8).astype(np.uint64)
    return eight[starts + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))


def hashed_words(texts: list[bytes], fold: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and where each text's words end.

    ``fold`` hashes A-Z as a-z. Every 8 bytes of a word go through ``mix`` in turn, so words of up to 8 bytes
    and of one length never collide, and others only by chance, which ``seed`` draws anew.
    """
    found = split_words(texts, _SPACE, fold)
    return word_hashes(found, seed), found.ends


class Words:
    """Words of several texts: ``joined`` bytes, where words start in it and their sizes, and where each text's words end."""

    def __init__(self, joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray):
        self.joined, self.starts, self.sizes, self.ends = joined, starts, sizes, ends
        self.eight = eights(joined)

    def bytes_of(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()

    def same(self, at: np.ndarray, other: Words, to: np.ndarray) -> np.ndarray:
        """Whether the words ``at`` are, byte for byte, the words ``to`` of ``other``."""
        ok = self.sizes[at] == other.sizes[to]
        for k in range(0, int(self.sizes[at].max(initial=0)), 8):
            go = np.flatnonzero(ok & (self.sizes[at] > k))
            if not len(go):
                break
            a, b = at[go], to[go]
            ok[go] = piece(self.eight, self.starts[a], self.sizes[a], k) == piece(other.eight, other.starts[b], other.sizes[b], k)
        return ok


def split_words(texts: list[bytes], stops: np.ndarray, fold: bool = False, glue: bytes = b" ") -> Words:
    """The words between stops, a table of the 256 bytes; ``glue`` is a stop and stands between texts."""
    joined = np.frombuffer(glue + glue.join(texts) + glue * 9, np.uint8)
    if fold:
        joined = _FOLD[joined]
    stop = stops[joined]
    edge = np.flatnonzero(stop[1:] != stop[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    length = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    return Words(joined, starts, ends - starts, np.searchsorted(starts, np.cumsum(length) + 1, "left") if len(texts) else np.zeros(0, np.int64))


def stop_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the 256 bytes in which those of the ranges, ends included, are set."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


class Vocabulary:
    """Numbers 0, 1, ... of given words, looked up for all words of many texts at once and confirmed byte for byte."""

    def __init__(self, words: list[bytes], stops: np.ndarray):
        # Each is a text of one word, so words and texts have the same numbers.
        self.words, self.stops, self.seed = split_words(words, stops), stops, 0
        if len(self.words.starts) != len(words):
            raise ValueError("a vocabulary holds single words")
        while len(np.unique(hashed := word_hashes(self.words, self.seed))) < len(words):
            self.seed += 1
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        self.first = np.zeros(1 << 16, bool)
        self.first[(hashed & np.uint64(0xFFFF)).astype(np.int64)] = True

    def number(self, found: Words) -> np.ndarray:
        """The number of each word, -1 for others."""
        out = np.full(len(found.starts), -1, np.int64)
        if not len(self.hashed) or not len(out):
            return out
        hashed = word_hashes(found, self.seed)
        at = np.flatnonzero(self.first[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
        to = np.minimum(np.searchsorted(self.hashed, hashed[at]), len(self.hashed) - 1)
        hit = self.hashed[to] == hashed[at]
        at, to = at[hit], self.order[to[hit]]
        ok = found.same(at, self.words, to)
        out[at[ok]] = to[ok]
        return out


def runs_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about RUN_BYTES; a longer text stands alone."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > RUN_BYTES:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def utf8(column) -> list[bytes]:
    """The texts of a pandas column as UTF-8; null becomes empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]


#: Texts that a scan turns into Python objects at once, whatever the size of the batch that it is sent.
ROWS_AT_ONCE = 500


def text_slices(column: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts of an Arrow column as UTF-8, ROWS_AT_ONCE at a time; nothing is decoded and the batch is not copied."""
    for i in range(0, len(column), ROWS_AT_ONCE):
        yield column.slice(i, ROWS_AT_ONCE).cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def map_slices(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInPandas(fn, schema)`` for tables with texts: ``fn`` gets ROWS_AT_ONCE rows of a batch at a time.

    So a worker's memory does not depend on the session's size of batches. Whole numbers stay whole where others are null.
    The schema's types are those of ``_ARROW``.
    """
    made = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def small(batch: pa.RecordBatch) -> pd.DataFrame:
        whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
        return pd.DataFrame({n: c.to_pandas(types_mapper=whole.get if c.null_count else None) for n, c in zip(batch.schema.names, batch.columns, strict=True)})

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE))
        for pdf in fn(small(p) for p in parts):
            yield pa.RecordBatch.from_pandas(pdf, schema=made, preserve_index=False)

    return df.mapInArrow(sliced, schema)
