"""Sharding by best-fit-decreasing bin packing.

Groups (documents with equal texts) are indivisible. Their sizes, rounded up to a few significant bits, fall into a number of
classes that the parameter bounds, whatever the table's size, and only the classes' counts reach the driver. Classes by
falling size enter the bin with the tightest remaining capacity, found in a balanced tree: the tightest
bin stays the tightest while it has room, so it takes as many of a class as fit at once, as it would one by one. A group's bin
follows from its rank in its class.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from testimony.llm.common import broadcast_if_small, settle

#: Rows of one slot range, and groups of one rank range, on average.
ROWS_PER_RANGE = 50_000


class Treap:
    """Balanced search tree of (remaining capacity, bin); nodes are [key, priority, left, right]."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.dice = random.Random(3)

    def _split(self, t, key):
        """Trees of the keys under ``key`` and of the others."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.dice.random(), None, None]), right)

    def take_at_least(self, key: tuple) -> tuple | None:
        """Remove and return the least key not under ``key``."""
        t, found = self.root, None
        while t is not None:
            if t[0] >= key:
                found, t = t[0], t[2]
            else:
                t = t[3]
        if found is not None:
            left, right = self._split(self.root, found)
            _, right = self._split(right, (found[0], found[1] + 1))
            self.root = self._merge(left, right)
        return found


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For (size, count) in falling order of size the bins (bin, how many) of at most ``capacity``, and the number of bins.

    A size beyond the capacity gets bins of its own.
    """
    tree, bins, used = Treap(), [], 0
    for size, n in items:
        own = []
        while n:
            found = tree.take_at_least((size, -1))
            left, at = found if found else (max(capacity, size), used)
            used += found is None
            k = min(n, left // size)
            tree.add((left - size * k, at))
            own.append((at, k))
            n -= k
        bins.append(own)
    return bins, used


def pack(items: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """Size -> bins (bin, how many), all in 0..shards-1, by the least tried capacity that needs no more bins.

    ``items`` are (size, count), sizes over 0 and once each. A group of more than an even share takes a shard alone and the rest share the others.
    """
    items = sorted(items, reverse=True)
    out: dict[int, list[tuple[int, int]]] = {size: [] for size, _ in items}
    alone, rest = 0, sum(s * n for s, n in items)
    while items and alone < shards - 1 and items[0][0] * (shards - alone) > rest:
        size, n = items[0]
        out[size].append((alone, 1))
        items = [(size, n - 1), *items[1:]] if n > 1 else items[1:]
        rest -= size
        alone += 1
    if not items:
        return out
    n = shards - alone
    low = max(items[0][0], math.ceil(rest / n))
    high = low + items[0][0]
    best, used = best_fit_decreasing(items, high)
    while used > n:
        high += items[0][0]
        best, used = best_fit_decreasing(items, high)
    while high - low > max(1, low // 4000):
        mid = (low + high) // 2
        bins, used = best_fit_decreasing(items, mid)
        if used <= n:
            best, high = bins, mid
        else:
            low = mid + 1
    for (size, _), own in zip(items, best, strict=True):
        out[size] += [(alone + b, k) for b, k in own]
    return out


def shard(
    docs: DataFrame,
    *,
    shards: int = 24,
    capacity: int | None = None,
    digits: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, text_key, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 8. Equal texts share a shard. There are ``shards`` shards of sizes as near
    equal as packing makes them or, with ``capacity``, as few of at most that many bytes as it finds. Slots of a shard run from 0
    without gaps, in the order of hashed id ranges, then id. Groups' sizes are packed with ``digits``
    significant bits, rounded up, so a shard may have up to 2^(1 - digits) of its size less than it is taken for.

    Null text has no bytes, crc32 0, and null texts are one group, as empty texts are. Repeated rows
    each take a slot. One group of more than an even share fills a shard alone, as does one beyond the capacity. Very long texts
    only count by their size. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("-")).alias("text_key"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    count, groups = rows.count(), rows.groupBy("text_key").agg(F.sum("size").alias("size"))
    places = _places(groups, shards, capacity, digits)
    shards = shards if capacity is None else int(places.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]) + 1
    ranges = max(8, count // (shards * ROWS_PER_RANGE) + 1)
    placed = settle(
        rows.join(broadcast_if_small(places), "text_key").select(
            "doc_id", "size", "text_crc32", "text_key", "_row", "shard",
            F.pmod(F.xxhash64(F.coalesce("doc_id", "_row")), F.lit(ranges)).cast("int").alias("_range"),
        )
    )
    upto = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_range").agg(F.count("*").alias("n")).select("shard", "_range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("shard", "_range").orderBy("doc_id", "text_key", "_row")
    slots = placed.withColumn("_at", F.row_number().over(inner) - 1).join(broadcast_if_small(starts, shards * ranges), ["shard", "_range"])
    return slots.select(
        "doc_id", "size", "text_crc32", "text_key", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _places(groups: DataFrame, shards: int, capacity: int | None, digits: int) -> DataFrame:
    """(text_key, shard) of groups (text_key, size)."""
    unit = f"shiftleft(1L, greatest(0, length(bin(size)) - {digits}))"
    sized = groups.select("text_key", F.expr(f"((size + {unit} - 1) div {unit}) * {unit}").alias("class"), F.xxhash64("text_key").alias("_hash"))
    sized = settle(sized)
    # At most 2^digits classes for each power of two.
    counts = [(r["class"], r.n) for r in sized.groupBy("class").agg(F.count("*").alias("n")).toLocalIterator()]
    if capacity is None:
        packed = pack(counts, shards)
    else:
        order = sorted(counts, reverse=True)
        packed = dict(zip((s for s, _ in order), best_fit_decreasing(order, capacity)[0], strict=True))
    rows = []
    for size, own in packed.items():
        upto, cuts = 0, []
        for at, k in own:
            upto += k
            cuts.append((upto, at))
        rows.append((size, cuts))
    plan = groups.sparkSession.createDataFrame(rows, "class long, cuts array<struct<upto:long,bin:int>>")
    # A group's rank in its class: ranges of hashes are numbered apart, and start after those before.
    bits = max(1, (sum(n for _, n in counts) // ROWS_PER_RANGE).bit_length() + 1)
    ranged = sized.withColumn("_range", F.shiftright("_hash", 64 - bits).cast("int"))
    upto = Window.partitionBy("class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("class", "_range").agg(F.count("*").alias("n")).select("class", "_range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("class", "_range").orderBy("_hash", "text_key")
    ranked = ranged.withColumn("_at", F.row_number().over(inner)).join(broadcast_if_small(starts), ["class", "_range"])
    ranked = ranked.select("text_key", "class", (F.col("_start") + F.col("_at")).alias("_rank")).join(broadcast_if_small(plan), "class")
    return settle(ranked.select("text_key", F.expr("get(filter(cuts, c -> c.upto >= _rank), 0).bin").alias("shard")))
