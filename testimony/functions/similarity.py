"""Jaro similarity and the name comparisons built on it, as vectorised helpers, and the join that finds similar strings.

Spark has no Jaro. The helpers run on distinct or pruned pairs only, and compare a batch of pairs letter by letter at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from testimony.operators.durable import broadcast_if_small, settle


def jaro_of(a: str, b: str) -> float:
    """Textbook Jaro: equal strings 1.0, one empty 0.0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


#: Longer strings are compared one pair at a time.
_WIDE = 128


def _letters(texts: list[str]) -> np.ndarray:
    data = np.array(texts, dtype=str)
    return data.view(np.uint32).reshape(len(texts), -1) if data.dtype.itemsize else np.zeros((len(texts), 0), np.uint32)


def jaro_pairs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Jaro of each pair; as ``jaro_of``, for all pairs at once."""
    out = np.zeros(len(a))
    la, lb = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    nul = np.fromiter(("\0" in x or "\0" in y for x, y in zip(a, b, strict=True)), bool, len(a))
    one = (np.maximum(la, lb) > _WIDE) | nul
    for i in np.flatnonzero(one).tolist():
        out[i] = jaro_of(a[i], b[i])
    at = np.flatnonzero(~one & (la > 0) & (lb > 0))
    out[(la == 0) & (lb == 0)] = 1.0
    if not len(at):
        return out
    x, y, la, lb = _letters([a[i] for i in at]), _letters([b[i] for i in at]), la[at], lb[at]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used, met = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    column, rows = np.arange(y.shape[1]), np.arange(len(at))
    for i in range(x.shape[1]):
        fit = (y == x[:, i : i + 1]) & ~used & (np.abs(column[None, :] - i) <= reach[:, None]) & (column[None, :] < lb[:, None]) & (i < la)[:, None]
        first = fit.argmax(axis=1)
        hit = fit[rows, first]
        used[rows[hit], first[hit]] = True
        met[hit, i] = True
    m = met.sum(axis=1)
    most = int(m.max(initial=0))
    # Matched letters of both sides in their orders, side by side.
    left = np.take_along_axis(x, np.argsort(~met, axis=1, kind="stable")[:, :most], 1)
    right = np.take_along_axis(y, np.argsort(~used, axis=1, kind="stable")[:, :most], 1)
    moved = ((left != right) & (np.arange(most)[None, :] < m[:, None])).sum(axis=1) // 2
    some = m > 0
    m, la, lb, t = m[some], la[some], lb[some], moved[some]
    out[at[some]] = (m / la + m / lb + (m - t) / m) / 3
    return out


def _best_means(wanted: list[list[str]], found: list[list[str]]) -> np.ndarray:
    """For each pair of lists the mean, over the words wanted, of the best Jaro among those found; 0 with an empty list."""
    n = [len(w) * len(f) for w, f in zip(wanted, found, strict=True)]
    left = [x for w, f in zip(wanted, found, strict=True) for x in w for _ in f]
    right = [y for w, f in zip(wanted, found, strict=True) for _ in w for y in f]
    score, at, out = jaro_pairs(left, right), 0, np.zeros(len(n))
    for i, k in enumerate(n):
        if k:
            best = score[at : at + k].reshape(len(wanted[i]), -1).max(axis=1).tolist()
            out[i] = sum(best) / len(best)
        at += k
    return out


def _lists(c: pd.Series) -> list[list[str]]:
    return [[] if x is None else list(x) for x in c]


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = jaro_pairs(a[known].tolist(), b[known].tolist())
    return pd.Series(out).astype("Float64").where(known)


@F.pandas_udf(DoubleType())
def word_recall(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean over the shorter list's words of the best Jaro in the longer; 0 with an empty list."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(_lists(a), _lists(b), strict=True)]
    return pd.Series(_best_means([x for x, _ in pairs], [y for _, y in pairs]))


@F.pandas_udf(DoubleType())
def directed_recall(wanted: pd.Series, found: pd.Series) -> pd.Series:
    """Mean over ``wanted`` words of the best Jaro among ``found``."""
    return pd.Series(_best_means(_lists(wanted), _lists(found)))


@F.pandas_udf(BooleanType())
def same_by_position(a: pd.Series, b: pd.Series) -> pd.Series:
    """Phonetic name words: first words sound alike (0.9), and all of the shorter rest is in the longer's rest."""
    alike = lambda x, y: jaro_of(x, y) >= 0.9

    def same(x, y) -> bool:
        if len(x) < 2 or len(y) < 2 or not alike(x[0], y[0]):
            return False
        short, long = sorted((x[1:], y[1:]), key=len)
        return all(any(alike(w, v) for v in long) for w in short) or alike("".join(short), "".join(long))

    return pd.Series([x is not None and y is not None and same(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def name_closeness(a: Column, b: Column) -> Column:
    """Of two reduced names: the better of Jaro with and without their spaces."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.greatest(jaro(a, b), jaro(bare(a), bare(b)))


# --- the join of similar strings ------------------------------------------------------------------------------

#: Strings of one block on average; every pair of blocks whose lengths allow it is one piece of work.
BLOCK = 1_024
#: Letters are counted in so many classes, and up to so many of a class exactly.
_CLASSES, _LEVELS = 61, 7
_PAIRS_AT_ONCE = 50_000


class Profile:
    """How often each class of letters occurs in strings. Two strings have no more letters in common than their counts have."""

    def __init__(self, texts: list[str]):
        self.texts, self.sizes = texts, np.fromiter(map(len, texts), np.int64, len(texts))
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        counts = np.bincount(owner * _CLASSES + letters % _CLASSES, minlength=len(texts) * _CLASSES).reshape(-1, _CLASSES)
        self.bits = (counts[:, :, None] > np.arange(_LEVELS)).reshape(len(texts), -1)
        self.over = np.maximum(counts - _LEVELS, 0).sum(axis=1)

    def common(self, other: Profile) -> np.ndarray:
        """At most so many letters are common to each of these strings and each of the others."""
        used = np.flatnonzero(self.bits.any(axis=0) & other.bits.any(axis=0))
        shared = self.bits[:, used].astype(np.float32) @ other.bits[:, used].astype(np.float32).T
        return shared + np.minimum.outer(self.over, other.over) if self.over.any() and other.over.any() else shared


def candidates(a: Profile, b: Profile, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may have a Jaro of ``least``: it is at most (m / |a| + m / |b| + 1) / 3 with m common letters."""
    la, lb = a.sizes[:, None], b.sizes[None, :]
    fit = a.common(b) * (la + lb) >= (3 * least - 1) * la * lb - 1e-6 * (la * lb + 1)
    fit &= (np.minimum(la, lb) >= (3 * least - 2) * np.maximum(la, lb) - 1e-9) & ((la > 0) == (lb > 0))
    return np.nonzero(fit)


def _compared(keys: list[str], by: list[str], least: float):
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by block pair and side: the first side of a pair is held, the second passes by."""
        at, held, own = None, [], None
        for pdf in batches:
            change = (pdf[keys] != pdf[keys].shift()).any(axis=1) | (pdf["_side"] != pdf["_side"].shift())
            starts = np.flatnonzero(change.to_numpy())
            for i, j in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
                key, texts = tuple(pdf[keys].iloc[i]), pdf["_s"].iloc[i:j].tolist()
                if key != at:
                    at, held, own = key, [], None
                if pdf["_side"].iloc[i] == 0:
                    held += texts
                    continue
                own = own or Profile(held)
                for k in range(0, len(texts), BLOCK):
                    other = Profile(texts[k : k + BLOCK])
                    x, y = candidates(own, other, least)
                    for c in range(0, len(x), _PAIRS_AT_ONCE):
                        a, b = ([side.texts[n] for n in z[c : c + _PAIRS_AT_ONCE]] for side, z in ((own, x), (other, y)))
                        score = jaro_pairs(a, b)
                        ok = np.flatnonzero(score >= least)
                        said = {"a": [a[n] for n in ok], "b": [b[n] for n in ok]}
                        same = {name: [v] * len(ok) for name, v in zip(by, key, strict=False)}
                        yield pd.DataFrame({**{n: pd.Series(v, dtype=object) for n, v in (same | said).items()}, "score": score[ok]})

    return compared


def alike(left: DataFrame, right: DataFrame, least: float, by: Sequence[str] = ()) -> DataFrame:
    """(*by, a, b, score): pairs of strings ``a`` of left and ``b`` of right, equal in ``by``, with Jaro >= ``least``; once each.

    left: *by, a; right: *by, b. Nulls, in ``by`` too, are like nothing; empty strings are like each other.

    Jaro at the bar t asks for lengths of a ratio of 3t - 2 at least, so strings are dealt into bands of length, of which neighbours meet, and bands into blocks of about BLOCK strings.
    Each pair of blocks is one piece of work, in which letter counts bound the common letters of all pairs in one matrix product; only pairs that the bound allows are compared. The
    work is known before it begins, and a string is sent once for each block that it meets: strings of 1,000 blocks 1,000 times.
    """
    by = list(by)
    one, other = left.select(*by, F.col("a").alias("_s")).where("_s is not null").distinct(), right.select(*by, F.col("b").alias("_s")).where("_s is not null").distinct()
    ratio = 3 * least - 2
    band = F.floor(F.log(F.length("_s").cast("double")) / (1e-9 - math.log(ratio))) if ratio > 0 else F.lit(0)
    band = F.when(F.length("_s") == 0, -5).otherwise(band).cast("int")
    one = one.withColumn("_band", band)
    other = other.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    parts = lambda df, n: df.groupBy(*by, "_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    plan = settle(parts(one, "_m").join(parts(other, "_n"), [*by, "_band"]))
    pairs = plan.agg(F.coalesce(F.sum(F.col("_m").cast("long") * F.col("_n")), F.lit(0))).first()[0]
    few = broadcast_if_small(plan)
    own = lambda n: F.pmod(F.xxhash64("_s"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = one.join(few, [*by, "_band"]).withColumn("_i", own("_m")).withColumn("_j", each("_n")).withColumn("_side", F.lit(0))
    b = other.join(few, [*by, "_band"]).withColumn("_j", own("_n")).withColumn("_i", each("_m")).withColumn("_side", F.lit(1))
    keys = [*by, "_band", "_i", "_j"]
    tasks = max(1, min(pairs, max(pairs // 16, 2 * left.sparkSession.sparkContext.defaultParallelism)))
    met = a.unionByName(b).select(*keys, "_side", "_s").repartition(tasks, *keys).sortWithinPartitions(*keys, "_side")
    kinds = ", ".join(f"`{c}` {left.schema[c].dataType.simpleString()}" for c in by)
    return met.mapInPandas(_compared(keys, by, least), f"{kinds}{', ' if by else ''}a string, b string, score double")
