"""Substring dedup by level-wise doubling.

The lengths double up to the wanted one: 5, 10 and 20 words for 20. At each length the windows that are still
candidates are judged by one shorter window inside, the least-hashed one; those whose least one repeats are the candidates of
the next length, and when none are left the loop ends. Equal windows have equal least ones, so
nothing is lost, and neighbouring windows mostly share theirs, so a part of the places is enough.

At the full length candidates meet under their least half, or under their own hash where that half is hot, and all but the
earliest of equal ones are late. A late window names the earlier one, and the words of both are compared by
SHA-256 at the end: if any differ, hashes have collided, and everything is done anew with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.llm.common import Bitmap, bitmap_of, hashed_words, map_slices, mix, runs_of, settle, utf8, whole_groups

#: The loop starts at the least length of at least so many words that doubles up to the wanted one.
LEAST_LEVEL = 5
#: log2 of the most bits of a bitmap of repeated windows (64 MB). Beyond a sixteenth as many of them more candidates
#: pass than repeat; the result stays the same.
BITMAP_BITS = 29
#: Occurrences of a least half beyond which it is hot: its windows then meet by their own hashes.
HOT_PIECES = 256
#: Windows under hot halves that a task remembers, so as to send each on once only.
REMEMBERED = 1 << 17
#: Least windows that a task gathers before it sends them on by range of hash.
GATHERED = 1 << 21
#: Hash draws before a disagreement of the words counts as an error.
DRAWS = 4
_NULL_ID = (1 << 63) - 1
_K = np.uint64(0x9E3779B97F4A7C15)


def levels(length: int) -> list[int]:
    """Window lengths from short to ``length``, each about twice the one before."""
    out = [length]
    while out[0] // 2 >= LEAST_LEVEL:
        out.insert(0, out[0] // 2)
    return out


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows: of two windows of n // 2 words and, for odd n, one word more."""
    if n == 1:
        return words
    half = _grams(words, n // 2)
    m = len(words) - n + 1
    if m <= 0:
        return words[:0]
    g = mix(half[:m] * _K + half[n // 2 : n // 2 + m])
    return mix(g * _K + words[n - 1 : n - 1 + m]) if n % 2 else g


def pieces(texts: list[bytes], length: int, part: int, seed: int, seen: tuple[int, Bitmap] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: (text index, first window, windows, least part, repeats inside, window hashes).

    A piece is a run of consecutive windows of ``length`` words with one least window of ``part`` words, at most as many as can share one
    place. ``repeats inside`` marks pieces that hold a window twice. With ``seen`` (length, bitmap of a level
    before) only windows whose least window of that length may repeat are candidates.
    """
    span = length - part + 1
    for a, b in runs_of(texts):
        words, ends = hashed_words(texts[a:b], seed=seed)
        n = len(words) - length + 1
        if n <= 0:
            continue
        starts = np.concatenate(([0], ends[:-1]))
        owner = np.repeat(np.arange(len(ends)), ends - starts)
        inside = owner[:n] == owner[length - 1 :]
        if seen is not None:
            inside &= seen[1].has(_least(words, length, seen[0], n))
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        hashes = _grams(words, length)[at]
        own, low = owner[at], _least(words, length, part, n)[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        new |= since % span == 0
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(at)))
        piece = np.repeat(np.arange(len(heads)), counts)
        again = np.zeros(len(heads), bool)
        for d in range(1, span):
            eq = (hashes[d:] == hashes[:-d]) & (piece[d:] == piece[:-d])
            if eq.any():
                again[piece[d:][eq]] = True
        yield own[heads] + a, at[heads] - starts[own[heads]], counts, low[heads], again, hashes


def _least(words: np.ndarray, length: int, part: int, n: int) -> np.ndarray:
    """The least hash of the windows of ``part`` words inside each of n windows of ``length`` words."""
    span = length - part + 1
    least, width = mix(_grams(words, part) ^ _K)[: n + span - 1], 1
    while width * 2 <= span:
        least, width = np.minimum(least[: len(least) - width], least[width:]), width * 2
    if width < span:
        least = np.minimum(least[:n], least[span - width : span - width + n])
    return least[:n]


# --- which windows of a level repeat -------------------------------------------------------------------


def _packed(length: int, part: int, seed: int, seen, buckets: int):
    """Least windows of the candidates by range of hash: (bucket, values as 8 bytes each, counts as 2 bytes each)."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for _, _, _, low, again, _ in pieces(utf8(pdf["text"]), length, part, seed, seen):
                held += [low, low[again]]
                size += len(low)
                if size >= GATHERED:
                    yield _by_bucket(held, buckets)
                    held, size = [], 0
        if size:
            yield _by_bucket(held, buckets)

    return packed


def _by_bucket(held: list[np.ndarray], buckets: int) -> pd.DataFrame:
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    counts = np.minimum(counts, 65535).astype(np.uint16)
    bucket = (values // np.uint64(-(-(1 << 64) // buckets))).astype(np.int32)
    starts = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
    ends = np.append(starts[1:], len(values))
    rows = [(int(bucket[a]), values[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "values", "counts"])


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf, starts in whole_groups(batches, ["bucket"]):
        for a, b in zip(starts, starts[1:], strict=False):
            values = np.frombuffer(b"".join(pdf["values"].iloc[a:b]), np.uint64)
            counts = np.frombuffer(b"".join(pdf["counts"].iloc[a:b]), np.uint16).astype(np.int64)
            own, at = np.unique(values, return_inverse=True)
            n = np.bincount(at, counts).astype(np.int64)
            yield pd.DataFrame({"value": own[n > 1].view(np.int64), "n": n[n > 1]})


def repeated(texts: DataFrame, length: int, part: int, seed: int, seen) -> DataFrame:
    """(value, n): the hashes of least windows of ``part`` words that occur n > 1 times among the candidates.

    Values are dealt by range, packed, and counted once in each task before they are sent.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = map_slices(texts.select("text"), _packed(length, part, seed, seen, 16 * parts), "bucket int, values binary, counts binary")
    return settle(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_repeated, "value long, n long"))


# --- which windows are late ----------------------------------------------------------------------------

#: A piece of candidates (n = 0, ``data`` their hashes) or a late run (n windows, ``data`` the place of the earlier ones).
_PIECE = "key long, ord long, text_key long, first int, n int, data binary"
_RUN = "ord long, text_key long, first int, n int, src_ord long, src_key long, src_first int"
_RUN_COLUMNS = [c.split()[0] for c in _RUN.split(", ")]


def _late_runs(doc: tuple[np.ndarray, np.ndarray], first: np.ndarray, src: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    """Runs of late windows, given in order: of one document, next to each other, and so are the earlier ones."""
    if not len(first):
        return pd.DataFrame({c: [] for c in _RUN_COLUMNS}).astype("int64")
    new = np.ones(len(first), bool)
    same = (first[1:] == first[:-1] + 1) & (src[2][1:] == src[2][:-1] + 1)
    for x in (*doc, src[0], src[1]):
        same &= x[1:] == x[:-1]
    new[1:] = ~same
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(first)))
    return pd.DataFrame(dict(zip(_RUN_COLUMNS, (doc[0][at], doc[1][at], first[at], n, src[0][at], src[1][at], src[2][at]), strict=True)))


def _earliest(group: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """For each element the index of the one with the least place in its group."""
    order = np.lexsort((*place[::-1], group))
    head = np.append(True, group[order][1:] != group[order][:-1]) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(order[head], np.diff(np.append(np.flatnonzero(head), len(order))))
    return out


def _windows(length: int, part: int, seed: int, seen: Bitmap, hot: Bitmap, remembered: int):
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple[int, int, int]] = {}
        for pdf in batches:
            ids, keys = pdf["ord"].to_numpy(np.int64), pdf["text_key"].to_numpy(np.int64)
            for own, first, counts, low, _, hashes in pieces(utf8(pdf["text"]), length, part, seed, (part, seen)):
                warm = hot.has(low)
                ends = np.cumsum(counts)
                plain = np.flatnonzero(~warm)
                if len(plain):
                    raw = hashes.tobytes()
                    cut = [raw[8 * (e - c) : 8 * e] for e, c in zip(ends[plain].tolist(), counts[plain].tolist(), strict=True)]
                    yield pd.DataFrame({"key": low[plain].view(np.int64), "ord": ids[own[plain]], "text_key": keys[own[plain]], "first": first[plain], "n": 0, "data": cut})
                if warm.any():
                    at = np.repeat(np.arange(len(counts)), counts)
                    place = first[at] + np.arange(len(at)) - (ends - counts)[at]
                    keep = warm[at]
                    doc = own[at[keep]]
                    yield _single(hashes[keep].view(np.int64), ids[doc], keys[doc], place[keep], known, remembered)

    return windows


def _single(window: np.ndarray, order: np.ndarray, key: np.ndarray, first: np.ndarray, known: dict, remembered: int) -> pd.DataFrame:
    """Windows by their own hashes: those after an equal one that the task has met are late, the others go on."""
    src = _earliest(window, order, key, first)
    so, sk, sf = order[src], key[src], first[src]
    least = np.flatnonzero(src == np.arange(len(src)))
    before = {}
    for i in least.tolist():
        w, here = int(window[i]), (int(order[i]), int(key[i]), int(first[i]))
        met = known.get(w)
        if met is not None and met < here:
            before[i] = met
        else:
            if met is None and len(known) >= remembered:
                known.clear()
            known[w] = here
    if before:
        met = np.array([before.get(i, (so[i], sk[i], sf[i])) for i in src.tolist()], np.int64)
        so, sk, sf = met.T
    late = (so != order) | (sk != key) | (sf != first)
    runs = _late_runs((order[late], key[late]), first[late], (so[late], sk[late], sf[late]))
    data = np.stack([runs[c].to_numpy(np.int64) for c in ("src_ord", "src_key", "src_first")], 1).tobytes() if len(runs) else b""
    spread = mix(runs["ord"].to_numpy(np.int64).view(np.uint64) ^ runs["first"].to_numpy(np.int64).astype(np.uint64)).view(np.int64)
    done = pd.DataFrame({"key": spread, "ord": runs["ord"], "text_key": runs["text_key"], "first": runs["first"], "n": runs["n"], "data": [data[24 * i : 24 * i + 24] for i in range(len(runs))]})
    raw, on = window.tobytes(), np.flatnonzero(~late)
    rest = pd.DataFrame({"key": window[on], "ord": order[on], "text_key": key[on], "first": first[on], "n": 0, "data": [raw[8 * i : 8 * i + 8] for i in on.tolist()]})
    return pd.concat([done, rest], ignore_index=True)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Late runs of pieces sorted by key and place, and those found before."""
    for pdf, starts in whole_groups(batches, ["key"]):
        n, data = pdf["n"].to_numpy(), pdf["data"].to_numpy()
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        done = np.flatnonzero(n > 0)
        if len(done):
            src = np.frombuffer(b"".join(data[done]), np.int64).reshape(-1, 3).T
            yield pd.DataFrame(dict(zip(_RUN_COLUMNS, (*(pdf[c].to_numpy()[done] for c in ("ord", "text_key", "first")), n[done], *src), strict=True)))
        open_ = np.flatnonzero(n == 0)
        if not len(open_):
            continue
        windows = np.frombuffer(b"".join(data[open_]), np.int64)
        counts = np.fromiter((len(x) for x in data[open_]), np.int64, len(open_)) // 8
        at = np.repeat(open_, counts)
        first = pdf["first"].to_numpy(np.int64)[at] + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        order, key = pdf["ord"].to_numpy(np.int64)[at], pdf["text_key"].to_numpy(np.int64)[at]
        _, both = np.unique(np.stack([group[at], windows], 1), axis=0, return_inverse=True) if len(starts) > 2 else (None, windows)
        src = _earliest(both, order, key, first)
        late = (order != order[src]) | (key != key[src]) | (first != first[src])
        src = src[late]
        yield _late_runs((order[late], key[late]), first[late], (order[src], key[src], first[src]))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by document and place, with those next to each other made one; equal places once."""
    for pdf in batches:
        x = {c: pdf[c].to_numpy(np.int64) for c in _RUN_COLUMNS}
        if not len(pdf):
            continue
        same = (x["first"][1:] == x["first"][:-1] + x["n"][:-1]) & (x["src_first"][1:] == x["src_first"][:-1] + x["n"][:-1])
        for c in ("ord", "text_key", "src_ord", "src_key"):
            same &= x[c][1:] == x[c][:-1]
        at = np.flatnonzero(np.append(True, ~same))
        x["n"] = np.add.reduceat(x["n"], at)
        yield pd.DataFrame({c: v if c == "n" else v[at] for c, v in x.items()})


# --- cutting, and comparing the words ------------------------------------------------------------------

_ASK = "first int, n int, late boolean, src_ord long, src_key long, src_first int"
_DONE = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
_CHECK = "checks array<struct<src_ord:long,src_key:long,src_first:int,n:int,words:binary>>"


def _asked(bitmap: Bitmap):
    """Texts that no run can concern are done where they are read; the others go on with their text."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wanted = bitmap.has(_doc_hash(pdf["ord"].to_numpy(np.int64), pdf["text_key"].to_numpy(np.int64)))
            rows = [(0, "", t) if w else (*_whole(t), None) for t, w in zip(utf8(pdf["text"]), wanted.tolist(), strict=True)]
            made = pd.DataFrame(rows, columns=["n_words", "sha256", "data"])
            yield pd.concat([pdf[["doc_id", "ord", "text_key"]].reset_index(drop=True), made], axis=1).astype({"doc_id": "Int64"})

    return asked


def _whole(text: bytes) -> tuple[int, str]:
    words = text.split()
    return len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def _doc_hash(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(order.view(np.uint64) * _K ^ key.view(np.uint64)).view(np.int64)


def _hashed_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": _doc_hash(pdf["ord"].to_numpy(np.int64), pdf["text_key"].to_numpy(np.int64))})


def _cut(length: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n, sha, text, asks in zip(pdf["n_words"].tolist(), pdf["sha256"].tolist(), pdf["data"], pdf["asks"], strict=True):
                if text is None:
                    rows.append((n, 0, sha, [], []))
                    continue
                words = text.split()
                asks = [] if asks is None else asks
                checks = []
                for r in asks:
                    said = hashlib.sha256(b" ".join(words[r["first"] : r["first"] + r["n"] + length - 1])).digest()
                    checks.append((r["src_ord"], r["src_key"], r["src_first"], r["n"], said))
                kept, upto, spans = [], 0, []
                for first, n in sorted((int(r["first"]), int(r["n"])) for r in asks if r["late"]):
                    end = first + n + length - 1
                    if end <= upto:
                        continue
                    if spans and first <= upto:
                        spans[-1][1] = end
                    else:
                        kept += words[upto:first]
                        spans.append([first, end])
                    upto = end
                kept += words[upto:]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [tuple(s) for s in spans], checks))
            made = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "spans", "checks"])
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), made], axis=1).astype({"doc_id": "Int64"})

    return cut


def _late(spark: SparkSession, texts: DataFrame, length: int, seed: int, bitmap_bits: int, hot_pieces: int, remembered: int) -> DataFrame:
    """Late runs (_RUN) of all texts: the loop over the levels, then the meeting of the candidates."""
    seen, part = None, None
    for part in levels(length)[:-1]:
        found = repeated(texts, length, part, seed, seen)
        if found.isEmpty():
            return spark.createDataFrame([], _RUN)
        seen = (part, bitmap_of(found, "value", bitmap_bits))
    if part is None:  # a length too short to halve: its windows are their own least ones
        part = length
        found = repeated(texts, length, part, seed, None)
        seen = (part, bitmap_of(found, "value", bitmap_bits))
    hot = bitmap_of(found.where(F.col("n") > hot_pieces), "value", bitmap_bits)
    met = map_slices(texts, _windows(length, part, seed, seen[1], hot, remembered), _PIECE)
    met = met.repartition("key").sortWithinPartitions("key", "ord", "text_key", "first").mapInPandas(_meet, _RUN)
    return settle(met.repartition("ord", "text_key").sortWithinPartitions("ord", "text_key", "first").mapInPandas(_merge, _RUN))


def remove_repeats(
    docs: DataFrame, *, length: int = 20, id_col: str = "doc_id", text_col: str = "text",
    bitmap_bits: int = BITMAP_BITS, hot_pieces: int = HOT_PIECES, remembered: int = REMEMBERED, seed: int = 0,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, spans (half-open ranges of removed words).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. A word is removed when a window
    of ``length`` words over it also starts earlier: in a document before (by id, then by text hash),
    or earlier in the same one. Windows are judged on the input. ``kept_sha256`` is over the kept
    words joined by single spaces.

    Null and empty texts have no words; texts of fewer than ``length`` words lose none. A null id sorts
    last. Rows with equal id and text are one document and get equal results. Very long texts are
    hashed whole, and so are very long words. An empty table gives an empty result. Other columns are ignored, whatever their names.
    Raises if the words of windows with equal hashes differ in DRAWS draws of the hashes one after the other.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("ord"), key.alias("text_key"), F.col(text_col).alias("text"))
    for draw in range(seed, seed + DRAWS):
        late = _late(spark, plain.select("ord", "text_key", "text"), length, draw, bitmap_bits, hot_pieces, remembered)
        # Each late run is asked of its document, and the run it repeats of the earlier one, once however often it is repeated.
        src = [F.col("src_ord"), F.col("src_key"), F.col("src_first")]
        own = late.select("ord", "text_key", F.struct("first", "n", F.lit(True).alias("late"), *src).alias("ask"))
        of = late.select(*src, "n").distinct().select(src[0].alias("ord"), src[1].alias("text_key"), F.struct(src[2].alias("first"), "n", F.lit(False).alias("late"), *src).alias("ask"))
        asks = settle(own.union(of).groupBy("ord", "text_key").agg(F.collect_set("ask").alias("asks")))
        wanted = bitmap_of(asks.select("ord", "text_key").mapInPandas(_hashed_docs, "h long"), "h", bitmap_bits)
        texts = map_slices(plain, _asked(wanted), "doc_id long, ord long, text_key long, n_words long, sha256 string, data binary")
        joined = texts.join(asks, ["ord", "text_key"], "left").select("doc_id", "n_words", "sha256", "data", "asks")
        out = settle(joined.mapInPandas(_cut(length), f"{_DONE}, {_CHECK}"))
        said = out.select(F.explode("checks").alias("c")).select("c.*").groupBy("src_ord", "src_key", "src_first", "n")
        if said.agg(F.min("words").alias("a"), F.max("words").alias("b")).where("a <> b").isEmpty():
            return out.drop("checks")
    raise RuntimeError(f"hashes collided in {DRAWS} draws")
