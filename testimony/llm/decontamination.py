"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of the normalised test items as a sequence of word numbers, so it has at most as many
nodes as windows have words. Texts are normalised and their words numbered in bulk; the automaton runs over stretches of items' words only, and
over each once; a match's place among the normalised words maps to character offsets of the original.
Nothing is shuffled: the scan runs where the texts are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.llm.common import Vocabulary, fresh, runs_of, settle, split_words, stop_bytes, text_slices, utf8

#: Most nodes of one automaton, about 100 MB in each Python worker. More items make further automata, each scanning once.
NODES_PER_AUTOMATON = 2_000_000
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Bytes to normalised bytes: A-Z to a-z, then separators to spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256))
_STOPS = stop_bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_built: dict[str, object] = {}

FOUND = "struct<n_words:int,spans:array<struct<first:int,last:int>>,items:array<string>>"
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_FOUND = pa.struct([("n_words", pa.int32()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def windows_of(text: str | None, n: int) -> set[str]:
    """Windows of n words (all words, if fewer but not none) as ' w1 w2 ... '."""
    words = utf8([text])[0].translate(NORMAL).split()
    return {(b" " + b" ".join(words[i : i + n]) + b" ").decode() for i in range(max(1, len(words) - n + 1))} if words else set()


class Windows:
    """Numbers of the items' words, and the automaton of their windows. ``shortest`` is the least window's number of words."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        import ahocorasick

        owners: dict[str, list[str]] = defaultdict(list)
        for item, text in items:
            for w in windows_of(text, n):
                owners[w].append(item)
        self.made = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        number: dict[bytes, int] = {}
        self.shortest = n
        for w, who in owners.items():
            key = tuple(number.setdefault(x, len(number)) for x in w.encode("utf-8", "surrogatepass").split())
            self.shortest = min(self.shortest, len(key))
            self.made.add_word(key, (len(key), tuple(sorted(set(who)))))
        self.made.make_automaton()
        self.known = Vocabulary(list(number), _STOPS)

    def find(self, number: np.ndarray) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, words, items) of the windows that occur in a text, given the number of each of its words, -1 for words of no item.

        A window has known words only, so the automaton runs over stretches of them that are long enough.
        """
        edge = np.flatnonzero(np.diff(number >= 0, prepend=False, append=False))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                for end, (size, who) in self.made.iter(tuple(number[a:b].tolist())):
                    yield a + end - size + 1, size, who


def _windows(items: list[tuple[str, str | None]], n: int, key: str) -> Windows:
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items, n)
    return _built[key]


def scan(texts: list[bytes | None], windows: Windows) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text the number of words, merged half-open ranges of hit words, and the items hit."""
    texts = [t or b"" for t in texts]
    for i, j in runs_of(texts):
        found = split_words(texts[i:j], _STOPS, fold=True)
        number, at = windows.known.number(found), 0
        for upto in found.ends.tolist():
            spans: list[list[int]] = []
            items: set[str] = set()
            for first, size, who in sorted(windows.find(number[at:upto])):
                items.update(who)
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], first + size)
                else:
                    spans.append([first, first + size])
            yield upto - at, [tuple(s) for s in spans], sorted(items)
            at = upto


def _scanner(shared, window: int, key: str):
    @F.arrow_udf(FOUND)
    def look(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _windows(shared.value, window, key)
        for column in texts:
            rows = (row for part in text_slices(column) for row in scan(part, known))
            yield pa.array([{"n_words": n, "spans": [{"first": a, "last": b} for a, b in spans], "items": items} for n, spans, items in rows], _FOUND)

    return look


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    prefix: str = "",
    nodes: int = NODES_PER_AUTOMATON,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and spans added.

    A document word inside any occurrence of an item window is hit. ``spans`` are (start, end)
    character offsets in the original text, merged. ``items_sha256`` is over the hit item ids,
    sorted as strings and joined by commas. ``prefix`` goes before the added names.

    The items are gathered by blocks of at most ``nodes`` automaton nodes, counted before; each block is one automaton and
    one scan. With more than one block the rows are written between the scans, so that a worker holds one automaton at a time.

    Null and empty texts have no words and are clean. Items without words match nothing; items with
    equal windows are all named; null item ids are named ''. Repeated rows are scanned
    one by one. Very long texts and items are read whole. No items: all clean. No documents: an empty result. Names that exist already in
    ``docs`` are replaced by the added ones.
    """
    spark: SparkSession = docs.sparkSession
    named = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    # A window of n words makes at most n nodes; an item has as many windows as words at most.
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = named.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0] * window
    blocks = int(size // nodes + 1)
    out, names = docs, fresh(docs, *[f"_found{b}" for b in range(blocks)])
    for b, name in enumerate(names):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        rows = sorted(((r.item, r.text) for r in part.toLocalIterator()), key=str)
        key = hashlib.sha1(repr((window, rows)).encode("utf-8", "surrogatepass")).hexdigest()
        shared = spark.sparkContext.broadcast(rows)
        # Not deterministic, so that a later filter does not run the scan a second time.
        out = (settle(out) if b else out).withColumn(name, _scanner(shared, window, key).asNondeterministic()(F.col(text_col)))
    spans = F.array_sort(F.flatten(F.array(*[F.col(f"{n}.spans") for n in names])))
    hit = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s.upto, x.last).alias("upto"), (s.n + F.greatest(F.lit(0), x.last - F.greatest(s.upto, x.first))).alias("n")),
        lambda s: s.n,
    )
    who = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}.items") for n in names]))))
    at = F.pandas_udf(_original, "array<struct<start:int,end:int>>").asNondeterministic()
    added = {
        "n_words": F.col(f"{names[0]}.n_words").cast("long"),
        "n_hit": hit.cast("long"),
        "n_items": F.size(who).cast("long"),
        "items_sha256": F.sha2(F.array_join(who, ","), 256),
        "contaminated": hit > 0,
        "spans": F.when(F.size(spans) > 0, at(F.when(F.size(spans) > 0, F.col(text_col)), spans)).otherwise(F.array().cast("array<struct<start:int,end:int>>")),
    }
    return out.withColumns({prefix + k: v for k, v in added.items()}).drop(*names)


def _original(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series(
        [original_spans(t, [(s["first"], s["last"]) for s in ss]) if isinstance(t, str) else [] for t, ss in zip(texts, spans, strict=True)]
    )
