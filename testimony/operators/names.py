"""Names of private people in claims' texts: what looks like a name and no known name explains.

A name explains a candidate that contains it or that it contains, letter for letter. Either way the shorter ones are sought in the longer by an
automaton of an event's strings, each of which passes once, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.durable import broadcast_if_small, settle


def gazetteer_names(places: DataFrame, place_names: DataFrame) -> DataFrame:
    """(event_id, name) folded, once each: canonical and surface names of active places.

    places: id, event_id, canonical_name, lifecycle. place_names: place_id, name. A proposed place explains nothing.
    """
    active = places.where("lifecycle = 'active'")
    surface = place_names.join(active.select(F.col("id").alias("place_id"), "event_id"), "place_id").select("event_id", "name")
    every = active.select("event_id", F.col("canonical_name").alias("name")).unionByName(surface)
    return every.select("event_id", T.fold(F.col("name")).alias("name")).where("name <> ''").distinct()


#: Bytes of the strings of one automaton, about.
AUTOMATON_BYTES = 1 << 21


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by event, part and side: the sought strings of a part (side 0) make an automaton, through which the others (side 1) pass."""
    at, made = None, None
    for pdf in batches:
        for event, part, side, s in zip(pdf["event_id"], pdf["part"], pdf["side"], pdf["s"], strict=True):
            if (event, part) != at:
                at, made = (event, part), ahocorasick.Automaton(ahocorasick.STORE_ANY)
            if side == 0:
                made.add_word(s, s)
                continue
            if made.kind == ahocorasick.TRIE:
                made.make_automaton()
            hits = {x for _, x in made.iter(s)} if made.kind == ahocorasick.AHOCORASICK else set()
            if hits:
                yield pd.DataFrame({"event_id": event, "sought": pd.Series(sorted(hits), dtype=object), "within": pd.Series([s] * len(hits), dtype=object)})


def inclusions(sought: DataFrame, within: DataFrame) -> DataFrame:
    """(event_id, sought, within): which strings of ``sought`` (event_id, s) are in which of ``within``, letter for letter, in the same event.

    The strings sought in an event are dealt by bytes into parts, and each part is one automaton; the others of the event pass through every part. So
    no task holds more than a part, and an event of any size is spread over tasks.
    """
    one, other = sought.where("s <> ''").distinct(), within.where("s <> ''").distinct()
    parts = one.groupBy("event_id").agg(F.ceil(F.sum(F.octet_length("s")) / AUTOMATON_BYTES).cast("int").alias("parts"))
    known = broadcast_if_small(settle(parts))
    a = one.join(known, "event_id").select("event_id", F.pmod(F.xxhash64("s"), "parts").cast("int").alias("part"), F.lit(0).alias("side"), "s")
    # Sought strings are few beside those that they are sought in: what passes through is dealt again by its hash, and meets copies of the part.
    b = other.join(known, "event_id").select("event_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "s")
    met = a.unionByName(b).repartition("event_id", "part").sortWithinPartitions("event_id", "part", "side")
    return met.mapInPandas(_found, f"event_id {sought.schema['event_id'].dataType.simpleString()}, sought string, within string")


def unexplained_names(texts: DataFrame, vocabulary: DataFrame, figures: Sequence[str] = ()) -> DataFrame:
    """(id, event_id, name): the name-like sequences of texts (id, event_id, text) that no name explains.

    vocabulary: event_id, name (folded), as ``gazetteer_names`` gives it. ``figures`` are public figures, who may be named in every event.
    Null and empty texts, and texts without an event, have none. Names that are blank explain nothing. A sequence is given once for each text.
    """
    said = settle(texts.where("event_id is not null").select("id", "event_id", F.explode(T.private_name_candidates(F.coalesce("text", F.lit("")))).alias("name")))
    cands = said.select("event_id", T.fold(F.col("name")).alias("cand")).distinct()
    open_ = cands
    for figure in figures:
        f = T.fold(F.lit(figure))
        open_ = open_.where((f == "") | ~(F.contains(F.col("cand"), f) | F.contains(f, F.col("cand"))))
    open_ = settle(open_)
    names = vocabulary.where("name <> ''").select("event_id", "name").distinct()
    cand, known = open_.select("event_id", F.col("cand").alias("s")), names.select("event_id", F.col("name").alias("s"))
    holds = inclusions(known, cand).select("event_id", F.col("within").alias("cand"))
    held = inclusions(cand, known).select("event_id", F.col("sought").alias("cand"))
    unknown = open_.select("event_id", "cand").join(settle(holds.union(held).distinct()), ["event_id", "cand"], "left_anti")
    unknown = unknown.select(F.col("event_id").alias("_event"), "cand")
    return said.join(broadcast_if_small(unknown), (F.col("event_id") == F.col("_event")) & (T.fold(F.col("name")) == F.col("cand"))).select("id", "event_id", "name")
