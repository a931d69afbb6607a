"""Where claims and posts belong: mentions to places, kinds to themes, placements to their current place.

Mentions, kinds and names are resolved once per distinct text and joined back, so the work follows the
vocabulary, not the number of claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions import similarity as S
from testimony.functions import text as T
from testimony.operators import trees
from testimony.operators.durable import broadcast_if_small, settle

# Leading words by how fine a place they name.
STRUCTURES = "edificio edif residencia residencias res resd conjunto torre torres bloque quinta complejo residencial club hotel".split()
STREETS = "avenida av calle carrera".split()
AREAS = "urbanizacion urb sector barrio zona".split()
ADMINISTRATIVE = "parroquia municipio estado ciudad pais".split()

NAME_BAR, THEME_BAR = 0.92, 0.9


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _typed(segment: Column) -> Column:
    """struct(type, name): a leading type word apart from the rest, if there is a rest."""

    def of(w: Column) -> Column:
        rest = F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " ")
        typed = lambda head: F.struct(F.when(head.isin(*T.TYPE_WORDS), head).alias("type"), F.when(head.isin(*T.TYPE_WORDS), rest).otherwise(segment).alias("name"))
        return _let(F.when(F.size(w) > 1, T.fold(F.get(w, F.lit(0)))), typed)

    return _let(T.words(segment, r"\s+"), of)


def _fineness(segment: Column) -> Column:
    rank = lambda head: F.when(head.isin(*STRUCTURES), 3).when(head.isin(*STREETS), 2).when(head.isin(*AREAS), 1).when(head.isin(*ADMINISTRATIVE), -1).otherwise(0)
    return _let(T.kind_head(segment), rank)


def parse_mention(c: Column) -> Column:
    """Array of struct(original, raw_name, type, forms, ancestors): the finest places a mention names.

    Commas part the hierarchy. The first segment is the finest unless later ones are strictly finer; then the last
    of those is. 'y' and 'e' part siblings. ``forms`` are the folded texts to look up, with and without the
    type word; ``ancestors`` the folded other segments in order. Null and blank give an empty array.
    """
    nonblank = lambda a: F.filter(F.transform(a, lambda s: F.trim(s)), lambda s: s != "")
    segments = F.transform(nonblank(F.split(F.coalesce(c, F.lit("")), ",")), lambda s, i: F.struct(i.alias("i"), s.alias("s"), _fineness(s).alias("r")))

    def finest(all_: Column) -> Column:
        finer = F.filter(all_, lambda x: (x.i > 0) & (x.r > F.get(all_, F.lit(0)).r))
        return _let(finer, lambda f: F.coalesce(F.get(f, F.size(f) - 1), F.get(all_, F.lit(0))))

    def mentions(all_: Column, best: Column) -> Column:
        above = F.filter(F.transform(F.filter(all_, lambda x: x.i != best.i), lambda x: T.fold(_typed(x.s)["name"])), lambda s: s != "")
        siblings = nonblank(F.split(F.coalesce(best.s, F.lit("")), r"\s+[ye]\s+"))
        return _let(above, lambda up: F.transform(siblings, lambda s: _let(_typed(s), lambda t: mention(s, t, up))))

    def mention(s: Column, t: Column, up: Column) -> Column:
        forms = F.filter(F.array_distinct(F.array(T.fold(s), T.fold(t["name"]))), lambda f: f != "")
        return F.struct(s.alias("original"), t["name"].alias("raw_name"), t["type"].alias("type"), forms.alias("forms"), up.alias("ancestors"))

    found = _let(segments, lambda all_: _let(finest(all_), lambda best: mentions(all_, best)))
    return F.filter(found, lambda m: F.size(m.forms) > 0)


def name_index(places: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (event_id, form, place_id, canonical, since) of active places under all their folded names."""
    live = places.where("lifecycle = 'active'").select("event_id", F.col("id").alias("place_id"), F.col("canonical_name").alias("canonical"), F.col("inserted_at").alias("since"))
    own = live.withColumn("form", T.fold(F.col("canonical")))
    other = live.join(names.select("place_id", T.fold(F.col("name")).alias("form")), "place_id").select(*own.columns)
    return own.unionByName(other).where("form <> ''").distinct()


def place_name_match(forms: DataFrame, index: DataFrame) -> DataFrame:
    """(event_id, form, place_id, canonical, since, how): places a folded form names exactly, else nearly.

    Near names have Jaro at the bar, and the place's own name must not contradict the form's marks.
    """
    forms = forms.select("event_id", "form").distinct()
    exact = forms.join(index, ["event_id", "form"]).withColumn("how", F.lit("mention_exact"))
    rest = forms.join(index, ["event_id", "form"], "left_anti")
    near = S.alike(rest.withColumnRenamed("form", "a"), index.select("event_id", F.col("form").alias("b")), NAME_BAR, ["event_id"]).toDF("event_id", "form", "name", "_score").drop("_score")
    found = near.join(index.withColumnRenamed("form", "name"), ["event_id", "name"]).where(~T.marks_contradict(F.col("canonical"), F.col("form")))
    return exact.unionByName(found.drop("name").distinct().withColumn("how", F.lit("mention_fuzzy")))


def resolve_places(claims: DataFrame, held: DataFrame, places: DataFrame, names: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, proposals) of the claims' place mentions.

    claims: claim_id, event_id, place_mention. held: claim_id, how_resolved. places: id, event_id, parent_id,
    canonical_name, lifecycle, inserted_at. names: place_id, name. A claim with a 'manual' link is left alone.

    outcomes: claim_id, original, outcome (linked, proposed, unresolved), place_id, how_resolved, confidence. A form that no
    place has hangs a proposed place under the first known ancestor, once per name and parent, with the type of the first mention that has one.
    proposals: id, event_id, parent_id, canonical_name, type. Of equal candidates the earliest inserted wins.
    """
    asked = claims.join(held.where("how_resolved = 'manual'").select("claim_id").distinct(), "claim_id", "left_anti").where("place_mention is not null")
    said = asked.select("event_id", "place_mention").distinct()
    parsed = settle(said.select("event_id", "place_mention", F.posexplode(parse_mention(F.col("place_mention"))).alias("n", "m")).select("event_id", "place_mention", "n", "m.*"))
    key = ["event_id", "place_mention", "n"]
    index = settle(name_index(places, names))
    form = parsed.select(*key, F.posexplode("forms").alias("at", "form"), "ancestors")
    hits = form.join(settle(place_name_match(form, index)), ["event_id", "form"])
    # Exact hits of any form come before near ones; among those, the first form.
    rank = F.struct((F.col("how") != "mention_exact").alias("near"), F.col("at").alias("at"))
    hits = hits.withColumn("_r", rank).withColumn("_best", F.min("_r").over(Window.partitionBy(*key))).where("_r = _best")
    chain = closure.where("depth > 0").join(places.where("lifecycle = 'active'").select(F.col("id").alias("ancestor"), T.fold(F.col("canonical_name")).alias("_name")), "ancestor")
    chain = chain.groupBy(F.col("descendant").alias("place_id")).agg(F.collect_set("_name").alias("above"))
    overlap = F.size(F.filter("ancestors", lambda a: F.coalesce(F.array_contains("above", a), F.lit(False))))
    scored = hits.join(chain, "place_id", "left").withColumn("overlap", overlap)
    w = Window.partitionBy(*key)
    scored = scored.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(F.desc("overlap"), "since", "place_id"))}).where("_k = 1")
    exact = F.col("how") == "mention_exact"
    pick = lambda e, f: F.when(exact, e).otherwise(f)
    confidence = F.when(F.col("_n") == 1, pick(0.9, 0.65)).when(F.col("overlap") > 0, pick(0.85, 0.6)).otherwise(pick(0.5, 0.4))
    linked = settle(scored.select(*key, "place_id", F.col("how").alias("how_resolved"), confidence.alias("confidence")))

    rest = parsed.join(linked, key, "left_anti")
    first = index.groupBy("event_id", F.col("form").alias("ancestor")).agg(F.min_by("place_id", F.struct("since", "place_id")).alias("parent_id"))
    up = rest.select(*key, F.posexplode("ancestors").alias("at", "ancestor")).join(first, ["event_id", "ancestor"]).groupBy(*key).agg(F.min_by("parent_id", "at").alias("parent_id"))
    wanted = rest.join(up, key).withColumn("_f", T.fold(F.col("raw_name")))
    child = places.where("parent_id is not null").groupBy("event_id", "parent_id", T.fold(F.col("canonical_name")).alias("_f")).agg(F.min_by("id", F.struct("inserted_at", "id")).alias("_held"))
    minted = F.sha2(F.concat_ws("\u0001", F.col("event_id").cast("string"), F.col("parent_id").cast("string"), "_f"), 256)
    wanted = settle(wanted.join(child, ["event_id", "parent_id", "_f"], "left").withColumn("place_id", F.coalesce(F.col("_held").cast("string"), minted)))
    new = wanted.where("_held is null").groupBy(F.col("place_id").alias("id"), "event_id", "parent_id")
    proposals = new.agg(F.min_by("raw_name", F.struct("place_mention", "n")).alias("canonical_name"), F.coalesce(F.min_by("type", F.struct(F.col("type").isNull().alias("untyped"), "place_mention", "n")), F.lit("lugar")).alias("type"))
    proposed = wanted.select(*key, "place_id", F.lit("mention_ancestor").alias("how_resolved"), F.lit(0.5).alias("confidence"))
    both = linked.withColumn("place_id", F.col("place_id").cast("string")).unionByName(proposed)
    outcome = F.when(F.col("how_resolved") == "mention_ancestor", "proposed").when(F.col("how_resolved").isNotNull(), "linked").otherwise("unresolved")
    answered = parsed.select(*key, "original").join(both, key, "left").withColumn("outcome", outcome)
    out = asked.select("claim_id", "event_id", "place_mention").join(answered, ["event_id", "place_mention"])
    return out.select("claim_id", "original", "outcome", "place_id", "how_resolved", "confidence"), proposals


def resolve_summary(outcomes: DataFrame) -> DataFrame:
    """One row: mentions, linked, proposed, unresolved."""
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return outcomes.agg(F.count("*").alias("mentions"), n("linked"), n("proposed"), n("unresolved"))


def file_themes(claims: DataFrame, themes: DataFrame) -> DataFrame:
    """(event_id, kind, theme_id, score): the active happening whose words a kind answers best, at the bar at least.

    claims: event_id, kind. themes: event_id, id, name, nature, lifecycle. Kinds that answer none have no row;
    ties go to the smallest id.
    """
    kinds = claims.select("event_id", "kind").distinct().withColumn("said", T.theme_words(F.col("kind"))).where("size(said) > 0")
    live = themes.where("lifecycle = 'active' and nature = 'happening'").select("event_id", F.col("id").alias("theme_id"), T.theme_words(F.col("name")).alias("asked")).where("size(asked) > 0")
    # A mean at the bar needs a word at the bar, so kinds and themes meet on words that are alike.
    word = lambda rows, key, c, name: rows.select("event_id", key, F.explode(F.array_distinct(c)).alias(name))
    said, asked = word(kinds, "kind", "said", "b"), word(live, "theme_id", "asked", "a")
    words = S.alike(asked.select("event_id", "a"), said.select("event_id", "b"), THEME_BAR, ["event_id"]).drop("score")
    met = words.join(asked, ["event_id", "a"]).join(said, ["event_id", "b"]).select("event_id", "kind", "theme_id").distinct()
    both = met.join(broadcast_if_small(live), ["event_id", "theme_id"]).join(kinds, ["event_id", "kind"])
    scored = both.withColumn("score", S.directed_recall(F.col("asked"), F.col("said"))).where(F.col("score") >= THEME_BAR)
    w = Window.partitionBy("event_id", "kind").orderBy(F.desc("score"), "theme_id")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("event_id", "kind", "theme_id", "score")


def where_of_post(posts: DataFrame, placements: DataFrame, no_place: DataFrame, places: DataFrame, unplaced) -> DataFrame:
    """(post_id, answer, place_id): 'place' with the current place, 'no_place', or 'unplaced' with the event's own.

    placements: post_id, place_id and no_place: post_id are current answers. places: id, lifecycle, replaced_by_id.
    A deprecated place leads to its replacement; a discarded, missing or circular one to Unplaced.
    """
    onward = F.when(F.col("lifecycle") == "deprecated", F.col("replaced_by_id"))
    ends = trees.follow_redirects(places.select("id", onward.alias("next_id")))
    usable = places.where("lifecycle in ('active', 'proposed')").select(F.col("id").alias("final"))
    at = ends.where("not loops").join(usable, "final", "left_semi").select(F.col("id").alias("place_id"), "final")
    found = placements.select("post_id", "place_id").join(at, "place_id", "left").select("post_id", F.lit(True).alias("_placed"), "final")
    none = no_place.select("post_id").distinct().withColumn("_none", F.lit(True))
    rows = posts.select("post_id").join(found, "post_id", "left").join(none, "post_id", "left")
    answer = F.when(F.col("final").isNotNull(), "place").when(F.col("_placed").isNull() & F.col("_none").isNotNull(), "no_place").otherwise("unplaced")
    rows = rows.withColumn("answer", answer)
    return rows.select("post_id", "answer", F.when(F.col("answer") == "place", F.col("final")).when(F.col("answer") == "unplaced", F.lit(unplaced)).alias("place_id"))


def post_place_scan(posts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (id, name) of folded names found as phrases in whole texts.

    Both sides are cut into words; texts give runs of the lengths that names have, and these meet the names by equality.
    """
    cut = lambda c: F.regexp_extract_all(T.fold(c), F.lit(r"([\p{L}\p{N}]+)"))
    listed = names.select(cut(F.col("name")).alias("w")).where("size(w) > 0").distinct()
    listed = settle(listed.select(F.array_join("w", " ").alias("name"), F.size("w").alias("n")))
    said = posts.select(F.col(id_col).alias("id"), cut(F.col(text_col)).alias("w"))
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(none)

    none = F.array().cast("array<string>")
    runs = F.concat(none, *[runs_of(n) for n in lengths])
    grams = said.select("id", F.explode(F.array_distinct(runs)).alias("name"))
    return grams.join(broadcast_if_small(listed.select("name")), "name").select("id", "name")
