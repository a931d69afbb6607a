"""Planning collection: time slices, query texts, states, coverage and yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators.durable import settle

#: Pieces that one request may spend.
CAP = 22


def tile(searches: DataFrame, start: str, end: str, secs: str, now: Column) -> DataFrame:
    """Each row once per whole slice [slice_start, slice_end) from ``start``.

    The last slice may go beyond ``end``. An open window has only slices finished by ``now``. An empty or
    backward window has none.
    """
    s, width = F.unix_seconds(start), F.col(secs).cast("long")
    n = F.when(F.col(end).isNull(), F.floor((F.unix_seconds(now) - s) / width)).otherwise(F.ceil((F.unix_seconds(end) - s) / width)).cast("long")
    out = searches.withColumn("_n", n).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return out.withColumns({"slice_start": F.timestamp_seconds(s + F.col("_i") * width), "slice_end": F.timestamp_seconds(s + (F.col("_i") + 1) * width)}).drop("_n", "_i")


def name_chunks(names: DataFrame, by: list[str], name_col: str, term_cost: Column, cap: int = CAP) -> DataFrame:
    """Distinct sorted names with ``chunk``: as many in one query as the cap leaves beside terms and bounds."""
    most = F.greatest(F.floor((F.lit(cap) - (term_cost + 2) + 1) / 2), F.lit(1))
    w = Window.partitionBy(*by).orderBy(name_col)
    return names.dropDuplicates([*by, name_col]).withColumn("chunk", F.floor((F.row_number().over(w) - 1) / most).cast("int"))


def decompose_search(searches: DataFrame, scope: DataFrame, names: DataFrame, terms: DataFrame, closure: DataFrame, types: DataFrame, now: Column, cap: int = CAP) -> DataFrame:
    """Distinct (search_id, place_id, query_text, slice_start, slice_end, names, terms).

    searches: search_id, window_start, window_end, slice_seconds, result_mode. scope: search_id, place_id.
    names: place_id, name, emission. terms: search_id, term. closure: ancestor, descendant, depth.
    types: id, type. Raw names go in chunks; each anchored name goes with the raw names of its
    ancestors, nearest first, of any type but 'pais' (folded; none is another type); without such it is not asked.
    """
    listed = terms.groupBy("search_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    base = searches.join(listed, "search_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    cost = F.when(F.size("terms") == 0, 0).otherwise(2 * F.size("terms") - 1)
    places = scope.join(base.select("search_id", cost.alias("_cost")), "search_id")
    raw = places.join(names.where("emission = 'raw'").select("place_id", "name"), "place_id")
    raw = name_chunks(raw, ["search_id", "place_id"], "name", F.col("_cost"), cap)
    none = F.array().cast("array<string>")
    raw = raw.groupBy("search_id", "place_id", "chunk").agg(F.array_sort(F.collect_list("name")).alias("names")).select("search_id", "place_id", "names", none.alias("qualifiers"))
    up = closure.where("depth > 0").join(types.where(F.coalesce(T.fold(F.col("type")), F.lit("")) != "pais").select(F.col("id").alias("ancestor")), "ancestor")
    up = up.join(names.where("emission = 'raw'").select(F.col("place_id").alias("ancestor"), F.col("name").alias("q")), "ancestor")
    chain = up.groupBy(F.col("descendant").alias("place_id")).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("depth", "q"))), lambda x: x.q)).alias("qualifiers"))
    anchored = places.join(names.where("emission = 'anchored'").select("place_id", "name").distinct(), "place_id").join(chain, "place_id")
    groups = raw.unionByName(anchored.select("search_id", "place_id", F.array("name").alias("names"), "qualifiers"))
    slices = tile(base, "window_start", "window_end", "slice_seconds", now).select("search_id", "slice_start", "slice_end", "result_mode", "terms")
    specs = groups.join(slices, "search_id")
    made = T.query_text(F.col("names"), F.col("qualifiers"), F.col("terms"), F.col("slice_start"), F.col("slice_end"), F.col("result_mode"))
    return specs.withColumn("query_text", made).dropDuplicates(["search_id", "query_text"]).select("search_id", "place_id", "query_text", "slice_start", "slice_end", "names", "terms")


def reject_known(specs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """New specs only, once each."""
    return specs.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


def extend_search(searches: DataFrame, scope: DataFrame, names: DataFrame, terms: DataFrame, closure: DataFrame, types: DataFrame, now: Column, held: DataFrame, cap: int = CAP) -> dict[str, DataFrame]:
    """What a search that was widened asks beyond the queries that it holds: tables queries, query_names and query_terms.

    The other arguments are the search as it is now, with the places, terms and windows added (``decompose_search``); held: search_id, query_text. Only texts that are not
    held come, once each, with their bridges to names and terms; held queries stay as they are. So places and windows added one after the other give the plan of all at once, and so
    does asking twice. A new term changes the texts of its search: they are asked beside those held.
    """
    plan = decompose_search(searches, scope, names, terms, closure, types, now, cap)
    new = settle(reject_known(plan, held, ["search_id", "query_text"]))
    bridge = lambda c, name: new.select("search_id", "query_text", F.explode(c).alias(name)).distinct()
    return {"queries": new.drop("names", "terms"), "query_names": bridge("names", "name"), "query_terms": bridge("terms", "term")}


def query_state(queries: DataFrame) -> DataFrame:
    """``state`` from timestamps and search_status, first rule that holds."""
    state = (
        F.when(F.col("discarded_at").isNotNull(), "discarded")
        .when(F.col("completed_at").isNotNull(), "completed")
        .when(F.col("search_status").isin("draft", "ready"), "in_plan_review")
        .when(F.col("started_at").isNotNull(), "running_or_interrupted")
        .otherwise("queued")
    )
    return queries.withColumn("state", state)


def runnable_queries(queries: DataFrame) -> DataFrame:
    return queries.where("search_status = 'active' and completed_at is null and discarded_at is null").orderBy("slice_start", "query_text")


def covering_queries(queries: DataFrame) -> DataFrame:
    return queries.where("completed_at is not null and discarded_at is null").where(T.result_mode(F.col("query_text")) == "latest")


def coverage(slices: DataFrame, by: list[str]) -> DataFrame:
    """Per key: covered slices and seconds, gaps between them and their seconds."""
    w = Window.partitionBy(*by).orderBy("slice_start", "slice_end").rowsBetween(Window.unboundedPreceding, -1)
    once = slices.select(*by, "slice_start", "slice_end").distinct().withColumn("_to", F.max("slice_end").over(w))
    gap = F.greatest(F.unix_seconds("slice_start") - F.unix_seconds("_to"), F.lit(0))
    return once.groupBy(*by).agg(
        F.count("*").alias("slices"),
        F.sum(F.unix_seconds("slice_end") - F.unix_seconds("slice_start")).alias("covered_seconds"),
        F.coalesce(F.sum((gap > 0).cast("long")), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("gap_seconds"),
    )


def settled_query_guard(queries: DataFrame, verb: str, now: Column) -> DataFrame:
    """Queries after start / complete / discard, with ``refused`` saying why nothing changed."""
    done = F.col("completed_at").isNotNull() | F.col("discarded_at").isNotNull()
    asking = F.col("search_status") == "active" if verb == "start" else F.col("search_status").isin("active", "paused")
    refused = F.when(done, "settled").when(~asking, "search_not_asking")
    column = {"start": "started_at", "complete": "completed_at", "discard": "discarded_at"}[verb]
    return queries.withColumn("refused", refused).withColumn(column, F.when(F.col("refused").isNull(), F.coalesce(column, now)).otherwise(F.col(column)))


def lifecycle_transition(rows: DataFrame, wanted: str, edges: list[tuple[str, str]], state: str = "lifecycle") -> DataFrame:
    """Rows with ``accepted`` and the state after: legal edges move, others stay."""
    legal = F.concat_ws(">", state, wanted).isin(*[f"{a}>{b}" for a, b in edges])
    return rows.withColumn("accepted", F.coalesce(legal, F.lit(False))).withColumn(state, F.when(F.col("accepted"), F.col(wanted)).otherwise(F.col(state)))


PLACE_EDGES = [("proposed", "active"), ("active", "deprecated"), ("proposed", "discarded"), ("active", "discarded")]
SEARCH_EDGES = [("draft", "ready"), ("ready", "active"), ("active", "paused"), ("paused", "active"), *((s, "closed") for s in ("draft", "ready", "active", "paused"))]


# --- appearances ----------------------------------------------------------------------------------


def first_appearance(appearances: DataFrame, post: str, query: str, at: str, tie: str) -> DataFrame:
    """(post, query): the query of each post's earliest appearance."""
    return appearances.groupBy(post).agg(F.min_by(query, F.struct(at, tie)).alias(query))


def query_yield(queries: DataFrame, appearances: DataFrame, post: str, query: str, at: str, tie: str) -> DataFrame:
    """Per query: posts found and posts not seen before; null for queries that nobody counted."""
    found = appearances.groupBy(query).agg(F.count_distinct(post).alias("posts_found"))
    new = first_appearance(appearances, post, query, at, tie).groupBy(query).agg(F.count("*").alias("_new"))
    counted = found.join(new, query, "left").select(query, "posts_found", F.coalesce("_new", F.lit(0)).alias("posts_new"))
    return queries.select(query).join(counted, query, "left")


def bridge_yield(items: DataFrame, bridge: DataFrame, appearances: DataFrame, item: str, query: str, post: str) -> DataFrame:
    """Per name or term: distinct posts credited through the bridge; items without any are kept at 0."""
    n = bridge.join(appearances, query).groupBy(item).agg(F.count_distinct(post).alias("posts"))
    return items.select(item).join(n, item, "left").select(item, F.coalesce("posts", F.lit(0)).alias("posts"))
