"""Registered queries on whole-beat prose, widened searches, name blocks and posts kept for good, over the driver's tables as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from testimony.functions import similarity as S
from testimony.functions import text as T
from testimony.operators import acquisition, beats, duplicates
from testimony.operators.durable import shared_path
from testimony.plans.desk import _HEARD, _STATE
from testimony.plans.queries import _CLAIMS, _FROM, _PLACES, _TO, SQL, World, query
from testimony.plans.record import _events
from testimony.streaming import streams

# --- beats of all regions -------------------------------------------------------------------------------

_BEATS = f"""with {_PLACES}, {_CLAIMS}, inside as (select ancestor as beat, claim_id, min(place_id) as anchor from links join closure on place_id = descendant where ancestor like 'R%' group by 1, 2),
placed as (select c.*, beat, anchor, min(struct_pack(t := first_seen_at, c := c.claim_id)) over (partition by beat, anchor) as f from claims c join inside i on c.claim_id = i.claim_id where first_seen_at between timestamp '{_FROM}' and timestamp '{_TO}'),
beat as (select beat, claim_id, kind, anchor, row_number() over (partition by beat order by f, anchor, first_seen_at, claim_id) as position from placed),
cites as (select beat, b.claim_id, l_partkey as post_id, row_number() over (partition by beat order by position, l_linenumber, l_partkey) as n from beat b join lineitem on l_orderkey = b.claim_id)"""


def _beats(w: World):
    asked = w.region.select(F.concat(F.lit("R"), "r_regionkey").alias("beat"), F.concat(F.lit("R"), "r_regionkey").alias("root"), F.lit(_FROM).alias("start"), F.lit(_TO).alias("end"))
    ordered = beats.settle(beats.order_beats(w.claims(), w.links(), w.closure(), asked))
    cites = w.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("post_id"), F.col("l_linenumber").alias("ord"))
    return ordered, beats.beat_sources(ordered, cites)


@query(f"{_BEATS} select beat, claim_id, post_id, n from cites")
def beat_sources(spark, sf):
    return _beats(World(spark, sf))[1].select("beat", "claim_id", "post_id", "n")


@query(f"""{_BEATS}, marks as (select beat, claim_id, string_agg('[' || n || ']', '' order by n) as m from cites group by 1, 2),
told as (select b.beat, position, s_name, kind || ' ' || b.claim_id || coalesce(m, '') as t, case when s_name is not distinct from lag(s_name) over (partition by b.beat order by position) and position > 1 then 0 else 1 end as c
  from beat b left join marks m on b.beat = m.beat and b.claim_id = m.claim_id join supplier on anchor = 'S' || s_suppkey),
runs as (select *, sum(c) over (partition by beat order by position) as run from told),
sentences as (select beat, run, 'En ' || min(s_name) || ', ' || string_agg(t, '; ' order by position) || '.' as s from runs group by 1, 2)
select beat, sum(len(string_split(s, '; ')))::bigint as clauses, sha256(string_agg(s, ' ' order by run)) as prose from sentences group by beat""")
def render_beats(spark, sf):
    w = World(spark, sf)
    ordered, sources = _beats(w)
    marks = sources.groupBy("beat", "claim_id").agg(F.array_sort(F.collect_list("n")).alias("cite_ns"))
    names = w.places().select(F.col("id").alias("anchor"), F.col("name").alias("place_name"))
    clauses = ordered.join(marks, ["beat", "claim_id"], "left").join(names, "anchor")
    clauses = clauses.select("beat", "position", "place_name", F.concat_ws(" ", "kind", F.col("claim_id").cast("string")).alias("text"), "cite_ns")
    return beats.render_beats(clauses, ["beat"]).select("beat", "clauses", F.sha2("prose", 256).alias("prose"))


# --- searches -------------------------------------------------------------------------------------------


@query(f"""select search_id, query_text, said as name, t.term from (select *, case when strpos(query_text, 'casa') > 0 then 'casa ' || substr(place_id, 2) else (select s_name from supplier where 'S' || s_suppkey = place_id) end as said from ({SQL["decompose_search"]}))
left join (select n_nationkey as n, 'agua' as term from nation where n_nationkey % 2 = 0) t on n = search_id where substr(place_id, 2)::bigint % 3 > 0""")
def extend_search(spark, sf):
    """A search of a third of the places, widened to all."""
    w = World(spark, sf)
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    start = F.lit(1704067200)
    searches = w.nation.select(n.alias("search_id"), F.timestamp_seconds(start).alias("window_start"), F.timestamp_seconds(start + n % 3 * 3600).alias("window_end"), F.lit(1200).alias("slice_seconds"), F.lit("latest").alias("result_mode"))
    scope = w.supplier.select(F.col("s_nationkey").alias("search_id"), F.concat(F.lit("S"), s.cast("string")).alias("place_id"))
    raw = w.places().select(F.col("id").alias("place_id"), "name", F.lit("raw").alias("emission"))
    anchored = w.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), s.cast("string")).alias("place_id"), F.concat(F.lit("casa "), s.cast("string")).alias("name"), F.lit("anchored").alias("emission"))
    terms = w.nation.where("n_nationkey % 2 = 0").select(n.alias("search_id"), F.lit("agua").alias("term"))
    types = w.places().select("id", F.when(F.col("id").startswith("R"), " País ").otherwise("estado").alias("type"))
    rest = (raw.unionByName(anchored), terms, w.closure(), types, F.current_timestamp())
    held = acquisition.decompose_search(searches, scope.where(F.substring("place_id", 2, 9).cast("long") % 3 == 0), *rest)
    new = acquisition.extend_search(searches, scope, *rest, held.select("search_id", "query_text"))
    return new["queries"].join(new["query_names"], ["search_id", "query_text"]).join(new["query_terms"], ["search_id", "query_text"], "left").select("search_id", "query_text", "name", "term")


@query(f"select * from ({_STATE}) where state in ('running_or_interrupted', 'queued')")
def runnable_queries(spark, sf):
    at = lambda rule: F.when(F.expr(rule), F.col("l_shipdate"))
    rows = World(spark, sf).lineitem.withColumns({"discarded_at": at("l_quantity > 40"), "completed_at": at("l_returnflag = 'A'"), "started_at": at("l_tax > 0.04"), "search_status": F.when(F.col("l_linestatus") == "F", "draft").otherwise("active")})
    rows = rows.withColumns({"slice_start": F.col("l_shipdate"), "query_text": F.col("l_orderkey").cast("string")})
    return acquisition.query_state(acquisition.runnable_queries(rows)).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "state")


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem where l_returnflag = 'A' and l_quantity <= 40 and l_linenumber % 2 = 0")
def covering_queries(spark, sf):
    at = lambda rule: F.when(F.expr(rule), F.col("l_shipdate"))
    mode = F.when(F.col("l_linenumber") % 2 == 0, "agua queryType=Latest").otherwise(F.when(F.col("l_linenumber") % 3 == 0, "agua").otherwise("agua queryType=Top"))
    rows = World(spark, sf).lineitem.withColumns({"discarded_at": at("l_quantity > 40"), "completed_at": at("l_returnflag = 'A'"), "query_text": mode})
    return acquisition.covering_queries(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("select event_id, left(sha256(event_id::varchar), 8) as short from events")
def short_id(spark, sf):
    return World(spark, sf).events.select("event_id", T.short_id(F.sha2(F.col("event_id").cast("string"), 256)).alias("short"))


# --- names ----------------------------------------------------------------------------------------------

_WORDS = "select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark"


@query(f"with words as ({_WORDS}) select x.w as a, y.w as b, round(jaro_similarity(x.w, y.w), 6) as score from words x join words y on x.w < y.w where jaro_similarity(x.w, y.w) >= 0.92")
def alike_words(spark, sf):
    """Runs of letters a-z of the benchmark's texts that read almost the same."""
    w = World(spark, sf).benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("a")).distinct()
    return S.alike(w, w.toDF("b"), 0.92).where("a < b").withColumn("score", F.round("score", 6))


_NAMED = f"""with people as (select p_partkey as id, p_size as block, string_split({_HEARD} || case p_partkey % 3 when 0 then '' when 1 then ' solis' else ' mata' end, ' ') as w from part),
p as (select id, block, w[1] as first, w[2:] as rest from people),
met as (select x.block, x.id as a, y.id as b, case when len(x.rest) <= len(y.rest) then x.rest else y.rest end as s, case when len(x.rest) <= len(y.rest) then y.rest else x.rest end as l
  from p x join p y on x.block = y.block and x.id < y.id where jaro_similarity(x.first, y.first) >= 0.9),
settled as (select block, a, b from met where list_min([list_max([jaro_similarity(u, v) for v in l]) for u in s]) >= 0.9 or jaro_similarity(array_to_string(s, ''), array_to_string(l, '')) >= 0.9)"""


def _blocks(w: World):
    i = F.col("p_partkey")
    people = w.part.select(i.alias("id"), F.concat("p_name", F.when(i % 3 == 0, "").when(i % 3 == 1, " Solís").otherwise(" Mata")).alias("full_name"))
    return w.part.select(F.col("p_size").cast("long").alias("block"), i.alias("id")), people


@query(f"{_NAMED} select block::bigint as block, a, b from settled")
def position_matches(spark, sf):
    return duplicates.position_blocks(*_blocks(World(spark, sf)))[0]


@query(f"{_NAMED} select block::bigint as block, id from people where (block, id) not in (select block, a from settled union select block, b from settled)")
def position_residue(spark, sf):
    return duplicates.position_residue(*_blocks(World(spark, sf)))


# --- posts for good -------------------------------------------------------------------------------------


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def posts_for_ever(spark, sf):
    """The first event of each user, kept by a stream."""
    rows = _events(spark, sf)
    out = shared_path(spark, "kept")
    streams.posts_for_ever(rows, ["user_id"], ["ts", "event_id"], out)
    return streams.stored_posts(rows, out).select("user_id", "event_id", "event_type")
