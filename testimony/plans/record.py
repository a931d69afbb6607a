"""Registered queries on judging, resolving, merging and answering, over the driver's tables as stand-ins."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators import acquisition, answers, curation, duplicates, graphs, history, names, report, resolution, trees
from testimony.plans.queries import _ANSWERS, _CLAIMS, _PLACES, SQL, World, query
from testimony.streaming import streams

# --- places -----------------------------------------------------------------------------------------

_LIFE = "case when n_nationkey % 7 = 3 then 'discarded' when n_nationkey % 5 < 2 then 'deprecated' else 'active' end"
#: Nations as places of one event: some deprecated in favour of the next, some discarded.
_NATIONS = f"select n_nationkey as id, {_LIFE} as lifecycle, case when {_LIFE} = 'deprecated' then n_nationkey + 1 end as replaced_by_id from nation"
_CLOSED = SQL["exclusive_answers"].split("\nselect event_id", 1)[0].replace("partition by user_id", "partition by k").replace("case when none then null else slot end", "none")


def _sql(w: World, text: str, *tables: str):
    return w.spark.sql(text, **{t: getattr(w, t) for t in tables})


@query(f"""with recursive nations as ({_NATIONS}), hop(id, spot, life, nxt) as (
  select id, id, lifecycle, replaced_by_id from nations union all
  select h.id, n.id, n.lifecycle, n.replaced_by_id from hop h join nations n on n.id = h.nxt where h.life = 'deprecated'),
ends as (select id, spot from hop where life = 'active'), logged as ({_CLOSED} select k, user_id, none, nxt, other from o),
now as (select k, user_id, none from logged where nxt is null and other is null)
select k as post_id, case when spot is not null then 'place' when none then 'no_place' else 'unplaced' end as answer, case when spot is not null then spot when not none then -1 end::bigint as place_id
from now left join ends on ends.id = user_id % 25 and not none""")
def where_of_post(spark, sf):
    w = World(spark, sf)
    places = _sql(w, _NATIONS.replace("from nation", "from {nation}"), "nation").select(F.col("id").cast("long"), "lifecycle", F.col("replaced_by_id").cast("long"))
    log = history.exclusive_answers(w.answers(), ["k"], [], F.col("none"), "ts", "event_id").where("superseded_at is null")
    posts = w.answers().select(F.col("k").alias("post_id")).distinct()
    now = log.select(F.col("k").alias("post_id"), (F.col("user_id") % 25).alias("place_id"), "none")
    return resolution.where_of_post(posts, now.where("not none"), now.where("none"), places, F.lit(-1).cast("long"))


@query("""with m as (select c_custkey as claim_id, c_nationkey as k from customer)
select claim_id, case claim_id % 5 when 0 then 'NATION_' || k when 1 then 'NATIONS_' || k when 2 then 'edificio Alto ' || claim_id % 7 when 3 then 'casa ' || claim_id else 'Supplier#' || lpad((claim_id % 50)::varchar, 9, '0') end as original,
  case claim_id % 5 when 2 then 'proposed' when 3 then 'unresolved' else 'linked' end as outcome,
  case claim_id % 5 when 0 then 'mention_exact' when 1 then 'mention_fuzzy' when 2 then 'mention_ancestor' when 4 then 'mention_exact' end as how_resolved,
  case claim_id % 5 when 0 then 0.9 when 1 then 0.65 when 2 then 0.5 when 4 then 0.9 end::double as confidence,
  case claim_id % 5 when 0 then 'NATION_' || k when 1 then 'NATION_' || k when 2 then 'Alto ' || claim_id % 7 || ' in N' || k when 4 then 'Supplier#' || lpad((claim_id % 50)::varchar, 9, '0') end as place
from m""")
def resolve_places(spark, sf):
    w = World(spark, sf)
    k, i = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    said = (
        F.when(i % 5 == 0, F.concat(F.lit("NATION_"), k))
        .when(i % 5 == 1, F.concat(F.lit("NATIONS_"), k))
        .when(i % 5 == 2, F.concat(F.lit("NATION_"), k, F.lit(", edificio Alto "), (i % 7).cast("string")))
        .when(i % 5 == 3, F.concat(F.lit("casa "), i.cast("string")))
        .otherwise(F.concat(F.lit("estado, Supplier#"), F.lpad((i % 50).cast("string"), 9, "0")))
    )
    claims = w.customer.select(i.alias("claim_id"), F.lit(1).alias("event_id"), said.alias("place_mention"))
    places = w.places().select("id", F.lit(1).alias("event_id"), "parent_id", F.col("name").alias("canonical_name"), F.lit("active").alias("lifecycle"), F.lit(0).alias("inserted_at"))
    none = spark.createDataFrame([], "claim_id long, how_resolved string")
    out, new = resolution.resolve_places(claims, none, places, places.select(F.col("id").alias("place_id"), F.col("canonical_name").alias("name")), w.closure())
    known = places.select(F.col("id").alias("place_id"), F.col("canonical_name").alias("place"))
    known = known.unionByName(new.select(F.col("id").alias("place_id"), F.concat("canonical_name", F.lit(" in "), "parent_id").alias("place")))
    return out.join(known, "place_id", "left").select("claim_id", "original", "outcome", "how_resolved", "confidence", "place")


_WORDS = r"regexp_extract_all(trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')), '[\p{L}\p{N}]+')"


@query(f"""with names as (select distinct array_to_string({_WORDS}[:3], ' ') as name from benchmark where len({_WORDS}) >= 3),
w as (select doc_id, {_WORDS} as w from documents), p as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)
select distinct doc_id as id, name from p join names on name = w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]""")
def post_place_scan(spark, sf):
    w = World(spark, sf)
    said = F.regexp_extract_all(T.fold(F.col("text")), F.lit(r"([\p{L}\p{N}]+)"))
    names = w.benchmark.where(F.size(said) >= 3).select(F.array_join(F.slice(said, 1, 3), " ").alias("name"))
    return resolution.post_place_scan(w.documents, names, "doc_id", "text")


@query("""with kinds as (select distinct lower(p_type) || ' ' || p_name as kind from part), themes as (select distinct p_name as name from part),
s as (select kind, name, list_avg([list_max([jaro_similarity(x, t) for x in string_split(kind, ' ')]) for t in string_split(name, ' ')]) as score from kinds, themes)
select kind, name as theme_id, round(score, 6) as score from s where score >= 0.9 qualify row_number() over (partition by kind order by score desc, name) = 1""")
def file_themes(spark, sf):
    part = World(spark, sf).part.withColumn("event_id", F.lit(1))
    themes = part.select("event_id", F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lit("happening").alias("nature"), F.lit("active").alias("lifecycle")).distinct()
    kinds = part.select("event_id", F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("kind"))
    return resolution.file_themes(kinds, themes).select("kind", "theme_id", F.round("score", 6).alias("score"))


# --- groups -----------------------------------------------------------------------------------------

_PAIRS = f"""with recursive pairs as materialized ({SQL["near_names"].replace(">= 0.8", ">= 0.88")}), edges as (select a as u, b as v from pairs union select b, a from pairs),
reach(u, v) as (select u, v from edges union select r.u, b.v from reach r join edges b on r.v = b.u),
comp as (select u as node, least(u, min(v)) as component from reach group by u),
size as (select component, count(*) as size, string_agg(node, ',' order by node) as members from comp group by component)"""


def _near(spark, sf):
    return duplicates.settle(duplicates.name_pairs(World(spark, sf).part, "p_name", 0.88))


@query(f"{_PAIRS} select component, size, n_pairs, members from size join (select component, count(*) as n_pairs from pairs join comp on a = node group by component) using (component)")
def pair_groups(spark, sf):
    return graphs.pair_groups(_near(spark, sf)).withColumn("members", F.array_join("members", ","))


@query(f"{_PAIRS} select a, b, round(score, 6) as score from pairs join comp on a = node join size using (component) where size = 2")
def standalone_pairs(spark, sf):
    return graphs.standalone_pairs(_near(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""{_PAIRS}, sets as (select u, list_sort(list_distinct(list_append(list(v), u))) as m from edges group by u), once as (select m, min(u) as block from sets group by m)
select block, array_to_string(m, ',') as members from once o where not exists (select 1 from once x where len(x.m) > len(o.m) and list_has_all(x.m, o.m))""")
def neighbourhoods(spark, sf):
    return graphs.neighbourhoods(_near(spark, sf)).withColumn("members", F.array_join("members", ","))


@query("select c_custkey as id, c_custkey - c_custkey % 4 as final, false as loops from customer")
def person_current(spark, sf):
    i = F.col("c_custkey")
    return trees.follow_redirects(World(spark, sf).customer.select(i.alias("id"), F.when(i % 4 > 0, i - 1).alias("next_id")))


@query("select o_orderkey as id, min(o_orderkey) over (partition by o_custkey) as final, false as loops from orders")
def long_redirects(spark, sf):
    """Each order gives way to the one before it of the same customer: chains as long as customers have orders."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return trees.follow_redirects(World(spark, sf).orders.select(F.col("o_orderkey").alias("id"), before.alias("next_id")))


@query("""select x.l_suppkey as person, y.l_suppkey as other, count(distinct x.l_orderkey) as claims from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey <> y.l_suppkey group by 1, 2""")
def beside_pairs(spark, sf):
    return duplicates.beside_pairs(World(spark, sf).lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("person_id")))


@query("select distinct x.l_suppkey as person, string_agg(distinct y.l_suppkey::varchar, ',' order by y.l_suppkey::varchar) as others from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_suppkey <> y.l_suppkey group by x.l_suppkey")
def beside(spark, sf):
    named = World(spark, sf).lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").cast("string").alias("person_id")).distinct()
    return duplicates.beside(named).select(F.col("person").cast("long").alias("person"), F.array_join("others", ",").alias("others"))


# --- checks and verdicts ------------------------------------------------------------------------------

_THEMED = "select o_orderkey as claim_id, 1 as event_id, o_orderpriority as theme_id, case when o_custkey % 5 = 0 then 'person' else 'agent' end as actor_kind, case when o_custkey % 3 > 0 then o_totalprice / 400000 end as confidence from orders"
_THEMES = "select distinct o_orderpriority as id, case when o_orderpriority like '4%' then 2 else 1 end as event_id, case when o_orderpriority like '3%' then 'deprecated' else 'active' end as lifecycle, case when o_orderpriority like '2%' then 'topic' else 'happening' end as nature from orders where o_orderpriority not like '5%'"


#: Claims with texts that name parts in capitals, as people would be.
_NAMING = f"""select c.*, case claim_id % 4 when 0 then 'Hay daños en ' || upper(p_name) when 1 then 'El EDIFICIO ' || upper(p_name) when 2 then upper(p_name) || ' y Los CORALES NORTE' end as subject,
  case when claim_id % 3 > 0 then 'rescate de ' || upper(p_name) else 'rescate' end as kind, case when claim_id % 5 > 0 then 'lo dijo Juan ' || upper(p_name) end as nuance
from ({_THEMED}) c join part on p_partkey = claim_id % 100"""
#: Places whose names are parts' names, hold them or are held by them; some are of another event or not active.
_NAMESAKES = """select p_partkey as id, case when p_name like '%bolt' then 2 else 1 end as event_id, case when p_name like 'hot%' then 'proposed' else 'active' end as lifecycle,
  case when p_name like 'small%' or p_name like 'hot%' then p_name when p_name like 'red%' then 'El ' || p_name || ' Norte' when p_name like '%gear' then 'Geár' else 'Lugar ' || p_partkey end as canonical_name from part"""
_FIGURES = ["Juan Old Widget", "hot"]
_CANDIDATES = rf"""places as ({_NAMESAKES}), known as (select event_id, strip_accents(lower(canonical_name)) as name from places where lifecycle = 'active' union select 1, 'corales norte'),
said as (select claim_id, event_id, 'subject' as field, subject as text from c union all select claim_id, event_id, 'kind', kind from c union all select claim_id, event_id, 'nuance', nuance from c),
runs as (select claim_id, event_id, field, unnest(regexp_extract_all(text, '\p{{Lu}}\p{{L}}+(?:\s+(?:de|del|la|las|los|y|e)\s+\p{{Lu}}\p{{L}}+|\s+\p{{Lu}}\p{{L}}+)+')) as run from said),
bare as (select claim_id, event_id, field, regexp_replace(part, '^(?i:(?:el|la|los|las)\s+)+', '') as name from (select *, unnest(string_split_regex(run, '\s+[ye]\s+')) as part from runs)),
bad as (select distinct claim_id, field, name from bare b where name like '% %' and lower(name) not like 'edificio %'
  and not exists (select 1 from known k where k.event_id = b.event_id and (contains(k.name, strip_accents(lower(b.name))) or contains(strip_accents(lower(b.name)), k.name)))
  and not (field = 'nuance' and exists (select 1 from (values ({"), (".join(f"'{x.lower()}'" for x in _FIGURES)})) f(name) where contains(f.name, lower(b.name)) or contains(lower(b.name), f.name))))"""


def _naming(w: World):
    claims = _sql(w, _NAMING.replace("from orders", "from {orders}").replace("join part", "join {part}"), "orders", "part")
    places = _sql(w, _NAMESAKES.replace("from part", "from {part}"), "part")
    surface = w.spark.createDataFrame([("Corales Norte",)], "name string").join(places.where("event_id = 1 and lifecycle = 'active'").agg(F.min("id").alias("place_id")))
    return claims, names.gazetteer_names(places, surface)


@query(f"with c as ({_NAMING}), {_CANDIDATES} select claim_id, field, name from bad")
def private_names(spark, sf):
    claims, known = _naming(World(spark, sf))
    of = lambda c: claims.select(F.struct("claim_id", F.lit(c).alias("field")).alias("id"), "event_id", F.col(c).alias("text"))
    found = names.unexplained_names(of("subject").unionByName(of("kind")), known).unionByName(names.unexplained_names(of("nuance"), known, _FIGURES))
    return found.select("id.claim_id", "id.field", "name")


@query(f"""with c as ({_NAMING}), t as ({_THEMES}), {_CANDIDATES}
select claim_id, concat_ws(',', case when theme_id is not null and t.id is null then 'theme_missing' end, case when t.event_id <> c.event_id then 'theme_of_other_event' end, case when lifecycle <> 'active' then 'theme_not_active' end,
  case when nature = 'topic' then 'theme_is_topic' end,
  case when claim_id in (select claim_id from bad where field = 'subject') then 'subject_names_person' end, case when claim_id in (select claim_id from bad where field = 'kind') then 'kind_names_person' end,
  case when claim_id in (select claim_id from bad where field = 'nuance') then 'nuance_names_person' end,
  case when actor_kind = 'agent' and confidence is null then 'confidence_missing' end, case when actor_kind = 'person' and confidence is not null then 'confidence_given' end,
  case when confidence < 0 or confidence > 1 then 'confidence_out_of_range' end) as reasons from c left join t on t.id = theme_id""")
def validate_claims(spark, sf):
    w = World(spark, sf)
    claims, known = _naming(w)
    themes = _sql(w, _THEMES.replace("from orders", "from {orders}"), "orders")
    return curation.validate_claims(claims, themes, known, _FIGURES).select("claim_id", F.array_join("reasons", ",").alias("reasons"))


@query("""with l as (select l_orderkey * 8 + l_linenumber as id, c_nationkey as event_id, l_suppkey from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)
select l.id, 'place_id' as field, case when s_suppkey is null then 'does not exist' else 'another event' end as problem from l left join supplier on s_suppkey = l_suppkey and s_suppkey % 10 > 0
where s_suppkey is null or s_nationkey <> event_id""")
def same_event_check(spark, sf):
    w = World(spark, sf)
    of = w.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(w.customer.select("c_custkey", F.col("c_nationkey").alias("event_id")), "c_custkey")
    links = w.lineitem.join(of, "l_orderkey").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "event_id", F.col("l_suppkey").alias("place_id"))
    return curation.same_event_check(links, {"place_id": w.supplier.where("s_suppkey % 10 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("event_id"))})


@query(f"""with {_PLACES}, lived as (select *, case when id like 'N%3' then 'deprecated' else 'active' end as lifecycle, case when id like 'S%' then 1 else 2 end as event_id from places),
moves as (select id, event_id, case when id like 'S%' then 'N' || substr(id, 2)::int % 30 when id like 'N%' then id else 'N' || substr(id, 2) end as new_parent_id from lived)
select m.id, new_parent_id, concat_ws(',', case when p.id is null then 'missing' end, case when p.event_id <> m.event_id then 'other_event' end, case when lifecycle <> 'active' then 'not_active' end,
  case when m.id = new_parent_id then 'itself' end, case when c.depth > 0 then 'beneath_itself' end) as reasons
from moves m left join lived p on p.id = new_parent_id left join closure c on c.ancestor = m.id and c.descendant = new_parent_id and c.depth > 0""")
def reference_check(spark, sf):
    w = World(spark, sf)
    i, kind = F.col("id"), F.left("id", F.lit(1))
    n = F.expr("substring(id, 2)")
    lived = w.places().withColumns({"lifecycle": F.when((kind == "N") & i.endswith("3"), "deprecated").otherwise("active"), "event_id": F.when(kind == "S", 1).otherwise(2)})
    to = F.when(kind == "S", F.concat(F.lit("N"), (n.cast("int") % 30).cast("string"))).when(kind == "N", i).otherwise(F.concat(F.lit("N"), n))
    return curation.reference_check(lived.select("id", "event_id", to.alias("new_parent_id")), lived, w.closure()).select("id", "new_parent_id", F.array_join("reasons", ",").alias("reasons"))


@query("""with r as (select l_orderkey as pair_id, count(distinct l_returnflag) filter (l_returnflag in ('A', 'R') and l_linestatus = 'F') as n from lineitem group by 1)
select o_orderkey as pair_id, case coalesce(n, 0) when 2 then 'same' when 1 then 'split' else 'different' end as verdict from orders left join r on pair_id = o_orderkey""")
def pair_verdicts(spark, sf):
    w = World(spark, sf)
    order = F.when(F.col("l_returnflag") == "A", "straight").when(F.col("l_returnflag") == "R", "swapped").otherwise("other")
    readings = w.lineitem.select(F.col("l_orderkey").alias("pair_id"), order.alias("order"), F.when(F.col("l_linestatus") == "F", " same").otherwise("APART").alias("verdict"))
    return curation.pair_verdicts(w.orders.select(F.col("o_orderkey").alias("pair_id")), readings)


@query(f"""with {_CLAIMS} select claim_id, support from claims where support in ('overstated', 'unsupported')
and (claim_id, support) not in (select l_orderkey, case l_linestatus when 'F' then 'overstated' else 'unsupported' end from lineitem where l_quantity > 40 and l_orderkey is not null)""")
def accepted_verdicts(spark, sf):
    w = World(spark, sf)
    accepted = w.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("claim_id"), F.when(F.col("l_linestatus") == "F", "overstated").otherwise("unsupported").alias("support"))
    return report.accepted_verdicts(w.claims().where("support in ('overstated', 'unsupported')"), accepted).select("claim_id", "support")


@query("""select l.quality as stratum, count(*) as total, count(*) filter (toxic = 0 and d.lang = 'en') as "right", coalesce(string_agg(l.doc_id::varchar, ',' order by l.doc_id) filter (not coalesce(toxic = 0 and d.lang = 'en', false)), '') as misses
from labels l left join documents d on d.doc_id = l.doc_id group by l.quality""")
def score_adjudicated(spark, sf):
    totals, misses = _adjudicated(spark, sf)
    listed = misses.groupBy("stratum").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), ",").alias("misses"))
    listed = listed.withColumnRenamed("stratum", "_s")
    return totals.join(listed, F.col("stratum").eqNullSafe(F.col("_s")), "left").select("stratum", "total", "right", F.coalesce("misses", F.lit("")).alias("misses"))


def _adjudicated(spark, sf):
    w = World(spark, sf)
    rulings = w.labels.select(F.col("doc_id").alias("claim_id"), F.col("quality").alias("stratum"), F.when(F.col("toxic") == 0, "en").alias("verdict"))
    return curation.score_adjudicated(rulings, w.documents.select(F.col("doc_id").alias("claim_id"), F.col("lang").alias("verdict")), ["stratum"])


@query("""select l.quality as stratum, l.doc_id as claim_id, case when toxic = 0 then 'en' end as ruled, d.lang as said
from labels l left join documents d on d.doc_id = l.doc_id where not coalesce(toxic = 0 and d.lang = 'en', false)""")
def adjudicated_misses(spark, sf):
    return _adjudicated(spark, sf)[1]


@query("select 'too_few_tokens' as reason, count(*) as n from customer where c_name is not null having count(*) > 0")
def refusal_groups(spark, sf):
    return report.refusal_groups(World(spark, sf).customer.where("c_name is not null"), "c_name")


# --- merges -----------------------------------------------------------------------------------------

_RULED = """ruled as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders),
closed as (select unnest([x.o_orderkey, y.o_orderkey]) as claim_id, case when (x.o_orderdate, x.o_orderkey) <= (y.o_orderdate, y.o_orderkey) then x.o_orderkey else y.o_orderkey end as successor_id
  from ruled x join ruled y on x.o_custkey = y.o_custkey and x.rn % 2 = 1 and y.rn = x.rn + 1)"""


def _closed(w: World):
    over = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = w.orders.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(over).alias("b"), F.row_number().over(over).alias("rn")).where("rn % 2 = 1 and b is not null")
    claims = w.claims().select("claim_id", "first_seen_at", F.col("first_seen_at").alias("inserted_at"))
    return curation.merge_claims(claims, pairs)


@query(f"with {_RULED} select claim_id, successor_id from closed where claim_id <> successor_id")
def merge_claims(spark, sf):
    return _closed(World(spark, sf))


@query(f"""with {_RULED}, moved as (select coalesce(successor_id, l_orderkey) as claim_id, l_suppkey, l_linenumber, successor_id is null or successor_id = l_orderkey as own, l_partkey from lineitem left join closed on claim_id = l_orderkey)
select claim_id, l_suppkey, l_linenumber, l_partkey from moved qualify row_number() over (partition by claim_id, l_suppkey order by own desc, l_linenumber desc, l_partkey desc) = 1""")
def merged_links(spark, sf):
    w = World(spark, sf)
    links = w.lineitem.select(F.col("l_orderkey").alias("claim_id"), "l_suppkey", "l_linenumber", "l_partkey")
    return curation.merged_links(links, _closed(w), "l_suppkey", ["l_linenumber", "l_partkey"])


@query()
def merge_persons(spark, sf):
    """Not SQL: each pair depends on the folds before it. Tests apply the pairs one by one."""
    w = World(spark, sf)
    persons = w.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("inserted_at"))
    pairs = w.orders.select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 9 - 4).alias("b"))
    return curation.merge_persons(persons, pairs)


@query("""select s_suppkey as claim_id, 'N' || case when s_nationkey % 5 = 4 then s_nationkey - 1 else s_nationkey end as place_id,
  case when s_nationkey % 5 = 4 then 'manual' else 'mention_exact' end as how_resolved, case when s_nationkey % 5 < 4 then s_acctbal end as confidence from supplier""")
def fold_places(spark, sf):
    w = World(spark, sf)
    places = w.places().select("id", "parent_id", F.lit("active").alias("lifecycle"), F.lit(None).cast("string").alias("replaced_by_id"))
    names = w.places().select(F.col("id").alias("place_id"), "name", F.lit("official").alias("kind"))
    links = w.supplier.select(F.col("s_suppkey").alias("claim_id"), F.concat(F.lit("N"), "s_nationkey").alias("place_id"), F.lit("mention_exact").alias("how_resolved"), F.col("s_acctbal").alias("confidence"))
    folds = w.nation.where("n_nationkey % 5 = 4").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("N"), F.col("n_nationkey") - 1).alias("into"))
    return curation.fold_places(places, names, links, folds)[2]


# --- answers ----------------------------------------------------------------------------------------


def _said(prompts: list[str]) -> list[str]:
    """Stands for a model: to a prompt of documents as JSON, the answer that ``_answered`` builds."""
    out = []
    for prompt in prompts:
        claims, topics = [], []
        for d in json.loads(prompt):
            i, source, lang = d["doc_id"], d.get("source"), d.get("lang")
            theme = source if i % 4 == 0 else (lang or "").upper() or None if i % 4 == 2 else "nobody knows"
            if i % 4 in (0, 2) or i % 8 == 7:
                said = f"#id: {i}" if i % 4 == 2 else f"id {i}"
                claims.append({"theme": theme, "kind": "zz", "subject_role": f"post {i}, Ana", "names": ["Ana"], "confidence": "0.5 or so", "citations": [said]})
            elif i % 4 == 1:
                topics.append({"topic": lang, "citations": [str(i)]})
        out.append("```json\n" + json.dumps({"claims": claims, "topics": topics}) + "\n```")
    return out


def _answered(w: World, asked: bool = False):
    """One answer a batch of 25 documents, as JSON: a claim, a topic, a misplaced topic, an unknown theme, or nothing. ``asked``: by a model that is called."""
    i = F.col("doc_id")
    said = F.concat(F.when(i % 4 == 2, "#id: ").otherwise("id "), i.cast("string"))
    theme = F.when(i % 4 == 0, F.col("source")).when(i % 4 == 2, F.upper("lang")).otherwise("nobody knows")
    who = F.concat(F.lit("post "), i.cast("string"), F.lit(", Ana"))
    claim = F.when((i % 4).isin(0, 2) | (i % 8 == 7), F.struct(theme.alias("theme"), F.lit("zz").alias("kind"), who.alias("subject_role"), F.array(F.lit("Ana")).alias("names"), F.lit("0.5 or so").alias("confidence"), F.array(said).alias("citations")))
    topic = F.when(i % 4 == 1, F.struct(F.col("lang").alias("topic"), F.array(i.cast("string")).alias("citations")))
    docs = w.documents.withColumn("batch", F.floor(i / 25))
    body = F.to_json(F.struct(F.collect_list(claim).alias("claims"), F.collect_list(topic).alias("topics")))
    told = docs.groupBy(F.lit(1).alias("event_id"), "batch").agg(F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer"))
    if asked:
        prompts = docs.groupBy(F.lit(1).alias("event_id"), "batch").agg(F.to_json(F.collect_list(F.struct("doc_id", "source", "lang"))).alias("prompt"))
        told = answers.infer_batches(prompts, _said, ["event_id", "batch"]).where("refused is null").select("event_id", "batch", "answer")
    posts = docs.select("batch", i.cast("string").alias("x_id"), i.alias("post_id"), (F.timestamp_seconds(i * 60)).alias("posted_at"))
    named = lambda c, nature: w.documents.where(F.col(c).isNotNull()).select(F.lit(1).alias("event_id"), F.concat(F.lit(nature), F.lit(":"), c).alias("id"), F.col(c).alias("name"), F.lit(nature).alias("nature"), F.lit("active").alias("lifecycle")).distinct()
    themes = named("source", "happening").unionByName(named("lang", "topic"))
    return posts, answers.ingest_answers(told, posts, themes)


@query("""select 'post ' || doc_id as subject, case when doc_id % 4 = 0 and source is not null then 'drafted' when doc_id % 4 = 2 and lang is not null then 'routed' else 'no_theme' end as outcome,
  case when doc_id % 4 = 0 then 'happening:' || source when doc_id % 4 = 2 then 'topic:' || lang end as theme_id, 0.5::double as confidence, doc_id * 60 as seen from documents where doc_id % 2 = 0 or doc_id % 8 = 7""")
def ingest_answers(spark, sf):
    claims = _answered(World(spark, sf))[1]["claims"]
    return claims.select("subject", "outcome", "theme_id", "confidence", F.unix_seconds("first_seen_at").alias("seen"))


@query(SQL["ingest_answers"])
def infer_batches(spark, sf):
    claims = _answered(World(spark, sf), asked=True)[1]["claims"]
    return claims.select("subject", "outcome", "theme_id", "confidence", F.unix_seconds("first_seen_at").alias("seen"))


@query("""select doc_id // 25 as batch, count(*) as posts, count(*) filter (doc_id % 4 = 0 and source is not null) as cited, count(*) filter (doc_id % 4 in (1, 2) and lang is not null) as judged,
  count(*) filter (doc_id % 4 = 3 or (doc_id % 4 = 0 and source is null) or (doc_id % 4 = 2 and lang is null)) as silent, count(*) filter (doc_id % 4 = 1 and lang is null) as unread from documents group by 1""")
def post_accounting(spark, sf):
    posts, tables = _answered(World(spark, sf))
    return answers.post_accounting(posts, tables)


# --- collection and streams ---------------------------------------------------------------------------


@query("""with q as (select distinct user_id, date_trunc('hour', ts) as a from events), t as (select 'user ' || user_id || ' since_time:' || epoch(a)::bigint || ' until_time:' || (epoch(a)::bigint + 600) as q, user_id, a from q)
select user_id, '"user ' || user_id || '"' || substr(q, 6 + length(user_id::varchar)) || ' queryType=Latest' as query_text, epoch(a)::bigint as since_time, 'latest' as mode, 4::int as operators from t""")
def query_text(spark, sf):
    a = World(spark, sf).answers().select("user_id", F.date_trunc("hour", "ts").alias("a")).distinct()
    none = F.array().cast("array<string>")
    text = T.query_text(F.array(F.concat(F.lit("user "), F.col("user_id").cast("string"))), none, none, F.col("a"), F.timestamp_seconds(F.unix_seconds("a") + 600), F.lit("latest"))
    q = a.select("user_id", text.alias("query_text"))
    d = T.decode_query(F.col("query_text"))
    return q.select("user_id", "query_text", d["since_time"].alias("since_time"), d["mode"].alias("mode"), (T.operator_count(F.col("query_text")) + 1).alias("operators"))


@query("""select p_partkey, count(distinct o_custkey) as posts from part left join lineitem on l_partkey = p_partkey left join orders on o_orderkey = l_orderkey group by p_partkey""")
def name_yield(spark, sf):
    w = World(spark, sf)
    bridge = w.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("query_id"))
    return acquisition.bridge_yield(w.part, bridge, w.orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("post_id")), "p_partkey", "query_id", "post_id")


@query("""with w as (select time_bucket(interval 10 minutes, ts) as slice_start, count(*) as n from events group by 1)
select slice_start, slice_start + interval 10 minutes as slice_end, n from w where slice_start + interval 10 minutes <= (select max(ts) from events) - interval 10 minutes""")
def stream_slices(spark, sf):
    return streams.settle_stream(streams.stream_slices(_events(spark, sf), "ts"))


@query(f"""with {_ANSWERS}, last as (select user_id, max(struct_pack(t := ts, i := event_id)) filter (none) as n from answers group by user_id),
real as (select user_id, slot, max(struct_pack(t := ts, i := event_id)) as r from answers where not none group by 1, 2),
held as (select real.* from real join last using (user_id) where n is null or r > n)
select user_id::varchar as scope, slot::varchar as slot, r.i::varchar as id, false as none from held
union all select user_id::varchar, null, n.i::varchar, true from last where n is not null and user_id not in (select user_id from held)""")
def stream_current_answer(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    log = _events(spark, sf).select("user_id", (k % 10).alias("slot"), "ts", "event_id", (F.col("event_type") == "error").alias("none"))
    told = streams.settle_stream(streams.stream_current_answer(log, "user_id", "slot", "ts", "event_id", "none"))
    last = told.groupBy("scope").agg(F.max("version").alias("version"))
    return told.join(last, ["scope", "version"], "left_semi").select("scope", "slot", "id", "none")


def _events(spark, sf):
    # A pattern, as a stream reads a folder or what a pattern matches, and the table may be one file.
    path = f"{sf}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
