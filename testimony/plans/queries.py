"""Registered queries: the library's operators over the driver's tables, each with its SQL.

The tables stand in for the record's own: region, nation and supplier are a tree of places, orders are
claims, lineitem links claims to places and posts, events are appearances and answers, documents are posts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.functions import text as T
from testimony.operators import acquisition, beats, duplicates, fitness, history, report, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class World:
    """The stand-in tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def places(self) -> DataFrame:
        r = self.region.select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
        n = self.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
        s = self.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("parent_id"), F.col("s_name").alias("name"))
        return r.unionByName(n).unionByName(s)

    def closure(self) -> DataFrame:
        return trees.tree_closure(self.places())

    def claims(self) -> DataFrame:
        support = F.when(F.col("o_orderstatus") == "F", "supported").when(F.col("o_orderstatus") == "O", "overstated").when(F.col("o_orderstatus") == "P", "unsupported").otherwise("unverified")
        return self.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderpriority").alias("kind"), support.alias("support"))

    def links(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("S"), "l_suppkey").alias("place_id"))

    def answers(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.events.select("event_id", "ts", "user_id", k.alias("k"), (k % 10).alias("slot"), (F.col("event_type") == "error").alias("none"), "event_type", "value")


_PLACES = """places as (
  select 'R' || r_regionkey as id, null::varchar as parent_id, r_name as name from region
  union all select 'N' || n_nationkey, 'R' || n_regionkey, n_name from nation
  union all select 'S' || s_suppkey, 'N' || s_nationkey, s_name from supplier
), closure as (
  with recursive c(ancestor, descendant, depth) as (
    select id, id, 0 from places union all
    select p.parent_id, c.descendant, c.depth + 1 from c join places p on p.id = c.ancestor where p.parent_id is not null
  ) select * from c
)"""
_CLAIMS = """claims as (
  select o_orderkey as claim_id, o_custkey as person_id, o_orderdate as first_seen_at, o_orderpriority as kind,
    case o_orderstatus when 'F' then 'supported' when 'O' then 'overstated' when 'P' then 'unsupported' else 'unverified' end as support
  from orders
), links as (select l_orderkey as claim_id, 'S' || l_suppkey as place_id from lineitem)"""
_ANSWERS = """answers as (
  select event_id, ts, user_id, (props->>'$.k')::bigint as k, (props->>'$.k')::bigint % 10 as slot, event_type = 'error' as none, event_type, value from events
)"""
_FROM, _TO = "1995-01-01", "1996-06-30"
_FOLD = r"trim(regexp_replace(strip_accents(lower({})), '\s+', ' ', 'g'))"


@query(f"select doc_id, sha256({_FOLD.format('text')}) as folded from documents")
def fold(spark, sf):
    return World(spark, sf).documents.select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf):
    return World(spark, sf).documents.select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(r"select s_suppkey, array_to_string(list_sort(regexp_extract_all(s_name, '\d+')), ',') as marks from supplier")
def marks(spark, sf):
    return World(spark, sf).supplier.select("s_suppkey", F.array_join(T.marks(F.col("s_name")), ",").alias("marks"))


@query("select doc_id, case when length(text) > 180 then left(text, 180) || '…' else text end as excerpt from documents")
def excerpt(spark, sf):
    return World(spark, sf).documents.select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("""with n as (select distinct p_name as a from part), r as (select a, lower(a) as r from n)
select x.a, y.a as b, round(greatest(jaro_similarity(x.r, y.r), jaro_similarity(replace(x.r, ' ', ''), replace(y.r, ' ', ''))), 6) as score
from r x join r y on x.a < y.a
where greatest(jaro_similarity(x.r, y.r), jaro_similarity(replace(x.r, ' ', ''), replace(y.r, ' ', ''))) >= 0.8""")
def near_names(spark, sf):
    return duplicates.name_pairs(World(spark, sf).part, "p_name", 0.8).withColumn("score", F.round("score", 6))


@query(f"with {_PLACES} select ancestor, descendant, depth from closure")
def tree_closure(spark, sf):
    return World(spark, sf).closure()


@query(f"with {_PLACES} select descendant as id, array_to_string(list(ancestor order by depth), '/') as chain from closure where depth > 0 group by descendant")
def ancestors(spark, sf):
    return trees.ancestors(World(spark, sf).closure()).select("id", F.array_join("ancestor_ids", "/").alias("chain"))


@query(f"with {_PLACES}, {_CLAIMS} select ancestor as place, count(distinct claim_id) as n from links join closure on place_id = descendant group by ancestor")
def subtree_rollup(spark, sf):
    w = World(spark, sf)
    return trees.subtree_rollup(w.links(), w.closure(), "claim_id", "place_id")


@query(f"""with {_PLACES}, {_CLAIMS} select * from claims where first_seen_at between timestamp '{_FROM}' and timestamp '{_TO}'
and claim_id in (select claim_id from links join closure on place_id = descendant where ancestor = 'R1')""")
def claims_in_scope(spark, sf):
    w = World(spark, sf)
    return beats.claims_in_scope(w.claims(), w.links(), w.closure(), "R1", _FROM, _TO)


_BEAT = f"""with {_PLACES}, {_CLAIMS}, inside as (select distinct claim_id, place_id from links join closure on place_id = descendant where ancestor = 'R1'),
anchored as (select claim_id, min(place_id) as anchor from inside group by claim_id),
placed as (select c.*, anchor from claims c join anchored a on c.claim_id = a.claim_id where first_seen_at between timestamp '{_FROM}' and timestamp '{_TO}'),
firsts as (select *, min(struct_pack(t := first_seen_at, c := claim_id)) over (partition by anchor) as f from placed),
beat as (select claim_id, person_id, first_seen_at, kind, support, anchor, row_number() over (order by f, anchor, first_seen_at, claim_id) as position from firsts)"""


def _beat(w: World) -> DataFrame:
    closure = w.closure()
    claims = beats.claims_in_scope(w.claims(), w.links(), closure, "R1", _FROM, _TO)
    return beats.beat_order(claims, w.links(), closure, "R1").withColumn("position", F.col("position").cast("long"))


@query(f"{_BEAT} select * from beat")
def beat_order(spark, sf):
    return _beat(World(spark, sf))


@query(f"{_BEAT} select b.claim_id, b.position, l.l_partkey as post_id, row_number() over (order by b.position, l.l_linenumber, l.l_partkey) as n, l.l_linenumber as ord from beat b join lineitem l on l.l_orderkey = b.claim_id")
def citation_numbers(spark, sf):
    w = World(spark, sf)
    cited = w.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("post_id"), F.col("l_linenumber").alias("ord"))
    return beats.citation_numbers(_beat(w), cited).withColumn("n", F.col("n").cast("long"))


@query(f"{_BEAT}, m as (select *, case when kind is not distinct from lag(kind) over (order by position) and position > 1 then 0 else 1 end as c from beat) select claim_id, (sum(c) over (order by position))::bigint as run from m")
def clause_runs(spark, sf):
    return beats.clause_runs(_beat(World(spark, sf)), [], "kind").select("claim_id", "run")


@query(f"with {_ANSWERS} select k as post, first(user_id order by ts, event_id) as user_id from answers group by k")
def first_appearance(spark, sf):
    a = World(spark, sf).answers().withColumnRenamed("k", "post")
    return acquisition.first_appearance(a, "post", "user_id", "ts", "event_id")


@query(f"""with {_ANSWERS}, f as (select k, first(user_id order by ts, event_id) as user_id from answers group by k)
select user_id, count(distinct k) as posts_found, (select count(*) from f where f.user_id = a.user_id) as posts_new from answers a group by user_id""")
def query_yield(spark, sf):
    a = World(spark, sf).answers()
    return acquisition.query_yield(a.select("user_id").distinct(), a, "k", "user_id", "ts", "event_id")


@query(f"with {_ANSWERS} select event_id, user_id, lead(ts) over w as superseded_at, lead(event_id) over w as superseded_by_id from answers window w as (partition by user_id order by ts, event_id)")
def supersession(spark, sf):
    a = World(spark, sf).answers()
    return history.supersession(a, ["user_id"], "ts", "event_id").select("event_id", "user_id", "superseded_at", "superseded_by_id")


@query(f"""with {_ANSWERS}, keyed as (select *, struct_pack(t := ts, i := event_id) as key from answers),
own as (select *, lead(key) over (partition by user_id, none, case when none then null else slot end order by ts, event_id) as nxt,
  min(case when none then key end) over aft as nn, min(case when not none then key end) over aft as nr
  from keyed window aft as (partition by user_id order by ts, event_id rows between 1 following and unbounded following)),
o as (select *, case when none then nr else nn end as other from own)
select event_id, least(nxt.t, other.t) as superseded_at, case when nxt is not null and (other is null or nxt < other) then nxt.i end as superseded_by_id from o""")
def exclusive_answers(spark, sf):
    a = World(spark, sf).answers()
    return history.exclusive_answers(a, ["user_id"], ["slot"], F.col("none"), "ts", "event_id").select("event_id", "superseded_at", "superseded_by_id")


@query(f"""with {_ANSWERS}, s as (select *, lead(ts) over (partition by user_id order by ts, event_id) as until from answers)
select event_id, user_id from s where ts <= timestamp '2024-01-15' and (until is null or until > timestamp '2024-01-15')""")
def state_as_of(spark, sf):
    log = history.supersession(World(spark, sf).answers(), ["user_id"], "ts", "event_id")
    return history.state_as_of(log, "ts", "2024-01-15").select("event_id", "user_id")


@query(f"with {_ANSWERS}, s as (select *, lead(ts) over (partition by user_id, slot order by ts, event_id) as until from answers) select event_id, user_id, slot from s where until is null")
def current_rows(spark, sf):
    log = history.supersession(World(spark, sf).answers(), ["user_id", "slot"], "ts", "event_id")
    return history.current_rows(log).select("event_id", "user_id", "slot")


@query(f"with {_ANSWERS} select k, event_id, ts from answers qualify row_number() over (partition by k order by ts, event_id) = 1")
def dedupe_first(spark, sf):
    return history.dedupe_first(World(spark, sf).answers(), ["k"], ["ts", "event_id"]).select("k", "event_id", "ts")


@query("select l_orderkey, l_suppkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey, l_suppkey order by l_shipdate desc, l_linenumber desc) = 1")
def upsert_last(spark, sf):
    return history.upsert_last(World(spark, sf).lineitem, ["l_orderkey", "l_suppkey"], ["l_shipdate", "l_linenumber"]).select("l_orderkey", "l_suppkey", "l_linenumber")


@query(f"""with {_ANSWERS}, sets as (select distinct user_id, date_trunc('day', ts) as "at", slot from answers),
o as (select user_id, "at", lead("at") over (partition by user_id order by "at") as nxt from (select distinct user_id, "at" from sets))
select s.user_id, s."at", s.slot, o.nxt as superseded_at, a."at" as superseded_by_set from sets s join o on s.user_id = o.user_id and s."at" = o."at"
left join sets a on a.user_id = s.user_id and a."at" = o.nxt and a.slot = s.slot""")
def set_replacement(spark, sf):
    a = World(spark, sf).answers().select("user_id", F.date_trunc("day", "ts").alias("at"), "slot").withColumn("set_id", F.col("at"))
    return history.set_replacement(a, ["user_id"], "slot", "at", "set_id").select("user_id", "at", "slot", "superseded_at", "superseded_by_set")


@query(f"""with {_CLAIMS} select kind, count(*) filter (support = 'unverified') as unverified, count(*) filter (support = 'supported') as supported,
count(*) filter (support = 'overstated') as overstated, count(*) filter (support = 'unsupported') as unsupported from claims group by kind""")
def support_tally(spark, sf):
    return report.support_tally(World(spark, sf).claims(), ["kind"])


@query(f"""with {_CLAIMS} select kind, count(*) filter (support <> 'unverified') as judged, count(*) filter (support in ('overstated', 'unsupported')) as flagged,
round(count(*) filter (support in ('overstated', 'unsupported')) * 100 / nullif(count(*) filter (support <> 'unverified'), 0)::double, 1) as flag_rate from claims group by kind""")
def flag_rate(spark, sf):
    return report.flag_rate(World(spark, sf).claims(), ["kind"])


@query(f"""with {_CLAIMS} select c.claim_id, coalesce(p, '') as places, coalesce(q, '') as posts from claims c
left join (select claim_id, string_agg(distinct place_id, ',' order by place_id) as p from links group by 1) a on a.claim_id = c.claim_id
left join (select l_orderkey, string_agg(distinct l_partkey::varchar, ',' order by l_partkey::varchar) as q from lineitem group by 1) b on b.l_orderkey = c.claim_id""")
def claim_detail(spark, sf):
    w = World(spark, sf)
    sides = {"places": w.links().withColumnRenamed("place_id", "item"), "posts": w.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").cast("string").alias("item"))}
    return report.claim_detail(w.claims(), sides).select("claim_id", F.array_join("places", ",").alias("places"), F.array_join("posts", ",").alias("posts"))


@query(f"with {_CLAIMS} select c_custkey, claim_id, first_seen_at from customer join claims on c_custkey = person_id")
def person_arc(spark, sf):
    w = World(spark, sf)
    return w.customer.select("c_custkey").join(w.claims(), F.col("c_custkey") == F.col("person_id")).select("c_custkey", "claim_id", "first_seen_at")


@query(f"with {_CLAIMS} select kind, claim_id, greatest(count(*) over (partition by kind) - 3, 0)::bigint as rest from claims qualify row_number() over (partition by kind order by first_seen_at, claim_id) <= 3")
def bounded_sample(spark, sf):
    return report.bounded_sample(World(spark, sf).claims(), ["kind"], ["first_seen_at", "claim_id"], 3).select("kind", "claim_id", "rest")


@query(f"with {_CLAIMS} select support, claim_id from claims qualify row_number() over (partition by support order by claim_id) <= 5")
def stratified_sample(spark, sf):
    return report.stratified_sample(World(spark, sf).claims(), "support", "claim_id", 5).select("support", "claim_id")


@query("""with once as (select source, doc_id from documents qualify row_number() over (partition by source, text order by doc_id) = 1)
select source, doc_id from once qualify (row_number() over (partition by source order by doc_id) - 1) % 10 = 0""")
def systematic_sample(spark, sf):
    return report.systematic_sample(World(spark, sf).documents.select("source", "doc_id", "text"), "source", "text", ["doc_id"], 10).select("source", "doc_id")


@query("select source, doc_id, ((row_number() over (partition by source order by doc_id) - 1) // 25)::bigint as batch from documents")
def batches(spark, sf):
    return report.batches(World(spark, sf).documents.select("source", "doc_id"), ["source"], ["doc_id"], 25).select("source", "doc_id", "batch")


@query("select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as prompt from conversations group by conv_id")
def render_prompts(spark, sf):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x.t)
    return World(spark, sf).conversations.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("prompt"))


@query(f"with {_ANSWERS} select date_trunc('hour', ts) as start, count(*) as n from answers group by 1")
def density(spark, sf):
    return fitness.density(World(spark, sf).answers(), "ts")


@query(f"with {_ANSWERS}, s as (select slot, count(*) as n from answers group by slot) select slot, n, n / sum(n) over () as share, n > 3 * median(n) over () as overloaded from s")
def theme_load(spark, sf):
    return fitness.theme_load(World(spark, sf).answers(), "slot")


@query(f"with {_CLAIMS} select kind, avg(case when support in ('overstated', 'unsupported') then 1.0::double else 0.0::double end) as refused from claims group by kind")
def refusal_rate(spark, sf):
    return fitness.refusal_rate(World(spark, sf).claims(), "kind", "support")


@query(f"""with {_ANSWERS}, once as (select distinct user_id, slot from answers), n as (select slot, count(*) as n from once group by slot),
b as (select x.slot as a, y.slot as b, count(*) as both from once x join once y on x.user_id = y.user_id and x.slot < y.slot group by 1, 2)
select a, b, "both", "both" / (na.n + nb.n - "both") as jaccard from b join n na on na.slot = a join n nb on nb.slot = b""")
def theme_confusion(spark, sf):
    return fitness.theme_confusion(World(spark, sf).answers(), "user_id", "slot")


@query("""with s as (select p_brand, p_type, count(*) as n from part group by 1, 2)
select p_brand, p_type, n, n / sum(n) over (partition by p_brand) as share, count(*) over (partition by p_brand) = 1 as single_child from s""")
def sibling_imbalance(spark, sf):
    return fitness.sibling_imbalance(World(spark, sf).part, "p_brand", "p_type")


@query(f"""with {_ANSWERS}, s as (select date_trunc('week', ts)::timestamp as week, slot, count(*) as n from answers group by 1, 2),
h as (select week, slot, n, n / sum(n) over (partition by week) as share from s)
select week, slot, n, share, lag(share) over w as before, lag(share) over w is null as arrived from h window w as (partition by slot order by week)""")
def theme_drift(spark, sf):
    return fitness.theme_drift(World(spark, sf).answers(), "slot", "ts")


@query(f"""with {_ANSWERS}, s as (select k, count(*) as n, max((ts < timestamp '2024-01-16')::int) as f, max((ts >= timestamp '2024-01-16')::int) as g from answers group by k)
select count(*) as distinct_items, sum(n)::bigint as sightings, count(*) filter (n = 1) as singletons, count(*) filter (n = 1) / sum(n) as unseen_mass,
(sum(f) + 1) * (sum(g) + 1) / (sum(f * g) + 1) - 1 as estimated_items from s""")
def richness(spark, sf):
    return fitness.richness(World(spark, sf).answers(), "k", F.col("ts") < F.lit("2024-01-16").cast("timestamp"))


@query(f"""with {_ANSWERS}, f as (select k, min(ts) as t from answers group by k), d as (select date_trunc('day', t)::timestamp as start, count(*) as n from f group by 1)
select start, n as "new", (sum(n) over (order by start))::bigint as cumulative from d""")
def saturation(spark, sf):
    return fitness.saturation(World(spark, sf).answers(), "k", "ts")


@query("""with c as (select lang, source, count(*) as n from documents group by 1, 2), t as (select
  (select sum(n * (n - 1) / 2) from c) as "both", (select sum(n) from c) as m,
  (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by lang)) as ta, (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by source)) as tb),
p as (select m * (m - 1) / 2 as pairs, m * (m - 1) / 2 + 2 * "both" - ta - tb as agree, ta / (m * (m - 1) / 2) as p, tb / (m * (m - 1) / 2) as q from t)
select pairs, agree, agree / pairs as rate, (agree / pairs - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) as beyond_chance from p""")
def reader_agreement(spark, sf):
    return fitness.reader_agreement(World(spark, sf).documents, "lang", "source")


@query(f"""with {_ANSWERS}, s as (select user_id, date_trunc('hour', min(ts)) as a, date_trunc('hour', max(ts)) as b from answers group by user_id)
select user_id, a + to_seconds(i * 21600) as slice_start, a + to_seconds((i + 1) * 21600) as slice_end
from (select *, unnest(range(0, (ceil(epoch(b - a) / 21600))::bigint)) as i from s)""")
def tile(spark, sf):
    a = World(spark, sf).answers().groupBy("user_id").agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b"))
    return acquisition.tile(a.withColumn("secs", F.lit(21600)), "a", "b", "secs", F.current_timestamp()).select("user_id", "slice_start", "slice_end")


@query(f"""with {_ANSWERS}, s as (select distinct user_id, date_trunc('hour', ts) as a, date_trunc('hour', ts) + interval 1 hour as b from answers),
g as (select *, greatest(epoch(a) - epoch(lag(b) over (partition by user_id order by a)), 0) as gap from s)
select user_id, count(*) as slices, sum(3600)::bigint as covered_seconds, (count(*) filter (gap > 0))::bigint as gaps, coalesce(sum(gap), 0)::bigint as gap_seconds from g group by user_id""")
def coverage(spark, sf):
    h = F.date_trunc("hour", "ts")
    slices = World(spark, sf).answers().select("user_id", h.alias("slice_start"), (h + F.expr("interval 1 hour")).alias("slice_end"))
    return acquisition.coverage(slices, ["user_id"])


@query(r"""with k as (select doc_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')), 'https?://\S+|www\.\S+|[@#][\p{L}\p{N}_]+', ' ', 'g'), '\s+', ' ', 'g')) as t from documents)
select doc_id as id, case when t <> '' then min(doc_id) over (partition by t) else doc_id end as first_id, case when t <> '' then count(*) over (partition by t) else 1 end as copies from k""")
def exact_posts(spark, sf):
    return duplicates.exact_posts(World(spark, sf).documents, "doc_id", "text")
