"""The ten operators as registered queries over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from testimony.llm import decontamination, embeddings, licences, minhash, mixing, phrases, quality, ranking, search, sharding, substrings, urls, warc
from testimony.llm.common import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("text_key")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return judged.select("doc_id", "n_shingles", "component_id", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("n_candidates")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_lines", F.round("best", 6).alias("best"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_products(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_substring_dedup, op3_embedding_dedup, op4_warc, op5_sharding, op6_quality, op7_minhash, op8_url_filter, op9_decontamination, op10_licences, op11_ranked_search, op12_collocations, op13_top_products)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
grams as (
  select doc_id, p, array_to_string(ws[p:p + 19], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as p from w where len(ws) >= 20)
),
late as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) as k from grams) where k > 1),
gone as (select distinct doc_id, p + d as q from (select doc_id, p, unnest(range(0, 20)) as d from late)),
flat as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as q from w),
kept as (
  select f.doc_id, count(*) as n, string_agg(word, ' ' order by f.q) as t
  from flat f left join gone g on f.doc_id = g.doc_id and f.q = g.q where g.q is null group by f.doc_id
)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept k on w.doc_id = k.doc_id
"""

_OP3 = """
with v as (select vec_id, embedding::double[] as e from embeddings),
ok as (
  select vec_id, e from v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0
),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (
  with recursive r(a, c) as (select vec_id, vec_id from v union select l.b, r.c from r join links l on l.a = r.a) select a, min(c) as c from r group by a
)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, c as component_id, vec_id = c as kept from v join reach on a = vec_id
"""

_OP4 = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
b as (
  select page_id, h, strlen(html)::bigint as payload_bytes, max(page_id) over (partition by h, strlen(html)) as top,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from b
"""

_OP7 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[p:p + least(len(ws), 2) - 1], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) as p from w where len(ws) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
ways as (select a, b from links union all select b, a from links),
reach(a, c) as (select doc_id, doc_id from w union select l.b, r.c from reach r join ways l on l.a = r.a),
least as (select a, min(c) as c from reach group by a)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id, w.doc_id = c as kept from w left join n on n.doc_id = w.doc_id join least on a = w.doc_id
"""

_OP8 = rf"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
),
hp as (
  select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
),
rules(rule, rhost, rpath, verdict) as (values {", ".join(f"({_quoted(r)}, {_quoted(r.partition('/')[0])}, {_quoted('/' + r.partition('/')[2])}, {_quoted(v)})" for v, r in URL_RULES)}),
fit as (
  select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule) desc, rule desc) as k
  from hp join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select hp.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from hp left join fit on hp.page_id = fit.page_id and k = 1
"""

_OP9 = rf"""
with words(id, ws, kind) as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 'd' from documents
  union all
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 'i' from benchmark
),
wins as (
  select distinct id, least(len(ws), 10) as n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') as g
  from (select id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as p from words where kind = 'i' and len(ws) > 0)
),
grams as (
  select d.id, d.p, d.n, array_to_string(d.ws[d.p:d.p + d.n - 1], ' ') as g
  from (select id, ws, n, unnest(range(1, len(ws) - n + 2)) as p from words, (select distinct n from wins) where kind = 'd' and len(ws) >= n) d
),
hits as (select g.id, g.p, g.n, w.id as item from grams g join wins w on g.n = w.n and g.g = w.g),
covered as (select id, count(distinct q) as n_hit from (select id, unnest(range(p, p + n)) as q from hits) group by id),
named as (select id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct id, item::varchar as item from hits) group by id)
select w.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words w left join covered c on w.id = c.id left join named m on w.id = m.id where w.kind = 'd'
"""


_OP11 = rf"""
with words(id, ws, kind) as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), 'd' from documents
  union all
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), 'i' from benchmark
),
wanted as (select distinct id as item, unnest(ws) as term from words where kind = 'i'),
docs as (select row_number() over () as k, id, ws, len(ws)::bigint as n from words where kind = 'd' and len(ws) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as length from docs),
tfs as (
  select k, term, count(*)::bigint as tf from (select k, unnest(ws) as term from docs) where term in (select term from wanted) group by k, term
),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tfs, total group by term, docs),
measured as (select k, id, 10 + (90 * n * docs) // length as m from docs, total),
scores as (
  select item, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from wanted join tfs using (term) join weights using (term) join measured using (k) group by item, k
),
ranked as (
  select item, id, score, row_number() over (partition by item order by score desc, id) as r from scores join measured using (k) where score > 0
)
select item as item_id, r::int as rank, id as doc_id, score from ranked where r <= 10
"""


_OP12 = rf"""
with pieces as (
  select lang, k, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws
  from (
    select coalesce(lang, 'und') as lang, row_number() over () as k, piece
    from (select lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents)
  )
),
total as (select lang, sum(len(ws))::bigint as n from pieces group by lang),
counts as (
  select lang, size, words, count(*)::bigint as f
  from (
    select lang, size, ws[p:p + size - 1] as words
    from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as p from pieces, (select unnest([1, 2, 3, 4]) as size) where len(ws) >= size)
  )
  group by lang, size, words
),
cands as (select * from counts where size > 1 and f >= 30),
around as (
  select lang, words, max(f) as most
  from (select lang, words[1:size - 1] as words, f from cands where size > 2 union all select lang, words[2:size] as words, f from cands where size > 2
        union all select lang, words[2:3] as words, f from cands where size = 4 union all select lang, words[1:2] as words, f from cands where size = 4
        union all select lang, words[3:4] as words, f from cands where size = 4)
  group by lang, words
),
kept as (select c.lang, c.size, c.words, c.f as a from cands c left join around o on c.lang = o.lang and c.words = o.words where most is null or 100::hugeint * most < 80::hugeint * c.f),
cuts as (
  select k.lang, k.words, a, k, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f + y.f))::bigint as score
  from (select *, unnest(range(1, size)) as k from kept) k
  join counts x on x.lang = k.lang and x.words = k.words[1:k.k]
  join counts y on y.lang = k.lang and y.words = k.words[k.k + 1:k.size]
),
best as (select lang, words, a, l, r, score from (select *, row_number() over (partition by lang, words order by score, k) as i from cuts) where i = 1),
ranked as (
  select lang, array_to_string(words, ' ') as phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(words, ' ')) as rank
  from best
)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""

_OP13 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings),
ok as (select vec_id, e from v where e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from ok q join ok c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
)
select query_id, r::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scores) where r <= 5
"""


def _op10() -> str:
    gram = r"list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    split = rf"regexp_extract_all({_LOWER.format('line')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with t as (select name, {gram} as g from (select name, {split} as ws from (values {", ".join(f"({_quoted(n)}, {_quoted(x)})" for n, x in licences.TEMPLATES)}) v(name, line))),
lines as (select doc_id, unnest(range(1, 1 + len(string_split(text, chr(10))))) as k, unnest(string_split(text, chr(10))) as line from documents),
l as (select doc_id, k, {gram} as g from (select doc_id, k, {split} as ws from lines) where len(ws) > 1),
m as (
  select doc_id, k, name, 2.0::double * len(list_intersect(l.g, t.g)) / (len(l.g) + len(t.g)) as dice
  from l join t on list_has_any(l.g, t.g) where 2.0::double * len(list_intersect(l.g, t.g)) / (len(l.g) + len(t.g)) >= 0.8
),
s as (select doc_id, string_agg(distinct name, ',' order by name) as licences, count(distinct k) as n_lines, max(dice) as best from m group by doc_id)
select d.doc_id, coalesce(licences, '') as licences, coalesce(n_lines, 0)::bigint as n_lines, round(best, 6) as best
from documents d left join s on d.doc_id = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express. The mix and the shards depend on hashes and on a packing
    order, the classifier on a fitted model: tests hold them to brute force."""
    return {
        "op2_substring_dedup": _OP2,
        "op3_embedding_dedup": _OP3,
        "op4_warc": _OP4,
        "op7_minhash": _OP7,
        "op8_url_filter": _OP8,
        "op9_decontamination": _OP9,
        "op10_licences": _op10(),
        "op11_ranked_search": _OP11,
        "op12_collocations": _OP12,
        "op13_top_products": _OP13,
    }
