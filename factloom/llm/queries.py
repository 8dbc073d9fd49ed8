"""The operators applied to whole tables with production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm import decontaminate, mixing, ngram_join, passages, pii, pivots, quality, secrets, toxicity, trie, vectors, warc, whitening
from factloom.llm.store import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_pii(spark, folder):
    return pii.digest(pii.find(documents(spark, folder)))


@query()
def op2_quality(spark, folder):
    docs = documents(spark, folder)
    held = quality.held_out()
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), held_out=held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"), "difference")


@query()
def op3_mixing(spark, folder):
    return mixing.mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("""
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(octet_length(encode(body)) as bigint) as payload_bytes, sha1(body) as payload_digest from p),
g as (select *, max(page_id) over (partition by payload_digest) as holder from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < holder then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < holder then holder end as refers_to
from g""")
def op4_warc(spark, folder):
    return warc.round_trip(spark.read.parquet(f"{folder}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("""
with recursive u as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null),
n as (select vec_id, v from u where list_dot_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach(a, b) as (select vec_id, vec_id from u union select r.a, l.b from reach r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, coalesce((select min(b) from reach r where r.a = e.vec_id), e.vec_id) as component_id,
  coalesce((select min(b) from reach r where r.a = e.vec_id), e.vec_id) = e.vec_id as kept
from embeddings e""")
def op5_vectors(spark, folder):
    return vectors.join(spark.read.parquet(f"{folder}/embeddings.parquet"))


# A-Z and a-z, as only these are lowered.
@query("""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, len(g) as n from s),
p as (select doc_id, unnest(g) as g from s),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from p x join p y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join l on r.b = l.a),
least as (select a, min(b) as m from reach group by a),
rep as (select doc_id, case when len(g) = 0 then doc_id else min(doc_id) over (partition by list_sort(g)) end as representative from s)
select n.doc_id, cast(n.n as bigint) as n_shingles, least.m as component_id, rep.representative
from n join least on least.a = n.doc_id join rep on rep.doc_id = n.doc_id""")
def op6_ngram_join(spark, folder):
    return ngram_join.join(documents(spark, folder))


@query()
def op7_secrets(spark, folder):
    return secrets.digest(secrets.find(documents(spark, folder)))


@query()
def op8_passages(spark, folder):
    return passages.find(documents(spark, folder))


@query()
def op9_toxicity(spark, folder):
    docs = documents(spark, folder)
    held = toxicity.held_out()
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), held_out=held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                                              "bits", "passages")


@query()
def op10_decontaminate(spark, folder):
    return decontaminate.find(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("""
with u as (select vec_id, embedding as e from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
v as (select vec_id, row_number() over () as r, list_transform(e, lambda c: floor(256 * cast(c as double))) as x from u),
s as (select q.vec_id as query_id, q.r as query_row, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score from v q join v c on q.r <> c.r and len(q.x) = len(c.x)
  where q.vec_id % 50 = 0),
o as (select *, row_number() over (partition by query_row order by score desc, vec_id nulls last) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from o where n <= 5""")
def op11_pivots(spark, folder):
    return pivots.search(spark.read.parquet(f"{folder}/embeddings.parquet"))


# The reflected polynomial of the checksum and its start.
@query("""
with t as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
o as (select c, list({'r': r, 'x': x} order by turn nulls first, r, x) as p from t group by c),
h as (select c, p, xor(list_reduce(flatten([[4294967295], flatten(list_transform(string_split(cast(c as varchar), ''), lambda d: flatten([[cast(ascii(d) as bigint)], [-1, -1, -1, -1, -1, -1, -1, -1]])))]),
    lambda s, b: case when b >= 0 then xor(s, b) when s % 2 = 1 then xor(s >> 1, 3988292384) else s >> 1 end), 4294967295) % 6 as h from o),
b as (select h.c, list_concat(coalesce(a.p[1:h.h], []), h.p[h.h + 1:]) as p from h left join o a on a.c = h.c - h.c % 100),
m as (select c, p, unnest(range(0, len(p) + 1)) as d from b),
n as (select p[1:d] as k, d, min(c) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(case when len(p) = d then cast(c as varchar) end, ',' order by c), '')) as ends_sha256 from m group by 1, 2),
w as (select *, case when d = 0 then 0 else length(k[d].x) end as l from n),
z as (select k, d, conv_id, n_convs, l, ends_sha256, (select count(*) from n j where j.d = w.d + 1 and j.k[1:w.d] = w.k) as n_children from w),
e as (select a.k, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.l) as saved from z a join z b on b.d >= a.d and b.k[1:a.d] = a.k group by a.k)
select z.conv_id, cast(z.d as bigint) as depth, p.conv_id as parent_conv_id, cast(z.n_convs as bigint) as n_convs, cast(z.n_children as bigint) as n_children, cast(e.n_leaves as bigint) as n_leaves,
  cast(e.saved as bigint) as saved_tokens, z.ends_sha256
from z join e on e.k = z.k left join n p on p.d = z.d - 1 and p.k = z.k[1:z.d - 1]""")
def op12_trie(spark, folder):
    return trie.build(spark.read.parquet(f"{folder}/conversations.parquet"), shared_heads=True)


@query()
def op13_whitening(spark, folder):
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
