"""The dealt operators as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import centroids, decontaminate, html_text, licenses, line_dedup, mixing, multiset_hash, periodic_runs, pii, quality, sign_hash, simhash, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, expected: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if expected is not None:
            ORACLES[name] = expected
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The deleted lines, spelled out: every shortest window of at least eight words (or ten code points each) that starts or ends at a line, as a string;
# all but the first place of equal windows go. The operator ranks line ids instead and never builds the strings.
LINE_DEDUP_SQL = r"""
with ln as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
w as (
  select *, sum(words) over (partition by doc_id order by pos) as upto from (
    select *, greatest(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), length(line) // 10) as words from ln)),
win as (
  select a.doc_id, a.pos as s, min(b.pos) as e from w a join w b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto >= a.upto - a.words + 8 group by all
  union
  select b.doc_id, max(a.pos) as s, b.pos as e from w a join w b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto >= a.upto - a.words + 8 group by all),
keyed as (
  select win.doc_id, s, e, string_agg(line, chr(10) order by pos) as body from win join w on w.doc_id = win.doc_id and pos between s and e group by all),
later as (select * from (select *, row_number() over (partition by body order by doc_id, s) as nth from keyed) where nth > 1),
gone as (select distinct w.doc_id, w.pos from w join later on later.doc_id = w.doc_id and w.pos between s and e)
select d.doc_id, count(*) as n_lines, count(gone.pos) as n_deleted,
  coalesce(string_agg(ln.line, chr(10) order by ln.pos) filter (gone.pos is null), '') as text
from documents d join ln on ln.doc_id = d.doc_id left join gone on gone.doc_id = ln.doc_id and gone.pos = ln.pos
group by d.doc_id
"""


@query("op1_line_dedup", LINE_DEDUP_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint"))
    deleted = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint>>")), F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return line_dedup.dedup_lines(docs, min_words=8).select("doc_id", "n_lines", deleted.alias("n_deleted"), "text")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), cycle=3, most=3).drop("copies")


@query("op6_multiset_hash")
def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edit_report(table(spark, sf_dir, "documents"))


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


WARC_SQL = """
with digits as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, max(page_id) over (partition by coalesce(html, '')) as last,
    list_transform(range(8), lambda i: cast('0x' || substr(sha1(coalesce(html, '')), 5 * i + 1, 5) as bigint)) as groups
  from pages)
select page_id, payload_bytes,
  list_aggregate(list_transform(groups, lambda g: list_aggregate(
    list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((g >> s) & 31) + 1 as bigint), 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to
from digits
"""


@query("op7_warc", WARC_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=0.7)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), tail=True)


def centroid_sql(clusters: int, rounds: int, length: int, scale: int, seed: str) -> str:
    """Every distance measured, and a centroid's components as rows; no rotation and no bounds."""
    blocks = [f"""
v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {length} and len(embedding) = {length}),
c0 as (select cast(row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as int) as c, v as m from v
  where r in (select r from v order by sha256('{seed}:' || vec_id) nulls last, v limit {clusters}))"""]
    for i in range(rounds + 1):
        blocks.append(f"""
a{i} as materialized (
  select r, arg_min(c, (d, c)) as c, min(d) as d from (
    select r, c, list_sum(list_transform(range(1, {length} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint as d from v, c{i}) group by r)""")
        if i < rounds:
            blocks.append(f"""
c{i + 1} as materialized (
  select c{i}.c, coalesce(moved.m, c{i}.m) as m from c{i} left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as m from (
      select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from v join a{i} using (r)) group by c, i)
    group by c) moved on moved.c = c{i}.c)""")
    return f"""with {",".join(blocks)}
select vec_id, c as cluster, d as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(m, ',')) as centroid_sha256
from v join a{rounds} using (r) join c{rounds} using (c)
"""


@query("op12_centroids", centroid_sql(clusters=16, rounds=3, length=64, scale=64, seed="1"))
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=16, rounds=3, length=64, scale=64, seed="1", lead=16)


NEAR_VECTORS_SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v
  from embeddings where label is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked as materialized (
  select a.r, a.vec_id as a, b.vec_id as b, b.r as other from v a join v b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select r, r as to from v where r in (select r from linked) union select reach.r, other from reach join linked on linked.r = reach.to),
least as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.to group by reach.r),
counted as (select r, count(*) as n from linked group by r),
every as (
  select e.vec_id, coalesce(n, 0) as n_links, coalesce(component_id, e.vec_id) as component_id
  from v e left join counted using (r) left join least using (r)
  union all
  select vec_id, 0, vec_id from embeddings where not (label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0))
select vec_id, n_links, component_id, vec_id is not distinct from component_id as kept from every
"""


@query("op11_near_vectors", NEAR_VECTORS_SQL)
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_hash.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)
