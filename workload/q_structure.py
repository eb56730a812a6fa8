"""Sources, page structure and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import scoring as S
from pagegauge.functions import text as T
from pagegauge.operators import agent_signals, elements as E, structure
from pagegauge.plans import grading
from workload.ctes import inlist, jaccard, linear_sql, snip, trim
from workload.registry import query


@query(
    "src_captures",
    "select page_id, url, final_url, raw_html, rendered_html, ttfb, page_size, num_requests, dom_content_loaded, network_idle from caps",
)
def src_captures(t):
    return t.captures().select("page_id", "url", "final_url", "raw_html", "rendered_html", "perf.*")


@query(
    "src_page_title",
    f"""select p.page_id, nullif({trim("t.txt")}, '') as page_title from caps p left join
        (select page_id, min_by(txt, pos) as txt from raw_txt where tag = 'title' and kind = 'rawtext' group by page_id) t using (page_id)""",
)
def src_page_title(t):
    return grading.raw_titles(t.captures())


@query("src_site_files", "select page_id, c.origin, robots, llms, sitemap from caps c left join sites s on s.origin = c.origin")
def src_site_files(t):
    captures = t.captures()
    pages = captures.select("page_id", "final_url")
    return grading.with_site(pages, captures, agent_signals.site_table(t.site_files())).drop("final_url")


@query("dom_tokens", "select page_id, cast(pos as int) as pos, kind, tag, tok from tok")
def dom_tokens(t):
    return structure.tokens(t.captures())


@query(
    "dom_elements",
    """select e.page_id, cast(e.pos as int) as pos, e.tag, cast(e.level as int) as level,
        cast(e.parent as int) as parent, cast(coalesce(e.close_pos, n.n) as int) as close_pos
       from els e join (select page_id, max(pos) + 1 as n from tok group by page_id) n using (page_id)""",
)
def dom_elements(t):
    return structure.elements(t.captures()).select("page_id", "pos", "tag", "level", "parent", "close_pos")


@query("dom_attrs", "select page_id, cast(pos as int) as pos, tag, name, value from attrs")
def dom_attrs(t):
    return structure.attributes(t.captures())


@query("dom_text_nodes", "select page_id, cast(pos as int) as pos, node from txt where node is not null")
def dom_text_nodes(t):
    return structure.text_nodes(t.captures())


@query("dom_visible_text", "select page_id, txt as visible_text from vis")
def dom_visible_text(t):
    return structure.visible_text(t.captures())


@query(
    "dom_element_text",
    f"select page_id, cast(pos as int) as pos, tag, txt from eltext where tag in {inlist(structure.CHECKED_TAGS)}",
)
def dom_element_text(t):
    docs = structure.page_documents(t.captures())
    listed = F.transform(
        E.where(E.tag_in(*structure.CHECKED_TAGS)),
        lambda e: F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), E.text_of(e).alias("txt")),
    )
    return docs.select("page_id", F.inline(listed))


COUNTED = (*C.SEMANTIC_TAGS, "div", "p", "a")


@query(
    "dom_tag_counts",
    "select page_id, " + ", ".join(f"cast(count(*) filter (tag = '{x}') as int) as n_{x}" for x in COUNTED) + " from els group by page_id",
)
def dom_tag_counts(t):
    return structure.tag_counts(t.captures(), COUNTED)


@query(
    "fn_snippet",
    f"""select d.doc_id, {snip('d.text')} as short, {snip('d.text', 60)} as shorter,
        coalesce({snip("cast(case when l.doc_id is not null then to_json({'doc_id': l.doc_id, 'quality': l.quality, 'toxic': l.toxic}) end as varchar)", 30)}, '') as label_json
       from documents d left join labels l on l.doc_id = d.doc_id""",
)
def fn_snippet(t):
    labels = t.read("labels").select(
        "doc_id", T.snippet_json(F.struct("doc_id", "quality", "toxic"), 30).alias("label_json")
    )
    return t.read("documents").join(labels, "doc_id", "left").select(
        "doc_id", T.snippet(F.col("text")).alias("short"), T.snippet(F.col("text"), 60).alias("shorter"),
        F.coalesce("label_json", F.lit("")).alias("label_json"),
    )


@query(
    "fn_linear_score",
    f"""select l_orderkey, l_linenumber, {linear_sql('l_extendedprice', 5000, 60000, 30)} as low_is_good,
        case when l_quantity >= 40 then 25 when l_quantity <= 5 then 0 else cast(floor((cast(l_quantity as double) - 5e0) / (40e0 - 5e0) * 25e0 + 5e-1) as int) end as high_is_good,
        case when l_quantity <= 20 then 10 else 0 end as one_bound
       from lineitem""",
)
def fn_linear_score(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber",
        S.linear_score(F.col("l_extendedprice"), 5000, 60000, 30).alias("low_is_good"),
        S.linear_score(F.col("l_quantity"), 40, 5, 25).alias("high_is_good"),
        S.linear_score(F.col("l_quantity"), 20, 20, 10).alias("one_bound"),
    )


@query(
    "fn_clamp_score",
    """select event_id, case when event_id % 97 = 0 or event_id % 89 = 0 or event_id % 83 = 0 then 0
         else cast(least(100, greatest(0, floor(value * 7e0 - 2e1 + 5e-1))) as int) end as score from events""",
)
def fn_clamp_score(t):
    raw = (
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 89 == 0, F.lit(float("inf")))
        .when(F.col("event_id") % 83 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("value") * 7.0 - 20.0)
    )
    return t.read("events").select("event_id", S.clamp_score(raw).alias("score"))


@query(
    "fn_jaccard_words",
    f"""select a.doc_id, round({jaccard('a.text', 'b.text', '1e0', '0e0')}, 9) as schema_overlap,
        round({jaccard('a.text', 'b.text', '0e0', '0e0')}, 9) as clarity_overlap
       from documents a join documents b on b.doc_id = a.doc_id + 1""",
)
def fn_jaccard_words(t):
    a = t.read("documents").select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    both = a.join(b, "doc_id")
    return both.select(
        "doc_id",
        F.round(T.jaccard_schema(F.col("text"), F.col("next_text")), 9).alias("schema_overlap"),
        F.round(T.jaccard_clarity(F.col("text"), F.col("next_text")), 9).alias("clarity_overlap"),
    )
