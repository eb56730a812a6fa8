"""Scores, findings, evidence, reports and the narrative exchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators.rules import FINDING_TYPE
from pagegauge.plans import grading, reports as R, statistics
from pagegauge.plans.dimensions import REGISTRY
from pagegauge.session import shared_dir
from pagegauge.sources import reports as store
from workload.ctes import CTES, lit, trim
from workload.registry import query

_SCORES = [d.score for d in REGISTRY]
_INT = lambda c: f"cast({c} as int) as {c}"


def graded(t):
    return grading.graded_pages(t.captures(), t.site_files())


def kept_statistics(t):
    """Facts of all pages by day, and the partials of those days."""
    facts, partials = shared_dir(t.spark, "page-facts"), shared_dir(t.spark, "day-partials")
    statistics.write_facts(statistics.page_facts(t.captures(), t.site_files()), facts)
    statistics.update(t.spark, facts, partials)
    return partials


def built(t):
    return R.build_reports(t.captures(), t.site_files())


@query("score_overall", f"select page_id, {', '.join(map(_INT, _SCORES))}, overall_score from graded")
def score_overall(t):
    return graded(t).select("page_id", *_SCORES, "overall_score")


@query("score_grade", "select page_id, overall_score, grade from graded")
def score_grade(t):
    return graded(t).select("page_id", "overall_score", "grade")


_FIND = "page_id, dimension, cast(ord as int) as ord, id, severity, title, description, coalesce(evidence, '') as evidence"


@query("findings_long", f"select {_FIND} from finds")
def findings_long(t):
    return R.findings_long(graded(t)).withColumn("evidence", F.coalesce("evidence", F.lit("")))


@query(
    "findings_flat",
    "select page_id, count(*) as n, string_agg(concat(id, ':', severity), '|' order by dim_ord, ord) as ids from finds group by page_id",
)
def findings_flat(t):
    rows = R.with_findings(graded(t))
    ids = F.transform("findings", lambda f: F.concat(f["id"], F.lit(":"), f["severity"]))
    return rows.select("page_id", F.size("findings").cast("bigint").alias("n"), F.array_join(ids, "|").alias("ids"))


CTES["tops"] = """select page_id, dim_ord, ord, id, severity, title, row_number() over (partition by page_id order by dim_ord, ord) as rank
  from finds where severity in ('high', 'medium') qualify rank <= 8"""


@query("findings_top", "select page_id, cast(rank as int) as rank, id, severity, title from tops")
def findings_top(t):
    rows = R.with_findings(graded(t)).select("page_id", F.posexplode(R.top_findings(F.col("findings"))).alias("i", "f"))
    return rows.select("page_id", (F.col("i") + 1).alias("rank"), "f.id", "f.severity", "f.title")


@query(
    "findings_count",
    "select p.page_id, "
    + ", ".join(f"cast(count(*) filter (dimension = '{d.name}') as int) as n_{d.prefix}" for d in REGISTRY)
    + ", cast(count(f.id) as int) as n_total from caps p left join finds f on f.page_id = p.page_id group by p.page_id",
)
def findings_count(t):
    return R.finding_counts(graded(t))


@query("findings_frequency", "select dimension, id, severity, count(distinct page_id) as pages from finds group by dimension, id, severity")
def findings_frequency(t):
    return statistics.finding_frequency(t.spark, kept_statistics(t))


_GRADE_COUNTS = ", ".join(f"count(*) filter (grade = '{g}') as grade_{g.lower()}" for g in C.GRADES)


@query(
    "score_summary",
    f"""select coalesce(origin, '(all)') as origin, count(*) as pages, round(avg(overall_score), 6) as mean_score, {_GRADE_COUNTS}
        from graded group by rollup (origin)""",
)
def score_summary(t):
    summary = statistics.score_summary(t.spark, kept_statistics(t))
    return summary.withColumns(
        {"origin": F.coalesce("origin", F.lit("(all)")), "mean_score": F.round("mean_score", 6)}
    ).drop("is_total")


# Stored findings that carry a recommendation, as seeded reports do: every finding but the merely informative.
_RECOMMENDED = """select page_id, dim_ord, ord, severity as priority, dimension as category, concat('Fix ', id) as title, description
  from finds where severity in ('low', 'medium', 'high')"""
CTES["recs"] = _RECOMMENDED


def recommended(t):
    rows = R.with_findings(graded(t))
    advice = FINDING_TYPE.split("recommendation:")[1][:-1]

    def advise(f):
        made = F.struct(
            f["severity"].alias("priority"), f["dimension"].alias("category"), F.concat(F.lit("Fix "), f["id"]).alias("title"),
            f["description"].alias("description"), F.lit(None).cast("string").alias("exampleCode"),
        ).cast(advice)
        return f.withField("recommendation", F.when(f["severity"] != "info", made))

    stored = rows.withColumn("findings", F.transform("findings", advise))
    return stored.withColumn("recommendations", R.recommendations(F.col("findings")))


@query(
    "recs_extract",
    "select page_id, cast(row_number() over (partition by page_id order by dim_ord, ord) - 1 as int) as i, priority, category, title, description from recs",
)
def recs_extract(t):
    rows = recommended(t).select("page_id", F.posexplode("recommendations").alias("i", "r"))
    return rows.select("page_id", "i", "r.priority", "r.category", "r.title", "r.description")


@query(
    "recs_by_priority",
    """select page_id, cast(case priority when 'high' then 0 when 'medium' then 1 else 2 end as int) as rank, priority,
        string_agg(title, '|' order by dim_ord, ord) as titles from recs group by page_id, priority""",
)
def recs_by_priority(t):
    rows = R.recommendations_by_priority(recommended(t))
    return rows.withColumn("titles", F.array_join("titles", "|"))


def _inline(c: str) -> str:
    return f"case when length({c}) > 65536 then concat(left({c}, 65536), chr(10), '…[truncated]') else {c} end"


_STAMP = "strftime(captured_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_DESCRIPTION = "llms.txt, the site guide for agents"
CTES["evid"] = " union all ".join(
    f"""select page_id, {i} as ord, sha256(concat(page_id, '|{kind}')) as id, '{shown}' as type, {_inline(col)} as inline, '{mime}' as content_type,
        {_STAMP} as captured_at, '{desc}' as description from graded where {col} <> ''"""
    for i, (kind, shown, col, mime, desc) in enumerate(
        (
            ("robots-txt", "robots-txt", "robots", "text/plain", ""),
            ("sitemap", "sitemap", "sitemap", "application/xml", ""),
            ("llms", "other", "llms", "text/plain", _DESCRIPTION),
        )
    )
)


@query("evidence_build", "select page_id, cast(row_number() over (partition by page_id order by ord) - 1 as int) as i, id, type, inline, content_type, captured_at, description from evid")
def evidence_build(t):
    captures = t.captures().select("page_id", "final_url", "captured_at")
    from pagegauge.operators import agent_signals

    pages = grading.with_site(captures, captures, agent_signals.site_table(t.site_files()))
    rows = pages.select("page_id", F.posexplode(R.evidence_items()).alias("i", "e"))
    return rows.select(
        "page_id", "i", "e.id", "e.type", "e.inline", F.col("e.contentType").alias("content_type"),
        store.iso(F.col("e.capturedAt")).alias("captured_at"), F.coalesce("e.description", F.lit("")).alias("description"),
    )


# The pages' own URLs carry no secrets, so masking only drops nothing here; url_mask covers the rest.
_IDS = "concat('r', left(sha256(concat('report-', page_id)), 24)) as id, concat('c', left(sha256(concat('page-', page_id)), 24)) as job_id"
CTES["ptitle"] = f"""select page_id, nullif({trim("min_by(txt, pos)")}, '') as page_title from raw_txt where tag = 'title' and kind = 'rawtext' group by page_id"""
_NAMED = ", ".join(f"cast({d.score} as int) as {R.SCORE_COLUMNS[d.name]}" for d in REGISTRY)
CTES["rep"] = f"""select g.page_id, {_IDS.replace('page_id', 'g.page_id')}, overall_score, grade, {_NAMED}, coalesce(f.n, 0) as n_findings, coalesce(f.ids, '') as finding_ids,
    coalesce(e.n, 0) as n_evidence, t.page_title, final_url, captured_at, f.js as findings_json, e.js as evidence_json
  from graded g left join (select page_id, count(*) as n, string_agg(id, '|' order by dim_ord, ord) as ids,
      string_agg(concat('{{"id":"', id, '","severity":"', severity, '","title":', to_json(title), ',"description":', to_json(description),
        case when evidence is null then '' else concat(',"evidence":', to_json(evidence)) end, '}}'), ',' order by dim_ord, ord) as js from finds group by page_id) f using (page_id)
    left join (select page_id, count(*) as n, string_agg(concat('{{"id":"', id, '","type":"', type, '","inline":', to_json(inline), ',"contentType":"', content_type,
        '","capturedAt":"', captured_at, '"', case when description = '' then '' else concat(',"description":', to_json(description)) end, '}}'), ',' order by ord) as js from evid group by page_id) e using (page_id)
    left join ptitle t using (page_id)"""
_REPORT = (
    "page_id, id, job_id, overall_score, grade, " + ", ".join(R.SCORE_COLUMNS.values())
    + ", cast(n_findings as int) as n_findings, finding_ids, cast(n_evidence as int) as n_evidence, coalesce(page_title, '') as page_title, final_url"
)


def flattened(reports):
    return reports.select(
        "page_id", "id", "job_id", "overall_score", "grade", *R.SCORE_COLUMNS.values(),
        F.size("findings").alias("n_findings"), F.array_join(F.transform("findings", lambda f: f["id"]), "|").alias("finding_ids"),
        F.size("evidence").alias("n_evidence"), F.coalesce("page_title", F.lit("")).alias("page_title"), "final_url",
    )


@query("report_build", f"select {_REPORT} from rep")
def report_build(t):
    return flattened(built(t))


@query("sink_reports", f"select {_REPORT}, strftime(captured_at, '%Y-%m-%d') as created_date from rep")
def sink_reports(t):
    path = shared_dir(t.spark, "reports")
    store.write_reports(built(t), path)
    back = store.read_reports(t.spark, path)
    return flattened(back).join(back.select("page_id", F.col("created_date").cast("string").alias("created_date")), "page_id")


_CAMEL = ", ".join(f"'\"{n}Score\":', {c}, ','" for n, c in R.SCORE_COLUMNS.items())
CTES["repjson"] = f"""select page_id, concat('{{"id":"', id, '","jobId":"', job_id, '","overallScore":', overall_score, ',"grade":"', grade, '",', {_CAMEL},
    '"findings":[', coalesce(findings_json, ''), '],"recommendations":[],"evidence":[', coalesce(evidence_json, ''), ']',
    case when page_title is null then '' else concat(',"pageTitle":', to_json(page_title)) end, ',"finalUrl":', to_json(final_url), ',"createdAt":"', {_STAMP}, '"}}') as json from rep"""


@query(
    "sink_report_json",
    """select page_id, json, replace(replace(replace(replace(replace(json, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'),
        chr(8232), '\\u2028'), chr(8233), '\\u2029') as html_safe from repjson""",
)
def sink_report_json(t):
    path = shared_dir(t.spark, "report-json")
    documents = built(t).select("page_id", store.report_json().alias("json"), store.report_json(True).alias("html_safe"))
    documents.write.json(path)
    return t.spark.read.schema("page_id bigint, json string, html_safe string").json(path)


_DRIFT = "case page_id % 8 when 1 then 'findings' when 2 then 'evidence' when 3 then 'grade' when 4 then 'overall_score' when 5 then 'recommendations' when 6 then 'findings' else '' end"


@query("src_reports_validated", f"select page_id, {_DRIFT} as violations, {_DRIFT} = '' as ok from pages")
def src_reports_validated(t):
    """Stored reports, some of them damaged by page id, read back with the drift named."""
    rows = store.stored_form(built(t))
    pick = lambda n: F.col("page_id") % 8 == n
    bad_finding = '[{"id":"X","severity":"fatal","title":"t","description":"d"}]'
    bad_advice = '[{"priority":"urgent","category":"performance","title":"t","description":"d"}]'
    bad_evidence = '[{"id":"e","type":"sitemap","capturedAt":"yesterday"}]'
    damaged = rows.withColumns(
        {
            "findings": F.when(pick(1), F.lit(bad_finding)).when(pick(6), F.lit("{broken")).otherwise(F.col("findings")),
            "evidence": F.when(pick(2), F.lit(bad_evidence)).otherwise(F.col("evidence")),
            "grade": F.when(pick(3), F.lit("E")).otherwise(F.col("grade")),
            "overall_score": F.when(pick(4), F.lit(101)).otherwise(F.col("overall_score")),
            "recommendations": F.when(pick(5), F.lit(bad_advice)).otherwise(F.col("recommendations")),
        }
    )
    checked = store.validate_reports(damaged)
    return checked.select(
        "page_id", F.array_join("violations", ",").alias("violations"), (F.size("violations") == 0).alias("ok")
    )


@query(
    "report_dimension_rows",
    " union all ".join(f"select page_id, '{n}' as dimension, {c} as score from rep" for n, c in R.SCORE_COLUMNS.items()),
)
def report_dimension_rows(t):
    return R.dimension_rows(built(t))


_DIMS = ", ',' , ".join(f"'\"{d.name}\":', {d.score}" for d in REGISTRY)


@query(
    "insight_request",
    f"""select page_id, concat_ws(chr(10), {", ".join(lit(x) for x in R.REQUEST_LINES)}, '{R.DATA_OPEN}',
        concat('{{"dimensionScores":{{', {_DIMS}, '}},"overall":', overall_score, ',"grade":"', grade, '","pageTitle":', coalesce(cast(to_json(page_title) as varchar), 'null'),
          ',"finalUrl":', to_json(final_url), ',"topFindings":[', coalesce(js, ''), '],"hasRobotsTxt":', coalesce(robots <> '', false),
          ',"hasLlmsTxt":', coalesce(llms <> '', false), ',"hasSitemap":', coalesce(sitemap <> '', false), '}}'), '{R.DATA_CLOSE}') as request
       from graded left join ptitle using (page_id) left join (select page_id, string_agg(concat('{{"id":"', id, '","severity":"', severity, '","title":', to_json(title), '}}'), ',' order by rank) as js
         from tops group by page_id) using (page_id)""",
)
def insight_request(t):
    return R.insight_requests(t.captures(), t.site_files())


def reply_sql() -> str:
    """A reply per page, good and bad ones, in SQL that both engines accept."""
    n = "', cast(page_id as string), '"
    cases = [
        f'{{"verdict": "Fine page {n}", "quickWins": ["Add a title", " Trim me "]}}',
        f'  {{"verdict":" Padded {n} ","quickWins":["one",""," "]}}  ', f'{{"verdict": "", "quickWins": ["x{n}"]}}',
        f'{{"verdict": "No wins {n}", "quickWins": []}}', f'{{"verdict": "Mixed {n}", "quickWins": ["a", 3]}}',
        f'{{"verdict": {n}, "quickWins": ["a"]}}', f'{{"verdict": "No list {n}", "quickWins": "a"}}',
        f"I cannot answer {n}", f'{{"verdict": "Tail {n}", "quickWins": ["a"]}} and more', f'["verdict", "{n}"]',
    ]
    whens = " ".join(f"when {i} then concat('{c}')" for i, c in enumerate(cases))
    fenced = "concat('```json', chr(10), '{\"verdict\": \"Fenced ', cast(page_id as string), '\", \"quickWins\": [\"a\"]}', chr(10), '```')"
    return f"case page_id % 11 {whens} else {fenced} end"


@query(
    "insight_parse",
    """select page_id, page_id % 11 in (0, 1, 10) as ok,
        case page_id % 11 when 0 then concat('Fine page ', page_id) when 1 then concat('Padded ', page_id) when 10 then concat('Fenced ', page_id) else '' end as verdict,
        case page_id % 11 when 0 then 'Add a title|Trim me' when 1 then 'one' when 10 then 'a' else '' end as quick_wins from pages""",
)
def insight_parse(t):
    rows = t.pages().select("page_id", R.parse_insight(F.expr(reply_sql())).alias("insight"))
    return rows.select(
        "page_id", F.col("insight").isNotNull().alias("ok"), F.coalesce("insight.verdict", F.lit("")).alias("verdict"),
        F.coalesce(F.array_join("insight.quick_wins", "|"), F.lit("")).alias("quick_wins"),
    )
