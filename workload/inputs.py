"""Inputs of the registered queries, derived from the given tables.

The tables hold plain pages and events. The recipes below decorate every row by its id, so that each rule
of the library fires somewhere, and everything derived grows with the tables. The expressions are SQL that
Spark and DuckDB both accept, so the expected results start from the same input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# -- page variants, chosen by page_id % 12 ------------------------------------------------------
FORM = (
    '<form><label for="em">Email</label><input id="em" name="em" type="email" autocomplete="email">'
    '<label>Phone <input name="tel" type="tel"></label><input aria-label="City" id="c1" name="city">'
    '<button type="submit">Subscribe now</button><button type="button" data-x="1">More</button></form>'
)
BARE_FORM = (
    '<form><input type="text"><input name="q" class="css-9zk3a1"><textarea name="msg">draft &amp; note</textarea>'
    '<select id="pick"><option>one<option>two</select><input type="hidden" name="h">'
    '<input type="submit" value="Go"><button>OK</button><a href="#x"> </a><a href="/z" aria-label="Zoom"></a></form>'
)
CLICKABLE = (
    '<div onclick="go()">Open</div><span role="button" onclick="go()">Buy</span><div role="button">Save</div>'
    '<div onclick=\'a("b")\'>Close</div><span onclick="x()">Pay</span><div class="btn" role="button">Six</div>'
    '<a href="/r">read more</a><a href="/h">Here</a><a href="/m">more</a>'
)
IMAGES = '<img src="a.png" alt="A cup"><img src="b.png" alt=""><IMG SRC="c.png"><img src=d.png alt>'
BANNER = (
    '<div class="notice" style="position: fixed; z-index: 9999"><p>We use cookies &#38; similar tools.</p></div>'
    '<div role="dialog" id="consent-box"><span>Choose</span></div><div style="z-index:5">privacy</div>'
)
HEAD_FULL = (
    '<meta property="og:title" content="An old title"><meta property="og:title" content="of and the in to it">'
    '<meta property="og:description" content="About it"><meta property="og:image" content="https://x.example/i.png">'
    '<meta property="og:url" content="https://x.example/"><meta property="og:type" content="article">'
    '<meta name="twitter:card" content="summary"><link rel="Canonical" href="https://x.example/p">'
    '<link rel="alternate" hreflang="fr" href="https://x.example/fr">'
    '<meta name="description" content="A description that is long enough to pass the lower bound of fifty characters.">'
    '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article", '
    '"author": {"@type": ["Person", "Robot"]}, "note": "a {\\"@type\\": \\"Fake\\"} b"}</script>'
    '<script type="application/ld+json">[{"@context": ["https://schema.org", {"x": "y"}], "@type": "Thing"}]</script>'
)
HEAD_BROKEN = (
    '<meta property="og:title" content=""><meta property="og:url" content="https://x.example/">'
    '<meta name="description" content="Too short"><link rel="canonical" href="">'
    '<script type="application/ld+json">{"@type": "Article", }</script>'
    '<script type="application/ld+json">{"@context": {"a": "b"}, "@type": "Widget", "name": "n"}</script>'
    '<script type="application/ld+json">  </script>'
)
STRUCTURED_BODY = (
    '<header><h2>Sub &lt;two&gt;</h2></header><main itemscope itemtype="https://schema.org/Thing"><h4>Deep</h4>'
    '<p>Main words are here. Are they? They are!</p><template><p>hidden words</p></template></main>'
    '<a href="#main">Skip to main content</a><aside>Aside <nav>inner nav</nav></aside>'
)
LONG_META = (
    '<meta name="description" content="This description is far longer than what any list of results will show, '
    'because it goes on and on about the same thing, adds one more clause, and then another one, to pass the bound.">'
)
SPA = '<script>var app = "<div>not markup</div>";</script><noscript>Please enable scripts</noscript>'

OPEN_ENDS = (
    "<div><section>left open<p>one<p>two<ul><li>first<li>second<aside>beside</ul><p>in the aside</div><form><label>Code <input name=code><span>x</form>"
    "<input name=after><table><tr><td>a<td>b<tr><th>c</div><td>d</table><svg><g><path d=m/><path/></g></svg><h2>Open<h3>Next</h2>ends"
)


def _q(text: str, spark: bool) -> str:
    if spark:
        text = text.replace("\\", "\\\\")
    return "'" + text.replace("'", "\\'" if spark else "''") + "'"


def rendered_sql(spark: bool) -> str:
    q = lambda s: _q(s, spark)
    end = lambda s: f"replace(html, '</article>', concat({s}, '</article>'))"
    head = lambda s: f"replace(html, '<head>', concat('<head>', {s}))"
    iframe = "concat('<iframe src=\"/f\" title=\"x\">', repeat('frame text ', cast(20 + page_id * 7 % 300 as int)), '</iframe>')"
    return f"""case page_id % 12
      when 1 then {end(q(FORM))} when 2 then {end(q(BARE_FORM))} when 3 then {end(q(CLICKABLE))}
      when 4 then {end(q(IMAGES))} when 5 then {end(iframe)} when 6 then {end(q(BANNER))}
      when 7 then {head(q(HEAD_FULL))} when 8 then {head(q(HEAD_BROKEN))} when 9 then {end(q(STRUCTURED_BODY))}
      when 10 then replace(replace(html, '<article>', '<section>aa</section><section id="s">'), '</article>', '</section>')
      when 11 then {"replace(replace(" + head(q(LONG_META + SPA)) + ", '<article>', '<div>'), '</article>', '</div>')"}
      else {"case when page_id % 24 = 0 then " + end(q(OPEN_ENDS)) + " else html end"} end"""


RAW_SQL = """case when page_id % 5 = 0 then regexp_replace(html, '(?s)<article>.*</article>', '')
      when page_id % 15 = 3 then left(html, cast(floor(length(html) * 55 / 100) as int))
      else rendered_html end"""

PERF_SQL = {
    "ttfb": "cast(100 + (37 * page_id) % 1600 as double)",
    "page_size": "cast(200000 + 100000 * ((7919 * page_id) % 60) as bigint)",
    "num_requests": "cast(10 + (13 * page_id) % 160 as int)",
    "dom_content_loaded": "cast(700 + (101 * page_id) % 6000 as double)",
    "network_idle": "cast(1500 + (211 * page_id) % 12000 as double)",
}

ORIGIN_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"


def _lines(*items: str) -> str:
    return "concat_ws(chr(10), " + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


ROBOTS_SQL = f"""case k % 5
      when 0 then {_lines('User-agent: *', 'Allow: /', 'Disallow: /admin', 'Sitemap: https://x.example/sitemap.xml')}
      when 1 then {_lines('# closed', 'User-agent: *', 'Disallow: / # all', '')}
      when 2 then concat({_lines('user-agent: GPTBot', 'DISALLOW: /', '', 'User-Agent: CCBot', 'Disallow:', 'Disallow: /', 'User-agent: *', 'Disallow:')}, chr(13), chr(10), 'noise')
      when 3 then {_lines('Disallow: /early', 'User-agent: claudebot', 'User-agent: Bytespider', '# note', 'User-agent: anthropic-ai', 'Crawl-delay: 3', 'Disallow: /x', 'Disallow: /', 'User-agent: ClaudeBot', 'Allow: /', 'sitemap:')}
      else null end"""
LLMS_SQL = f"""case k % 3
      when 0 then {_lines('# Site', '', '> About', '## Docs', '- [Guide](https://x.example/g) and [Full](https://x.example/LLMS-full.txt)', '## More', '[a](b)')}
      when 1 then {_lines('Just prose', 'with [one](link)', '#no heading')}
      else null end"""
SITEMAP_SQL = """case k % 4
      when 0 then '<?xml version="1.0"?><urlset xmlns="x"><url/></urlset>'
      when 1 then '<?xml version="1.0"?><sitemapindex></sitemapindex>'
      when 2 then '<html>not found</html>'
      else null end"""

# -- jobs -------------------------------------------------------------------------------------
JOB_ID_SQL = {True: "concat('c', left(sha2(concat('job-', event_id), 256), 24))", False: "concat('c', left(sha256(concat('job-', event_id)), 24))"}
STATUS_SQL = "case event_type when 'signup' then 'PENDING' when 'click' then 'RUNNING' when 'error' then 'FAILED' else 'COMPLETED' end"


class Tables:
    """The given tables and what the queries derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    def pages(self) -> DataFrame:
        return self.read("pages")

    def captures(self) -> DataFrame:
        pages = self.pages().withColumn("rendered_html", F.expr(rendered_sql(True)))
        perf = F.struct(*[F.expr(sql).alias(name) for name, sql in PERF_SQL.items()])
        return pages.select(
            "page_id", "url", F.col("url").alias("final_url"), F.expr(RAW_SQL).alias("raw_html"), "rendered_html",
            perf.alias("perf"),
            F.timestamp_seconds(F.lit(1_706_659_200) + F.col("page_id")).alias("captured_at"),
        )

    def site_files(self) -> DataFrame:
        """Long (origin, kind, body); origins are found from the pages."""
        sites = self.pages().groupBy(F.expr(ORIGIN_SQL).alias("origin")).agg(F.min("page_id").alias("k"))
        kinds = F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.expr(sql).alias("body"))
                for kind, sql in (("robots", ROBOTS_SQL), ("llms", LLMS_SQL), ("sitemap", SITEMAP_SQL))
            ]
        )
        return sites.select("origin", F.inline(kinds))

    def jobs(self, keys: int = 2) -> DataFrame:
        """One job per event; two keys own all jobs, so the hot-key paths are exercised."""
        started = F.when(F.col("event_type") != "signup", F.col("at") + F.expr("interval 5 seconds"))
        events = self.read("events").withColumn("at", F.col("ts").cast("timestamp"))
        key = F.concat(F.lit("https://s"), (F.col("user_id") % keys).cast("string"), F.lit(".example.com/"))
        open_job = F.col("event_type").isin("signup", "click")
        done = F.timestamp_micros(
            F.unix_micros("at") + F.lit(5_000_000) + F.round(F.col("value") * 1000).cast("bigint") * 1000
        )
        return events.select(
            "event_id", "user_id", "event_type", "value", "props",
            F.expr(JOB_ID_SQL[True]).alias("job_id"),
            F.concat(key, F.lit("?token="), F.col("event_id").cast("string")).alias("url"),
            key.alias("normalized_url"),
            F.expr(STATUS_SQL).alias("status"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("Upstream returned "), (F.col("event_id") % 500).cast("string"))).alias("error_message"),
            F.when(F.col("event_id") % 7 != 0, F.sha2(F.concat(F.lit("token-"), F.col("event_id").cast("string")), 256)).alias("delete_token_hash"),
            F.col("at").alias("created_at"),
            started.alias("started_at"),
            F.when(~open_job, done).alias("completed_at"),
        )

    # -- URL tables -----------------------------------------------------------------------------
    def url_cases(self) -> DataFrame:
        """(case_id, url): every page URL and one decorated variant per page."""
        return self.pages().select(
            F.inline(
                F.array(
                    F.struct((F.col("page_id") * 2).alias("case_id"), F.col("url").alias("url")),
                    F.struct((F.col("page_id") * 2 + 1).alias("case_id"), F.expr(url_variant_sql()).alias("url")),
                )
            )
        )

    def addresses(self) -> DataFrame:
        """(event_id, ip): one textual address per event, in all notations."""
        return self.read("events").select("event_id", F.expr(address_sql(True)).alias("ip"))

    def host_ips(self) -> DataFrame:
        """(host, ip): resolved addresses per page host; some hosts have none."""
        hosts = self.pages().groupBy(F.expr(HOST_SQL).alias("host")).agg(F.min("page_id").alias("k"))
        return hosts.select("host", F.explode(F.expr(HOST_IPS_SQL.format(array="array"))).alias("ip"))

    def redirects(self) -> DataFrame:
        """(from_url, to_url): one edge per page, chains of up to nine hops, some into private networks."""
        return self.pages().select(
            F.expr(HOP_SQL.format(id="page_id")).alias("from_url"), F.expr(REDIRECT_SQL).alias("to_url")
        )

    def redirect_starts(self) -> DataFrame:
        return self.pages().select("page_id", F.expr(HOP_SQL.format(id="page_id")).alias("url"))


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
HOST_IPS_SQL = """case k % 7 when 0 then {array}('93.184.216.34') when 1 then {array}('93.184.216.34', '10.0.0.7')
    when 2 then {array}('2606:2800:220:1::5', 'fe80::1') when 3 then {array}('2606:2800:220:1::5')
    when 4 then {array}('8.8.8.8', '1.1.1.1', '9.9.9.9') when 5 then {array}('bad address') else null end"""
HOP_SQL = "concat('https://hop.example.com/p/', cast({id} as string))"
REDIRECT_SQL = f"""case when page_id % 40 = 13 then 'http://192.168.0.1/admin' when page_id % 40 = 27 then 'not a url'
    when page_id % 9 = 8 then null else {HOP_SQL.format(id='page_id + 1')} end"""


def url_variant_sql() -> str:
    """One URL per page that exercises one rule of screening, normalising, masking or readability."""
    n = "', cast(page_id as string), '"
    b = "', cast(page_id % 250 as string), '"
    cases = [
        f"http://localhost:8080/p{n}", f"https://user:pw@h{n}.example.com/x", f"ftp://files.example.com/{n}",
        f"http://127.0.0.1/{n}", f"http://0x7f.1/{n}", f"http://2130706433/{n}", f"http://192.168.{b}.1/",
        f"http://172.16.0.{b}/", f"http://172.32.0.{b}/", f"http://100.64.1.{b}/", f"http://169.254.169.254/latest/{n}",
        f"http://[::1]:80{n}/", f"http://[fe80::{b}]/", f"http://[fc00::1:{b}]/", f"http://[2001:db8::{b}]/a",
        f"http://[::ffff:10.0.0.{b}]/", f"http://0/{n}", f"http://224.0.0.{b}/", f"http://256.1.1.{b}/",
        f"not a url {n}", "https://", f"javascript:alert({n})",
        f"HTTPS://WWW.Example.COM:443/Path/{n}/?b=2&a=1&utm_source=x&A=3&Mc_eid=4#frag",
        f"http://example.com:80/a//{n}///?q=a+b&q=c%20d&ref=z&x=%zz&&=e&f",
        f"https://example.com/reset?token=abc{n}&user=1&token=zz&access_token=q#t",
        f"https://example.com/cb?code={n}&state=s&keyword=k&email=a%40b.c&code=2",
        f"https://example.com/?sid={n}", f"https://example.com/p/{n}?SessionId=3",
        f"https://example.com/{'ab-' * 14}{n}", f"https://example.com/deadbeefdeadbeef/{n}",
        f"https://example.com/abcdefghijklmnopqrstuvwxyz012345{b}", f"https://example.com/a-long-but-readable-path-{n}",
        f"https://example.com/UPPER/{n}", f"  https://example.com/trim/{n}  ", f"https://ip6-localhost/{n}",
        f"http://017700000001/{n}", f"http://1.2.3.4.5/{n}", f"https://example.com:99999/{n}", "",
        f"https://example.com:8443/café/{n}?q=é&z=*~&a=(1)",
        f"https://Bücher.example/{n}?b=1", f"https://xn--bcher-kva.example/{n}?b=1", f"http:example.com/a/{n}", f"HTTPS:///example.com/{n}",
        f"https://例え.テスト.example:443/{n}/",
    ]
    whens = " ".join(f"when {i} then concat('{c}')" for i, c in enumerate(cases))
    return f"case page_id % {len(cases)} {whens} else url end"


def address_sql(spark: bool) -> str:
    def hexed(x: str) -> str:
        return f"lower(hex(cast({x} as bigint)))" if spark else f"lower(to_hex(cast({x} as bigint)))"

    n, b, e = "cast(event_id as string)", "cast(event_id % 256 as string)", "event_id"
    cases = [
        f"concat({b}, '.', cast(floor(event_id / 7) % 256 as int), '.3.4')", f"concat('10.', {b}, '.0.1')", f"concat('127.', {n})",
        f"concat('172.', {b}, '.9.9')", f"concat('192.168.', cast(event_id * 7 as string))", f"cast(event_id * 429497 as string)",
        f"concat('0x', {hexed('event_id * 65537')})", f"concat('0', cast(event_id % 8 as string), '7.1.', {b})", f"concat('1..', {n})",
        f"concat('256.', {n}, '.1.1')", f"concat('2001:db8::', {hexed(e)})", f"concat('[fe80::', {hexed(e)}, ']')",
        f"concat('::ffff:192.168.1.', {b})", f"concat('fd00:', {hexed(e)}, ':0:0:0:0:0:1')", f"concat('ff02::', {hexed(e)})",
        f"concat('1:2:3::4::', {hexed(e)})", "'::1'", "'::'", f"concat('host', {n})", f"concat({b}, '.1.1.')", "''",
        f"concat('100.', {b}, '.1.1')", f"concat('169.254.', {n})", f"concat('::', {b}, '.0.0.1')", f"concat('1:2:3:4:5:6:7:', {hexed('event_id * 16')})",
        f"concat('99999999999999999999', {n})", f"concat('08.1.1.', {b})", f"concat('2002::', {hexed(e)}, ':')",
    ]
    whens = " ".join(f"when {i} then {c}" for i, c in enumerate(cases))
    return f"case event_id % {len(cases)} {whens} end"
