"""Column functions against tables of known results."""

import random

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import ips, scoring as S, text as T, urls as U
from pagegauge.operators.actionability import looks_hashed
from pagegauge.operators.structured_data import is_json, json_ld_has_context, json_ld_types


def values(spark, inputs, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


REJECTIONS = {
    "https://example.com/a": None, "": "invalid-url", "not a url": "invalid-url", "https://": "invalid-url",
    "ftp://example.com": "unsupported-protocol", "javascript:alert(1)": "unsupported-protocol", "file:///etc/passwd": "unsupported-protocol",
    "https://user:pw@example.com": "embedded-credentials", "http://localhost:3000": "blocked-hostname", "http://LOCALHOST/": "blocked-hostname",
    "http://127.0.0.1": "loopback-ip", "http://2130706433/": "loopback-ip", "http://0x7f000001/": "loopback-ip", "http://0177.0.0.1/": "loopback-ip",
    "http://127.1/": "loopback-ip", "http://10.1.2.3": "private-ip", "http://172.31.255.255": "private-ip", "http://172.32.0.1": None,
    "http://192.168.1.1": "private-ip", "http://100.64.0.1": "private-ip", "http://100.128.0.1": None, "http://169.254.169.254/x": "link-local",
    "http://0.0.0.0": "reserved-ip", "http://224.0.0.1": "reserved-ip", "http://255.255.255.255": "reserved-ip", "http://8.8.8.8": None,
    "http://[::1]/": "loopback-ip", "http://[::]/": "reserved-ip", "http://[::ffff:127.0.0.1]/": "loopback-ip", "http://[::ffff:8.8.8.8]/": None,
    "http://[fe80::1]/": "link-local", "http://[fc00::1]/": "private-ip", "http://[ff02::1]/": "reserved-ip", "http://[2606:4700::1111]/": None,
    "http://[1::2::3]/": "invalid-url", "http://256.1.1.1/": "invalid-url", "http://example.com:70000/": "invalid-url",
}


def test_rejections(spark):
    assert dict(zip(REJECTIONS, values(spark, list(REJECTIONS), U.rejection))) == REJECTIONS


def test_null_url_is_rejected(spark):
    assert spark.range(1).select(U.rejection(F.lit(None).cast("string"))).first()[0] == "invalid-url"


NORMAL = {
    "HTTPS://Example.COM:443/a/?utm_source=x&b=2&a=1#f": "https://example.com/a?a=1&b=2",
    "http://example.com": "http://example.com/", "http://example.com:8080/x//": "http://example.com:8080/x",
    "https://example.com/?b=1&B=2&a=3&b=0": "https://example.com/?a=3&b=1&b=0&B=2", "https://example.com/?q=a b&r=c%20d": "https://example.com/?q=a+b&r=c+d",
    "https://example.com/?gclid=1&REF=2": "https://example.com/", "https://example.com/p?empty=&k": "https://example.com/p?empty=&k=",
}


def test_normalize(spark):
    assert dict(zip(NORMAL, values(spark, list(NORMAL), U.normalize))) == NORMAL


MASKED = {
    "https://x.com/r?token=abc&page=2": "https://x.com/r?token=%5Bredacted%5D&page=2",
    "https://x.com/?access_token=1&keyword=k": "https://x.com/?access_token=%5Bredacted%5D&keyword=k",
    "https://u:p@x.com/a": "https://x.com/a", "https://x.com/?a=1&b=%20": "https://x.com/?a=1&b=%20", "nonsense": "nonsense",
    "https://x.com/?code=1&code=2&z=3": "https://x.com/?code=%5Bredacted%5D&z=3",
}


def test_mask(spark):
    assert dict(zip(MASKED, values(spark, list(MASKED), U.mask))) == MASKED


READABLE = {
    "https://x.com/?sid=1": True, "https://x.com/a?sid=1": False, "https://x.com/About": False, "https://x.com/a-b/c": True,
    "https://x.com/deadbeefdeadbeef": False, "https://x.com/" + "a" * 41: False, "https://x.com/" + "ab12" * 8: False,
    "https://x.com/this-is-a-long-slug-with-words-in-it": True, "bad": False, "https://x.com/café": False,
}


def test_readable(spark):
    assert dict(zip(READABLE, values(spark, list(READABLE), U.readable))) == READABLE


def test_address_forms(spark):
    forms = ["1.2.3.4", "16909060", "0x01020304", "1.2.772", "01.02.03.04", "1.2.3.4.", "1..2", "", "1.2.3.256", "4294967296", "09.1.1.1", "9" * 30]
    dotted = values(spark, forms, lambda x: F.when(ips.parse_v4(x).isNotNull(), ips.dotted(ips.parse_v4(x))))
    assert dotted == ["1.2.3.4"] * 5 + [None] * 7


def test_text(spark):
    assert values(spark, ["  a ﻿", "\tb\n"], T.trim) == ["a", "b"]
    assert values(spark, ["a&amp;lt;b", "&#65;&#x1F600;&#0;", "&copy;&nbsp;x", "a & b"], T.decode_entities) == ["a&lt;b", "A\U0001f600�", "© x", "a & b"]
    assert values(spark, ["a  b", "x" * 12], lambda c: T.snippet(c, 10)) == ["a b", "x" * 10 + "…"]
    assert values(spark, ["make", "the", "banana", "tables", "rhythm"], T.syllables) == [1, 1, 3, 2, 1]


def test_syllables_of_all_words_are_the_sum_over_words_and_found_without_a_walk(spark):
    rng = random.Random(8)
    letters = "aaeeiouyydlsstrzbnéàñßÿ×÷ÀÉ" + "AEYSD" + "'"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", "es", "ed", "e", "les", "'s"])
    texts = ["", "yxes", "the rhythm made tables", "ß ×× y yyyy", *[rng.choice(" .\n").join(word() for _ in range(rng.randrange(1, 40))) for _ in range(200)]]
    one_by_one = values(spark, texts, lambda c: F.aggregate(T.words(c), F.lit(0), lambda total, w: total + T.syllables(w)))
    assert values(spark, [*texts, None], lambda c: T.syllable_total(T.words(c))) == [*one_by_one, None]
    plan = spark.range(1).select(T.syllable_total(T.words(F.col("id").cast("string"))))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan


def test_collapse_equals_replacing_every_run(spark):
    rng = random.Random(9)
    texts = ["", " ", "  ", "a b", *["".join(rng.choice("ab~!  \t\n\u00a0\u2003\ufeffé日\x1f\x85") for _ in range(rng.randrange(30))) for _ in range(300)]]
    assert values(spark, texts, T.collapse) == values(spark, texts, lambda c: F.trim(F.regexp_replace(c, T.WS + "+", " ")))


def test_word_overlap(spark):
    df = spark.createDataFrame([("", ""), ("a b", "of it"), ("red bike", ""), ("Red bike shop", "red BIKE")], "a string, b string")
    rows = df.select(T.jaccard_schema(F.col("a"), F.col("b")), T.jaccard_clarity(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0), (1.0, 0.0), (0.0, 0.0), (2 / 3, 2 / 3)]


def test_scores(spark):
    one = spark.range(1)
    cases = [(199.0, 30), (200.0, 30), (1500.0, 0), (850.0, 15), (2000.0, 0)]
    assert [one.select(S.linear_score(F.lit(v), 200, 1500, 30)).first()[0] for v, _ in cases] == [s for _, s in cases]
    raw = [float("nan"), float("inf"), -3.0, 2.5, 99.5, 180.0]
    assert [one.select(S.clamp_score(F.lit(v))).first()[0] for v in raw] == [0, 0, 0, 3, 100, 100]


def test_hashed_names(spark):
    # By the pattern, a double underscore is not a hash and main-content is one.
    names = ["css-1abc23d", "Button_a8B2c", "Button_root__a8B2c", "btn", "nav-item", "main-content", "xy-a1b2c3"]
    assert values(spark, names, looks_hashed) == [True, True, False, False, False, True, True]


def test_json_ld(spark):
    texts = ['{"a":1} x', '{"a":1,"a":2}', '{"a":1,}', "[1,2", "1],[2", '1,"x":2', "{'a':1}", ' {"a":1} \n']
    assert values(spark, texts, is_json) == [False, True, False, False, False, False, False, True]
    contexts = ['{"@context":"s"}', '{"@context":{"a":"b"}}', '{"@context":["s",{}]}', '[[{"@context":"s"}]]', '{"x":{"@context":"s"}}', "[]"]
    assert values(spark, contexts, json_ld_has_context) == [True, False, True, True, False, False]
    assert values(spark, ['{"@type":"A","x":[{"@type" : ["B","C"]}],"t":"{\\"@type\\":\\"D\\"}"}'], json_ld_types) == [["A", "B", "C"]]


def test_json_ld_nested(spark):
    types = ['{"@type":["A]B","Article"]}', '{"@type":"Art\\u0069cle"}', '[[[{"@type":"X"}]]]', '{"a":[{"b":{"@type":["P","Q"]}}]}']
    assert values(spark, types, json_ld_types) == [["A]B", "Article"], ["Article"], ["X"], ["P", "Q"]]
    contexts = ['[[[{"@context":"s"}]]]', "[" * 9 + '{"@context":["s"]}' + "]" * 9, '[{"x":[{"@context":"s"}]}]']
    assert values(spark, contexts, json_ld_has_context) == [True, True, False]


def test_references_are_decoded_once(spark):
    got = values(spark, ["&#38;lt;", "&eacute;&rarr;&times;&hearts;", "&#150;&#x80;", "&#" + "9" * 50 + ";", "&nosuch; &amp", "&#00000000000065;", "&NotEqualTilde;"], T.decode_entities)
    assert got == ["&lt;", "é→×♥", "–€", "\ufffd", "&nosuch; &", "A", "≂̸"]


def test_sentences_end_before_any_white_space(spark):
    assert values(spark, ["One. Two.\nThree!\tFour?", "a.b.c", "end.\u00a0more."], T.sentence_total) == [4, 1, 2]


DISGUISED = {
    "http://127。0。0。1/": "loopback-ip", "http://ｌｏｃａｌｈｏｓｔ/": "blocked-hostname", "http://ⓛⓞⓒⓐⓛⓗⓞⓢⓣ/": "blocked-hostname",
    "http://１０.１.２.３/": "private-ip", "http://local\u00adhost/": "blocked-hostname", "http://⑩.1.2.3/": "invalid-url", "http://bücher.example/": None,
    "http://𝐥𝐨𝐜𝐚𝐥𝐡𝐨𝐬𝐭/": "blocked-hostname", "http://LOCALHOST./": "blocked-hostname",
}


def test_disguised_hosts(spark):
    assert dict(zip(DISGUISED, values(spark, list(DISGUISED), U.rejection))) == DISGUISED


def test_dot_segments(spark):
    paths = {"/a/../b": "/b", "/a/./b": "/a/b", "/a/b/..": "/a/", "/..": "/", "/a/%2e%2E/b": "/b", "/a..b/.c": "/a..b/.c", "/../../x/": "/x/", "/a//../b": "/a/b"}
    assert dict(zip(paths, values(spark, list(paths), U.encoded_path))) == paths
    assert values(spark, ["https://x.com/a/../b?q=1", "https://x.com/b?q=1"], U.normalize) == ["https://x.com/b?q=1"] * 2


@pytest.mark.parametrize("page", [
    "<" * 1_000_000, "<p " + "a='b' " * 1_000_000 + ">x", '<a href="x>' + "<a href=y>t</a>" * 1_000_000, "<p title=it's>" * 100_000, "&" * 1_000_000,
    "<script " * 100_000, "<!" * 500_000, "</script" * 100_000, "<script>" + "</style " * 100_000, "x<" * 500_000,
], ids=lambda p: p[:12])
def test_tokens_of_any_page(spark, page):
    """Lossless, in linear time and without recursion, whatever is repeated and however often."""
    from pagegauge.functions import html as H

    df = spark.createDataFrame([(page,)], "html string").select(H.tokens(F.col("html")).alias("t"), "html")
    checked = df.select((F.array_join("t", "") == F.col("html")).alias("same"), F.size("t").alias("n"), F.exists("t", lambda t: H.raw_body(t).isNull()).alias("x"))
    row = checked.first()
    assert row["same"] and row["n"] >= 1


def test_attributes_of_odd_tags(spark):
    from pagegauge.functions import html as H

    tags = ["<p title=it's id=a>", '<a href="x y" b=\'c\' d>', "<br/>", "<a href=x/>", '<i a="b', "<p a = b c= d e =f>", "<p a=\"1\" a=2>"]
    got = values(spark, tags, lambda c: F.transform(H.attributes(c), lambda a: F.concat_ws("=", a["name"], a["value"])))
    assert got == [["title=it's", "id=a"], ["href=x y", "b=c", "d="], [], ["href=x/"], ['a="b'], ["a=b", "c=d", "e=f"], ["a=1", "a=2"]]
    kinds = values(spark, ["<p title=it's>", "<p title=", "</p", "</>", "<!-- x", "<script>var a", "a < b"], lambda c: H.token_kind(c, H.tag_name(c)))
    assert kinds == ["open", "comment", "comment", "comment", "comment", "script", "text"]


def test_events_keep_what_is_not_hidden(spark):
    import json

    from pagegauge.operators import redaction

    event = {
        "level": "error", "tags": ["a", {"b": 1}], "n": 1.5, "none": None, "user": {"id": 7, "email": "x", "ip_address": "y", "segment": {"k": [1]}},
        "request": {"url": "u", "method": "GET", "cookies": "c", "data": {"p": 1}, "query_string": "q", "headers": {"Cookie": "c", "accept": "t"}},
    }
    want = dict(event, user={"id": 7, "segment": {"k": [1]}}, request={
        "url": "u", "method": "GET", "query_string": "[REDACTED]", "headers": {"Cookie": "[REDACTED]", "accept": "t"}})
    got = values(spark, [json.dumps(event), '{"message":"m"}', '{"request":{"url":"u"}}'], redaction.redact_event)
    assert [json.loads(x) for x in got] == [want, {"message": "m"}, {"request": {"url": "u"}}]


def test_hosts_and_redirects(spark):
    from pagegauge.operators import fetching

    hosts = spark.createDataFrame([(h,) for h in ("cafe.de", "ab.cd", "10.0.0.1", "8.8.8.8", "[::1]", "fine.org", "cafe.de")], "host string")
    records = spark.createDataFrame([("cafe.de", "10.0.0.7"), ("fine.org", "9.9.9.9")], "host string, ip string")
    got = {r["host"]: (r["verdict"], r["blocked_ip"]) for r in fetching.host_verdicts(hosts, records).collect()}
    assert got == {
        "cafe.de": ("blocked-host", "10.0.0.7"), "ab.cd": ("dns-failed", None), "10.0.0.1": ("blocked-host", "10.0.0.1"), "8.8.8.8": ("ok", None),
        "[::1]": ("blocked-host", "[::1]"), "fine.org": ("ok", None),
    }
    edges = spark.createDataFrame([("http://a.com/", "http://c.com/"), ("http://a.com/", "http://b.com/"), ("http://b.com/", "http://d.com/")], "from_url string, to_url string")
    done = fetching.resolve_redirects(spark.createDataFrame([("http://a.com/",)], "url string"), edges).collect()
    assert [(r["final_url"], r["hops"]) for r in done] == [("http://d.com/", 2)]


def test_percentiles(spark):
    import numpy as np

    from pagegauge.operators import jobs

    rng = np.random.default_rng(1)
    for sample in ([5.0], [1.0, 2.0], [7.0] * 500, list(rng.exponential(1e9, 3000)), [0.001 * i for i in range(1500)]):
        df = spark.createDataFrame([(float(v),) for v in sample], "v double")
        row = jobs.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
        assert row["n"] == len(sample)
        assert [row["p50"], row["p95"], row["p99"]] == pytest.approx(list(np.percentile(sample, [50, 95, 99])), rel=1e-9)
    assert jobs.exact_percentiles(df.limit(0), "v", {"p50": 0.5}).first()["n"] == 0


@pytest.mark.parametrize("now, left", [("2024-01-04 12:00:00", ["c"]), ("2024-01-04 00:00:00", ["b", "c"]), ("2023-01-01 00:00:00", ["a", "b", "c"]), ("2025-01-01 00:00:00", [])])
def test_retention(spark, tmp_path, now, left):
    """Two days are kept. A cut-off day that is wholly expired is emptied, earlier days go, later ones stay."""
    from pagegauge.operators import jobs

    path = str(tmp_path / "jobs")
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 11:00:00"), ("c", "2024-01-09 00:00:00")], "job_id string, at string")
    rows = rows.select("job_id", F.to_timestamp("at").alias("created_at"), F.to_date("at").alias("created_date"))
    rows.write.partitionBy("created_date").parquet(path)
    for _ in range(2):
        jobs.apply_retention(spark, path, F.to_timestamp(F.lit(now)), 2)
        assert sorted(r["job_id"] for r in spark.read.schema(rows.schema).parquet(path).collect()) == left


def test_retention_period_is_checked(spark):
    from pagegauge.operators import jobs

    with pytest.raises(ValueError):
        jobs.expired(spark.range(1), F.current_timestamp(), 0)
