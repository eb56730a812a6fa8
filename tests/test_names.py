"""Punycode hosts against Python's codec, character references at scale, escaped JSON-LD keys."""

import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import punycode
from pagegauge.functions import text as T
from pagegauge.functions import urls as U
from pagegauge.operators import structured_data


def values(spark, inputs, fn):
    frame = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r["y"] for r in frame.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_punycode_against_the_codec(spark):
    labels = [
        "bücher", "münchen", "ü", "üü", "aüb", "例え", "テスト", "правда", "他们为什么不说中文", "ليهمابتكلموشعربي؟", "3年b組金八先生", "安室奈美恵-with-super-monkeys",
        "パフィーdeルンバ", "\U0001f4a9", "a\U0001f600b\U0001f600", "ß", "é" * 63, "x" * 30 + "ñ", "ab-cdé", "-é-",
    ]
    assert values(spark, labels, punycode.encoded) == [x.encode("punycode").decode() for x in labels]


@pytest.mark.parametrize("left, right", [
    ("http://bücher.example/", "http://xn--bcher-kva.example/"), ("http://BÜCHER.Example/", "http://xn--bcher-kva.example/"),
    ("http:example.com/a", "http://example.com/a"), ("https:\\\\example.com/a", "https://example.com/a"), ("http:////example.com/a", "http://example.com/a"),
    ("https://例え。テスト/", "https://xn--r8jz45g.xn--zckzah/"), ("http://ｂücher.example./x", "http://xn--bcher-kva.example./x"),
])
def test_two_spellings_are_one_key(spark, left, right):
    a, b = values(spark, [left, right], U.normalize)
    assert a == b and a is not None
    assert values(spark, [left, right], U.shape_ok) == [True, True]


def test_other_schemes_stay_as_they_are(spark):
    assert values(spark, ["mailto:a@b.example", "javascript:alert(1)", "data:text/plain,x"], U.parts) == [None] * 3


def test_every_name_is_decoded(spark):
    names = sorted(html5)
    got = values(spark, [f"<&{n}>" for n in names], T.decode_entities)
    assert got == [f"<{html5[n]}>" for n in names]
    assert values(spark, ["&nosuch;", "&", "&;", "&eacutex;"], T.decode_entities) == ["&nosuch;", "&", "&;", "&eacutex;"]


def test_late_names_take_no_longer_than_common_ones(spark):
    def seconds(name):
        frame = spark.range(8).select(F.repeat(F.concat(F.lit(name), F.col("id").cast("string")), F.lit(100_000)).alias("x"))
        frame = frame.select(F.sum(F.length(T.decode_entities(F.col("x")))))
        frame.collect()
        start = time.time()
        frame.collect()
        return time.time() - start

    # Work per reference, not per name of the table: two thousand keys would take a hundred times as long.
    assert seconds("&zwnj;") < 4 * seconds("&amp;") + 0.5


def test_escaped_type_keys(spark):
    texts = [
        '{"\\u0040type":"Article"}', '{"@\\u0074ype": ["A", "B"], "x": {"@type": "C"}}', '{"x": "{\\"@type\\": \\"No\\"}"}', '{"@types": "No", "@type": "Yes"}',
        '[{"@t\\u0079p\\u0065":"D\\u00e9"}]',
    ]
    assert values(spark, texts, structured_data.json_ld_types) == [["Article"], ["A", "B", "C"], [], ["Yes"], ["Dé"]]
