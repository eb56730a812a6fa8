import pytest

# Columns that operators use inside, to see that the tables' own do not get in the way.
CLASHES = ("size", "h", "k", "tag", "pos", "u", "row", "cell", "uid", "fp", "start", "end", "kind", "spans", "runs", "copies", "rank", "first", "t", "c")


def documents(spark, rows, clashes=True):
    """(doc_id, text, source) rows as a documents table with more columns than asked for."""
    extra = CLASHES if clashes else ()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {c} string" for c in extra)
    full = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(extra)) for i, t, s in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts and ids, ties, repeated rows, long texts."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
        (3, None, "a"), (4, "", "b"), (5, "   \n\t ", None), (None, "orphan text without any id but with quite a few words in it", "b"),
        (6, "one two three", "b"), (6, "one two three", "b"), (7, "one", None), (8, long, "c"), (9, long + " end", "c"),
        (10, "é ü 漢字 🙂 naïve\nsecond line", "d"), (None, None, None),
    ]


@pytest.fixture(scope="session")
def small(spark):
    """The given tables at the smallest scale."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
