import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegauge.llm import line_dedup
from tests.llm.conftest import documents


def brute_force(rows, least):
    """Deletes every run of at least ``least`` words that stood earlier; rows must be in corpus order."""
    lines = [[line for line in (t or "").split("\n")] for _, t in rows]
    seen, kept = set(), []
    places = [(d, s, e) for d in range(len(lines)) for s in range(len(lines[d])) for e in range(s + 1, len(lines[d]) + 1)]
    gone = [set() for _ in lines]
    for d, s, e in sorted(places):
        run = tuple(lines[d][s:e])
        if sum(max(len(x.encode().split()), len(x) // 10) for x in run) >= least:
            if run in seen:
                gone[d] |= set(range(s, e))
            seen.add(run)
    for d, (_, t) in enumerate(rows):
        kept.append(None if t is None else "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d]))
    return kept


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b c", "d", "", "e f g", "h i j k l", "m"]
    rows = [(i, "\n".join(vocabulary[j] for j in rng.integers(0, len(vocabulary), rng.integers(1, 14)))) for i in range(60)]
    for least in (1, 4):
        out = line_dedup.dedup_lines(documents(spark, [(i, t, "s") for i, t in rows]), least, runs="deleted").collect()
        got = {r.doc_id: r.text for r in out}
        assert [got[i] for i, _ in rows] == brute_force(rows, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.integers(1, 9))
def test_windows_are_the_shortest(words, least):
    n = len(words)
    fit = [(s, e) for s in range(n) for e in range(s + 1, n + 1) if sum(words[s:e]) >= least]
    shortest = {min((e - s, s, e) for s, e in fit if s == a)[1:] for a in {s for s, _ in fit}}
    shortest |= {min((e - s, s, e) for s, e in fit if e == b)[1:] for b in {e for _, e in fit}}
    first, length = line_dedup.windows(words, least)
    assert {(int(s), int(s + n)) for s, n in zip(first, length, strict=True)} == shortest


def test_edges(spark, edge_rows):
    passage = "a passage of more than eight words that two of the documents share"
    rows = edge_rows + [(20, f"x\n{passage}\ny", "e"), (21, f"{passage}\nz", "e"), (21, f"{passage}\nz", "e")]
    docs = documents(spark, rows)
    out = line_dedup.clean(docs, 8)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert got[(20, len(f"x\n{passage}\ny"))] == f"x\n{passage}\ny" and got[(21, 1)] == "z"
    assert got[(2, 0)] == "" and got[(3, None)] is None and got[(4, 0)] == ""
    assert got[(None, len(edge_rows[5][1]))] == edge_rows[5][1]
    assert line_dedup.clean(docs.limit(0), 8).count() == 0


@pytest.mark.parametrize("least", [8])
def test_query_sql(spark, least):
    from pagegauge.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = con.execute(f"select doc_id, n_lines, n_deleted, text from ({ORACLES['op1_line_dedup']}) order by 1").fetchall()
    got = QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001").select("doc_id", "n_lines", "n_deleted", "text").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and sum(r.n_deleted for r in got) > 0


def test_long_lines_without_spaces(spark):
    lines = ["".join(chr(0x4E00 + (7 * i + 13 * j) % 3000) for i in range(380)) for j in range(7)]
    rows = [(1, "\n".join(["eins", *lines]), "s"), (2, "\n".join([*lines, "zwei"]), "s"), (3, "短い行\n" + "x" * 69, "s"), (4, "短い行\n" + "x" * 69, "s"), (5, "y" * 80, "s"), (6, "y" * 80, "s")]
    got = {r.doc_id: r.text for r in line_dedup.clean(documents(spark, rows), 8).collect()}
    assert got == {1: rows[0][1], 2: "zwei", 3: rows[2][1], 4: rows[3][1], 5: "y" * 80, 6: ""}
