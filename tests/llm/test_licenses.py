import re

from pagegauge.llm import licenses
from pagegauge.llm.common import folded_words
from tests.llm.conftest import documents

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(docs, got):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in [plain(t) for t in texts[r.doc_id]]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_given_documents(spark, small):
    docs = small("documents")
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count() and sum(r.n_base for r in got) > 0
    check(docs, got)


def test_spans_and_labels(spark):
    notice = licenses.NOTICES[13].text
    broken = notice.split()
    broken[7:7] = ["really", "very"]
    del broken[20]
    rows = [
        (1, "MIT-License; mit\nLICENSE. Mit licenses MIT LICENSE", "s"),
        (2, "Licensed under CC BY-NC 4.0.", "s"), (3, "cc by cc by cc", "s"), (4, "the GNU General Public License, version 3", "s"),
        (5, f"intro words {' '.join(broken)} and so on", "s"), (6, " ".join(notice.split()[:9]), "s"), (7, "of the " * 3000, "s"),
        (8, "gnu general gnu general public license public license", "s"), (9, "GNU GENERAL É PUBLIC LICENSE", "s"),
    ]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    check(docs, got.values())
    assert got[1].n_base == 3 and got[2].labels == "cc-by,cc-by-nc" and got[4].labels == "gpl,gpl-3.0"
    assert got[3].n_base == 2 and got[7].labels == "" and got[9].n_base == 0
    # A copy with words put in and left out moves over neighbouring diagonals and is still one span.
    assert "gpl" in got[5].labels and got[5].score >= 0.8 and got[6].labels == "" and 0 < got[6].score < 0.8


def test_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    got = licenses.scan(docs).collect()
    assert len(got) == len(edge_rows) and {(r.n_base, r.labels, r.score) for r in got} == {(0, "", 0.0)}
    assert sorted(r.n_words for r in got) == sorted(len(folded_words(t)) for _, t, _ in edge_rows)
    assert licenses.scan(docs.limit(0)).count() == 0
