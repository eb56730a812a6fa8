import itertools
import random

import numpy as np
import xxhash

from pagegauge.llm import simhash
from pagegauge.llm.common import components
from tests.llm.conftest import documents


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits):
    """Smallest index reachable over pairs of at most ``bits`` different bits, by looking at all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, small):
    docs = small("documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    root = classes(fps, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fps[i]:016x}", rows[root[i]][0]) for i, (d, _) in enumerate(rows)}


def test_links_connect_what_all_pairs_do(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = {s for s in seeds}
    for s in seeds:
        for _ in range(150):
            f = s
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64 if rng.random() < 0.3 else 12)
            fps.add(f)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), 2)
    edges = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    groups = {}
    for r in components(found, "test").collect():
        groups.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for f, c in zip(fps, classes(fps, 2), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_dense_posting_list():
    """A list with thousands of members in the two free bytes: connected, verified and without all pairs."""
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 16, 5000)).astype(np.uint64) | np.uint64(7 << 40)
    (edges,) = simhash._bucket_edges([values], [(0, 1)], 2)
    assert len(edges) < len(values)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    chosen = values[:300]
    (few,) = simhash._bucket_edges([chosen], [(0, 1)], 2)
    index = {int(v): i for i, v in enumerate(chosen)}
    root = classes([int(v) for v in chosen], 2)
    linked = [set() for _ in chosen]
    for a, b in few:
        linked[index[a]].add(index[b]), linked[index[b]].add(index[a])
    seen = {}
    for i in range(len(chosen)):
        if i not in seen:
            stack = [i]
            while stack:
                j = stack.pop()
                if j not in seen:
                    seen[j] = i
                    stack += linked[j]
    assert [seen[i] for i in range(len(chosen))] == root


def test_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)} and by[2] == {(f"{plain_fingerprint(edge_rows[0][1]):016x}", 1)}
    assert ("0" * 16, 3) in by[None] and (f"{plain_fingerprint(edge_rows[5][1]):016x}", None) in by[None]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    assert ids == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (False, 10), (True, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
