import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from lattica.llm import simhash
from lattica.llm.components import components


def slow_fingerprint(text):
    table = {c: c + 32 for c in range(65, 91)}
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def flips(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_every_word_within_distance_two_shares_a_codeword():
    rng = random.Random(2)
    words = np.array([rng.getrandbits(23) for _ in range(500)], dtype=np.uint32)
    other = np.array([int(w) ^ (1 << a) ^ (1 << b if b != a else 0) for w in words for a, b in [(rng.randrange(23), rng.randrange(23))]], dtype=np.uint32)
    for x, y in zip(simhash.codewords(words), simhash.codewords(other), strict=True):
        assert set(x.tolist()) & set(y.tolist())


@pytest.mark.parametrize("segments", [4, 5, 6])
def test_keys_bring_every_near_pair_together(segments):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [flips(rng, x, rng.randrange(4)) for x in base]

    def sets(xs):
        key, row = simhash.keys(np.array(xs, dtype=np.uint64), segments)
        out = [set() for _ in xs]
        for k, r in zip(key.tolist(), row.tolist(), strict=True):
            out[r].add(k)
        return out

    assert all(a & b for a, b in zip(sets(base), sets(near), strict=True))


@pytest.mark.parametrize("limit", [4, 4096])
def test_spanning_is_exact(limit):
    rng = random.Random(4)
    center = rng.getrandbits(64)
    xs = list({flips(rng, center, rng.randrange(9)) for _ in range(300)})
    pairs = [(a, b) for a, b in combinations(range(len(xs)), 2) if bin(xs[a] ^ xs[b]).count("1") <= 3]
    found = simhash.spanning(np.array(xs, dtype=np.uint64), limit)
    assert set(map(frozenset, found)) <= set(map(frozenset, pairs))
    assert slow_components(len(xs), found) == slow_components(len(xs), pairs)


@pytest.mark.parametrize("segments", [None, 5])
def test_links_and_components_against_brute_force(spark, segments):
    rng = random.Random(5)
    xs = list({flips(rng, c, rng.randrange(7)) for c in [rng.getrandbits(64) for _ in range(20)] for _ in range(30)})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), k) for k, x in enumerate(xs)], "print long, node long")
    found = {r.node: r.component for r in components(simhash.links(df, segments)).collect()}
    want = slow_components(len(xs), [(a, b) for a, b in combinations(range(len(xs)), 2) if bin(xs[a] ^ xs[b]).count("1") <= 3])
    assert [found.get(k, k) for k in range(len(xs))] == want


def test_components_of_long_paths_and_loops(spark):
    rng = random.Random(6)
    names = rng.sample(range(1000), 60)
    edges = [(names[k], names[k + 1]) for k in range(59)] + [(5000, 5000), (7000, 6000), (7000, 6000), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: min(names) for n in names} | {7000: 6000, 6000: 6000}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    want = slow_components(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if bin(prints[a] ^ prints[b]).count("1") <= 3])
    low = {}
    for r, c in zip(rows, want, strict=True):
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    expected = {(r.doc_id, f"{p:016x}", low[c]) for r, p, c in zip(rows, prints, want, strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == expected


def test_edges_of_input(spark, edge_docs, no_docs):
    found = simhash.near_duplicates(edge_docs).collect()
    assert len(found) == edge_docs.count()
    by = {r.doc_id: r for r in found}
    assert by[0].component_id == by[1].component_id == by[2].component_id == 0 and by[0].fingerprint == "0" * 16
    assert by[5].component_id == by[6].component_id == 5 and by[None].component_id is None
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and ids.count(None) == 1 and 6 not in ids and 5 in ids and 1 not in ids
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0
