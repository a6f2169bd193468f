"""op4: fingerprints by the letter of the contract, components by all pairs."""

import re

import numpy as np
import pytest
import xxhash
from codequarry.llm import graph, queries, simhash
from codequarry.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(prints):
    """Least index reachable, of distinct fingerprints, by all pairs."""
    root = list(range(len(prints)))
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    changed = True
    while changed:
        new = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(root))]
        changed, root = new != root, new
    return root


def check(rows, got):
    """rows: (doc_id, text); got: doc_id, fingerprint, component_id."""
    prints = sorted({print_of(t) for _, t in rows})
    root = dict(zip(prints, components(prints)))
    least = {}
    for d, t in rows:
        key = root[print_of(t)]
        if d is not None:
            least[key] = min(d, least.get(key, d))
    want = [(d, print_of(t), least.get(root[print_of(t)])) for d, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_registered(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.op4_simhash_near_dedup(spark, SF).collect()])


def test_edges(spark):
    rows = [(1, None), (5, ""), (None, "\t "), (None, "alone without id"), (2, "One two"), (3, "one TWO"), (3, "one two"), (4, "É é"), (6, "é É"), (7, "w " * 100_000), (8, "a b c d"), (9, "a b c d e")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df, Scratch(spark))
    check(rows, [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got.collect()])
    assert simhash.near_duplicates(df.where("false"), Scratch(spark)).collect() == []


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_no_link_is_lost(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    g = np.random.default_rng(5)
    prints = set()
    for _ in range(120):
        x = int(g.integers(0, 2**64, dtype=np.uint64))
        for _ in range(4):
            prints.add(x)
            for b in g.choice(64, int(g.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    got = {r["node"] % 2**64: r["root"] for r in simhash.link_fingerprints(df, 4, Scratch(spark)).collect()}
    want = components(prints)
    groups = {}
    for p, r in zip(prints, want):
        groups.setdefault(r, []).append(p)
    for members in groups.values():
        roots = {got.get(p) for p in members}
        assert roots == {None} if len(members) == 1 else len(roots) == 1 and None not in roots
    assert len({got[m[0]] for m in groups.values() if len(m) > 1}) == sum(len(m) > 1 for m in groups.values())


def test_masks_cover_every_difference():
    g = np.random.default_rng(2)
    family = [m % 2**64 for m in simhash.masks(4, list(range(64)))]
    for _ in range(3000):
        d = sum(1 << int(b) for b in g.choice(64, 4, replace=False))
        assert any(m & d == 0 for m in family)


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(10_000, 10_060)] + [(7, 7), (5, 0)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(3000)} | {i: 10_000 for i in range(10_000, 10_061)}
