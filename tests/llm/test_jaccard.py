import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from corpora import frame

import quire.llm.jaccard_join as join
from quire.llm.components import components


def shingles(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in join.jaccard_join(df, chunk_bytes=4000, shard_bytes=9000, **options).collect()}


@pytest.mark.parametrize("percent", [80, 50, 95])
def test_matches_brute_force(docs, rows, percent):
    assert got(docs, percent=percent) == brute(rows, percent)


def test_chains_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(join, "CELL", 16)  # large cells are compared in blocks
    rnd = random.Random(9)
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(120):
        body = list(base) if k % 3 else base[: rnd.randint(5, 150)]
        for _ in range(rnd.randint(0, 6)):
            body[rnd.randrange(len(body))] = f"v{rnd.randrange(40)}"
        rows.append((k * 2, " ".join(body).upper() if k % 7 == 0 else " ".join(body)))
    assert got(frame(spark, rows)) == brute(rows)


def test_small_sets(spark):
    rows = [(k, t) for k, t in enumerate(["a", "A", "a b", "a b c d e", "a b c d e f", "a b c d e f g h i j", "b c d e f g h i j", "a b c d e f g h i", "", None, " "])]
    assert got(frame(spark, rows)) == brute(rows)


def test_empty_and_null_ids(spark, nothing):
    assert got(nothing) == {}
    odd = frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "x"), (6, "x")])
    rows = sorted((r.doc_id or 0, r.component_id) for r in join.jaccard_join(odd).collect())
    assert rows == [(0, 4), (4, 4), (4, 4), (6, 4)]


def test_overlaps_sum_over_columns():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 300, 80)).astype(np.uint64) for _ in range(12)]
    doc = np.repeat(np.arange(12), [len(s) for s in sets])
    found = join.overlaps(np.concatenate(sets), doc, 12, columns=17)
    assert all(found[a, b] == len(np.intersect1d(sets[a], sets[b])) for a, b in combinations(range(12), 2))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200 + k) for k in range(30)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_group_by_size():
    bounds = join.size_classes(500, 80)
    groups = defaultdict(set)
    for n in range(1, 501):
        c = int(np.searchsorted(bounds, n))
        groups[n] = {c, c + 1}
    assert all(groups[a] & groups[b] for a in range(1, 401) for b in range(a, a * 100 // 80 + 1))
