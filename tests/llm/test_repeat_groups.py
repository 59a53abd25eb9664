"""Maximal repeats against all substrings."""

import random
from collections import defaultdict

import pytest

from quire.llm.repeat_groups import repeat_groups

SCHEMA = "doc_id long, text string"


def brute(texts: list[bytes], least: int) -> set[tuple[bytes, frozenset[tuple[int, int]]]]:
    places = defaultdict(list)
    for d, t in enumerate(texts):
        for s in range(len(t)):
            for e in range(s + least, len(t) + 1):
                places[t[s:e]].append((d, s))
    found = set()
    for string, at in places.items():
        before = {texts[d][s - 1] if s else ("edge", d) for d, s in at}
        after = {texts[d][s + len(string)] if s + len(string) < len(texts[d]) else ("edge", d) for d, s in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            found.add((string, frozenset(at)))
    return found


def groups(spark, texts: list[str], least: int, gram: int) -> set[tuple[bytes, frozenset[tuple[int, int]]]]:
    rows = repeat_groups(spark.createDataFrame(list(enumerate(texts)), SCHEMA), least, gram).collect()
    members, sizes = defaultdict(list), {}
    for r in rows:
        members[r["group_id"]].append((r["doc_id"], r["start"]))
        assert sizes.setdefault(r["group_id"], (r["n_bytes"], r["n_occurrences"])) == (r["n_bytes"], r["n_occurrences"])
    out = set()
    for g, at in members.items():
        n, count = sizes[g]
        strings = {texts[d].encode()[s : s + n] for d, s in at}
        assert len(strings) == 1 and len(at) == len(set(at)) == count
        out.add((strings.pop(), frozenset(at)))
    assert len(out) == len(members)
    return out


@pytest.mark.parametrize(("seed", "letters", "least", "gram"), [(1, "ab", 10, 8), (2, "abc", 9, 8), (3, "abé", 12, 8)])
def test_random_texts(spark, seed, letters, least, gram):
    r = random.Random(seed)
    parts = ["".join(r.choices(letters, k=r.randrange(3, 25))) for _ in range(8)]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 5))) for _ in range(24)]
    want = brute([t.encode() for t in texts], least)
    assert len(want) > 10
    assert groups(spark, texts, least, gram) == want


def test_long_repeats_nest(spark):
    r = random.Random(4)
    a, b, c = ("".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in (300, 400, 70))
    texts = [f"1{a}{b}2", f"3{a}{b}4", f"5{a}6", f"7{b}8", f"{c}{c}", "short", c]
    found = groups(spark, texts, 50, 24)
    assert found == brute([t.encode() for t in texts], 50)
    assert {len(s) for s, _ in found} == {300, 400, 700, 70}


def test_edge_cases(spark):
    assert repeat_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "a passage of fifty bytes or more that two rows of the table hold, as copies do"
    rows = [(None, text), (None, text), (1, None), (2, ""), (3, f"x{text}"), (3, f"y{text}"), (3, f"y{text}")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as start", "2 as `window`")
    got = sorted((r["doc_id"] or 0, r["start"], r["n_bytes"], r["n_occurrences"]) for r in repeat_groups(df).collect())
    assert got == [(0, 0, len(text), 3), (3, 1, len(text), 3), (3, 1, len(text), 3)]
    run = "a" * 54
    assert groups(spark, [run], 50, 24) == brute([run.encode()], 50)
