import re
from collections import Counter

import pytest
from corpora import frame

from quire.llm.substring_dedup import SuffixAutomaton, substring_dedup
from quire.llm.suffix_dedup import deep_intervals, maximal_repeats, suffix_dedup, without_repeats

SMALL = {"chunk_bytes": 3000, "shard_bytes": 8000}


def words_removed(rows, length=20):
    seen, out = set(), {}
    for d, x in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g))
    return out


def bytes_removed(rows, length=50):
    first, out = {}, {}
    for d, x in sorted(rows):
        b = (x or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i : i + length], d) < d:
                gone[i : i + length] = b"\1" * length
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(a for a, g in zip(b, gone, strict=True) if not g))
    return out


def characters_left(rows, length=50):
    """(id, text) of what stays when a character goes with the last of its bytes; null ids are one document that comes last."""
    first, out = {}, []
    for d, x in sorted(((1 << 63 if d is None else d, x) for d, x in rows), key=lambda r: (r[0], r[1] or "")):
        b = (x or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i : i + length], d) < d:
                gone[i : i + length] = b"\1" * length
        left, at = [], 0
        for c in x or "":
            size = len(c.encode())
            if not all(gone[at : at + size]):
                left.append(c)
            at += size
        if left or not b:
            out.append((None if d == 1 << 63 else d, None if x is None else "".join(left)))
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_words_match_brute_force(docs, rows, hot):
    got = {r.doc_id: r for r in substring_dedup(docs, hot=hot, **SMALL).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in got.items()} == words_removed(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got.values())
    assert sum(r.n_removed for r in got.values()) > 0


@pytest.mark.parametrize("hot", [512, 1])
def test_bytes_match_brute_force(docs, rows, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, hot=hot, **SMALL).collect()}
    assert got == bytes_removed(rows)


def test_characters_stay_whole(spark, docs, rows):
    got = without_repeats(docs, **SMALL).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(characters_left(rows))
    for r in got:
        assert r.lang == ("en", None, "de")[r.doc_id % 3] and r.n_words == "x" and (r.text is None or r.n_chars == len(r.text))
    # two rows in three without an id, some of them repeated
    lost = [(None if d % 2 else d, t) for d, t in rows] + [(None, t) for _, t in rows[:9]]
    got = without_repeats(frame(spark, lost), **SMALL).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(characters_left(lost))


def test_empty_and_null_ids(spark, nothing):
    assert substring_dedup(nothing).count() == 0 and suffix_dedup(nothing).count() == 0
    text = " ".join(f"w{k}" for k in range(40))
    odd = frame(spark, [(None, text), (7, text), (7, text)])
    assert sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(odd).collect()) == [(False, 0), (False, 40), (True, 40)]
    assert sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup(odd).collect()) == [(False, 0), (False, 0), (True, len(text))]


def test_long_document(spark):
    text = " ".join(f"w{k % 7919}" for k in range(60_000))
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, [(1, text)])).collect()}
    assert got == {1: 60_000 - 7919}


def test_automaton_finds_first_ends():
    import random

    random.seed(2)
    strings = [[random.randint(0, 2) for _ in range(random.randint(3, 12))] for _ in range(30)]
    automaton = SuffixAutomaton()
    for k, s in enumerate(strings):
        automaton.add(s, 100 * k)
    automaton.settle()
    for s in strings:
        ends = automaton.first_ends(s, 3)
        for i, end in enumerate(ends):
            assert end == min(100 * k + j + 2 for k, t in enumerate(strings) for j in range(len(t) - 2) if t[j : j + 3] == s[i : i + 3])


def test_maximal_repeats_have_all_occurrences():
    import numpy as np

    assert deep_intervals([0, 2, 3, 3, 1], 2) == [(1, 3, 3), (0, 3, 2)]
    strings = [b"xabcabc\0", b"yabcabc\0\0", b"zabcab"]
    r = maximal_repeats(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), 3)
    found = {}
    for a, b, n in zip(r.left, r.right, r.size, strict=True):
        at = [(int(r.fragment[k]), int(r.offset[k])) for k in r.order[a : b + 1]]
        text = strings[at[0][0]][at[0][1] : at[0][1] + n]
        found[text] = sorted(at)
    for text, at in found.items():
        assert at == sorted((k, i) for k, s in enumerate(strings) for i in range(len(s)) if s[i : i + len(text)] == text)
    assert b"abc" in found and b"abcab" in found and b"abcabc\0" in found
