"""Two tokenizers' tokens against a plain version: sets of end offsets, and all pairs within a group."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import alignment as module
from quire.llm.alignment import alignment
from quire.llm.bpe import byte_characters
from quire.llm.queries import PIECES, QUERIES, RANKS

SCHEMA = "doc_id long, text string, lang string, n_a string, chunk int, `key` int"


@cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


@cache
def tokens(text):
    """(A ids, their bytes, B ids, their bytes) as the libraries give them."""
    a, b = libraries()
    byte = {c: b for b, c in enumerate(byte_characters())}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    found = b.encode(text)
    of = lambda k: bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    return ids, [bytes(byte[c] for c in a.id_to_token(k)) for k in ids], found, [of(k) for k in found]


def between(a, b, ends, last, cut):
    """For long texts: the same, found by bisection."""
    return tuple(ids[bisect_right(own, last) : bisect_right(own, cut)] for ids, own in ((a, ends[0]), (b, ends[1])))


def plain(texts):
    """A row for each text."""
    held, out = Counter(), []
    for text in texts:
        groups = []
        if text:
            a, a_bytes, b, b_bytes = tokens(text)
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = []
                for parts in (a_bytes, b_bytes):
                    at, own = 0, []
                    for p in parts:
                        at += len(p)
                        own.append(at)
                    ends.append(own)
                last = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([i for i, e in zip(ids, own, strict=True) if last < e <= cut] for ids, own in ((a, ends[0]), (b, ends[1]))) if len(a) < 3000 else between(a, b, ends, last, cut))
                    last = cut
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        out.append((groups, links))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for groups, links in out:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


def cases():
    rnd = random.Random(3)
    words = ["the", "Straße", "日本語", "naïve", "x" * 40, "don't", "12345", "🙂👍🏽", "<|endoftext|>", "<s>", "<0x41>", "á", "é", "\t", "\r\n", "   ", "…", "İ", " ", "re-use", "👩‍👩‍👧"]
    texts = ["", None, " ", "a", " a", "▁x", "a\x00b", "\n\n\n", "<unk>", "<0x0A>", "the the the", "the the the", "　wide", "x" * 3000, "ab" * 2000, " " * 700]
    texts += [rnd.choice(["", " "]).join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(25)]
    return texts + [" ".join(rnd.choice(words) for _ in range(6000)), texts[-1], texts[-1]]


def rows_of(found):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()]


@pytest.mark.parametrize("run", [16_384, 7])
def test_matches_the_plain_version(spark, monkeypatch, run):
    texts = cases()
    ids = [None if k % 9 == 4 else k // 2 for k in range(len(texts))]  # null ids and ids that two rows share
    given = [(d, t, "en", "x", 1, 2) for d, t in zip(ids, texts, strict=True)]
    monkeypatch.setattr(module, "RUN", run)
    if run < 100:  # small runs, many sweeps and chunks; workers import the module anew, so the stages run here
        a, b = module.ByteLevel(open(RANKS, "rb").read(), public_tokenizers.PATTERN), module.Pieces(open(PIECES, "rb").read())
        machine, found = module.Sweep(a.vocabulary, b.vocabulary), []
        monkeypatch.setattr(module, "SWEEP", 50)
        for text, _, side, ids_of in sorted(module.event_runs(texts, a, b), key=lambda x: x[:3]):
            machine.run((text,), text, side, ids_of)
            found += machine.finished()
        found += machine.finished(last=True)
        got = [(d.n_a, d.n_b, d.n_groups, d.n_links, d.digest.hexdigest() if d.digest else "") for d in sorted(found, key=lambda d: d.doc_id)]
        assert got == [(*r[:4], r[6]) for r in plain(texts)]
        return
    found = alignment(spark.createDataFrame(given, SCHEMA).repartition(3), RANKS, public_tokenizers.PATTERN, PIECES)
    expected = [(d, *r) for d, r in zip(ids, plain(texts), strict=True)]
    assert sorted(rows_of(found), key=str) == sorted(expected, key=str)


def test_copies_in_a_third_of_all_rows(spark):
    given = [(k, "one and the same text" if k % 3 == 0 else f"text {k}", "en", "x", 1, 2) for k in range(300)]
    found = {r.doc_id: r for r in alignment(spark.createDataFrame(given, SCHEMA), RANKS, public_tokenizers.PATTERN, PIECES).collect()}
    assert len(found) == 300 and len({(found[k].count_sum, found[k].groups_sha256) for k in range(0, 300, 3)}) == 1


def test_empty_table(spark):
    assert rows_of(alignment(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN, PIECES)) == []


def test_query(spark, tmp_path):
    spark.createDataFrame([(7, "the cat"), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_alignment"](spark, str(tmp_path)).where(F.col("doc_id") == 8).collect()
    assert [tuple(r) for r in found] == [(8, 0, 0, 0, 0, 0, 0, "")]
