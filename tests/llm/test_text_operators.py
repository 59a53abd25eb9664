import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpora import frame
from tokenizers import Tokenizer

import quire.llm.sharding as module_of_sharding
from quire.llm.bpe import SpeculativeBpe, bpe
from quire.llm.decontaminate import decontaminate, without_contaminated
from quire.llm.packing import best_fit_decreasing, encoding, packing, read_ids, write_ids
from quire.llm.quality_classifier import quality_classifier
from pyspark.sql import functions as F
from quire.llm.quality_rules import CELLS, RATES, VALLEY, limits, quality_rules
from quire.llm.sharding import Group, ShardMap, Slot, sharding
from quire.llm.toxicity import isotonic, toxicity

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LABELS = "doc_id long, quality int, toxic int"


# decontamination
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(rows, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    out = {}
    for d, t in rows:
        w, hit, ids = item_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    ids |= found
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), ids)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, rows, block_bytes):
    texts = [t for _, t in rows if t and len(t) > 200]
    items = [(1, " ".join(texts[0].split()[3:30]).upper()), (2, texts[1][:150]), (2, "no no no"), (3, "one"), (4, None), (5, "..."), (None, " ".join(texts[2].split()[:12])), (6, "b, C"), (7, texts[0])]
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, hits int")
    got = {r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hits), set(r["items"])) for r in decontaminate(docs, benchmark, block_bytes=block_bytes).collect()}
    assert got == brute_hits(rows, items)
    kept = without_contaminated(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, x in got.items() if not x[1]}


def test_decontamination_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(nothing, none).count() == 0
    assert all(not r.hits for r in decontaminate(docs, none).collect())


# tokens
def hard_texts():
    rnd = random.Random(1)
    out = ["", "<|startoftext|>Hello's WORLD <|endoftext|> x<|startoftext|>", "a\x1cb \x1f c", "İstanbul ΣΊΣΥΦΟΣ", " é é x", "12345 ½ ² don't I'LL we'vE", "x　y​z\x85m", "日本語 😀👨‍👩‍👧 </w>", "a" * 3000, "ab" * 700 + " " + "!?" * 600]
    out += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéñß '!?.,#0123ŽДΣ中́\n") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    return out


def test_bpe_agrees_with_the_library():
    ours, library = SpeculativeBpe(open(VOCABULARY, encoding="utf-8").read()), Tokenizer.from_file(VOCABULARY)
    tokens = list(library.get_vocab())
    texts = hard_texts() + [a.replace("</w>", " ") + b.replace("</w>", "") for a, b in zip(random.Random(3).sample(tokens, 800), random.Random(4).sample(tokens, 800), strict=True)]
    for text, (ids, decoded) in zip(texts, ours.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected and decoded == library.decode(expected, skip_special_tokens=False), text
    assert 0 < ours.merged < ours.checked
    assert ours._merge_long(ours.symbols("abcabcabz" * 9)) == ours.merge(ours.symbols("abcabcabz" * 9))


def test_bpe_cache_is_bounded(monkeypatch):
    import quire.llm.bpe as module

    monkeypatch.setattr(module, "MOST_PIECES", 50)
    ours, texts = SpeculativeBpe(open(VOCABULARY, encoding="utf-8").read()), hard_texts()
    once = ours.encode(texts)
    other = SpeculativeBpe(open(VOCABULARY, encoding="utf-8").read())
    assert [other.encode([t])[0] for t in texts] == once and len(other.pieces) < 200


def test_bpe_query(docs, rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.n_words) for r in bpe(docs, VOCABULARY, carry=("n_words",)).collect()}
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    assert got == {d: (len(x), x, "x") for d, x in ids.items()}
    assert bpe(nothing, VOCABULARY).count() == 0


def test_packing_loses_nothing(spark, docs, rows, nothing, tmp_path):
    encode = encoding(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    packed = packing(docs, RANKS, public_tokenizers.PATTERN, length=64, bucket_bytes=6000).cache()
    pieces, sequences = defaultdict(dict), packed.collect()
    for r in sequences:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == 64 and r.cu_lengths[0] == 0 and r.cu_lengths[-1] == r.n_tokens and set(ids[r.n_tokens :]) <= {encode.max_token_value + 1}
        assert r.resets == r.cu_lengths[:-1] == [k for k in range(r.n_tokens) if positions[k] == 0]
        for s, a, b in zip(r.segments, r.cu_lengths, r.cu_lengths[1:], strict=False):
            assert s.n == b - a and positions[a:b].tolist() == list(range(s.n))
            pieces[s.doc_id][s.offset] = ids[a:b].tolist()
    joined = {d: encode.decode([t for at in sorted(p) for t in p[at]]) for d, p in pieces.items()}
    assert joined == {d: t for d, t in rows if t}
    assert packing(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    # the same matrices as plain files
    path = str(tmp_path / "ids")
    write_ids(packed, path)
    files = {(r.bucket, r.name): np.frombuffer(r.content, "<u4").reshape(-1, 64) for r in read_ids(spark, path).collect()}
    assert len(files) == 2 * len({r.bucket for r in sequences})
    assert all((files[r.bucket, "ids"][r.row] == np.frombuffer(r.ids, "<u4")).all() and (files[r.bucket, "positions"][r.row] == np.frombuffer(r.positions, "<u4")).all() for r in sequences)
    index = {(r.bucket, r.row): r.cu_lengths for r in spark.read.parquet(f"{path}/index").collect()}
    assert index == {(r.bucket, r.row): r.cu_lengths for r in sequences}


@pytest.mark.parametrize("same", [None, 7])
def test_one_id_in_most_rows_is_packed_in_many_buckets(spark, rows, same):
    texts = [t for _, t in rows] + [t for _, t in rows[:5]]
    packed = packing(frame(spark, [(same, t) for t in texts]), RANKS, public_tokenizers.PATTERN, length=64, bucket_bytes=6000).collect()
    encode = encoding(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    assert len({r.bucket for r in packed}) > 5 and {s.doc_id for r in packed for s in r.segments} == {same}
    given = Counter(x for t in texts for x in encode.encode_ordinary(t or ""))
    assert Counter(x for r in packed for x in np.frombuffer(r.ids, "<u4")[: r.n_tokens].tolist()) == given


def test_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(200):
        length = rnd.randint(1, 40)
        sizes, bins = [rnd.randint(1, length) for _ in range(rnd.randint(0, 60))], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [b for b in bins if b[0] >= sizes[k]]
            if fits:
                min(fits, key=lambda b: b[0])[0] -= sizes[k]
            else:
                bins.append([length - sizes[k]])
        got = best_fit_decreasing(sizes, length)
        assert sorted(sum(sizes[k] for k in g) for g in got) == sorted(length - b[0] for b in bins)
        assert sorted(k for g in got for k in g) == list(range(len(sizes)))


# sharding
def test_shards(spark, docs, rows, nothing):
    got = sharding(docs, shards=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.place for r in x) == list(range(len(x))) for x in by.values())
    loads = [sum(r["size"] for r in x) for x in by.values()]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)
    of, shard = {d: t or "" for d, t in rows}, defaultdict(set)
    for r in got:
        shard[of[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in shard.values())  # equal texts stay together
    assert sharding(nothing).count() == 0


def test_groups_stay_whole_up_to_a_fair_share(spark):
    rows = [(k, "copy " * 20) for k in range(100)] + [(1000 + k, f"text {k} " * 20) for k in range(300)]
    got = sharding(frame(spark, rows), shards=4).collect()
    assert len({r.shard for r in got if r.doc_id < 1000}) == 1
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.05 * min(loads.values())


def test_a_hot_group_of_copies_is_parted(spark):
    rows = [(k, "copy " * 20) for k in range(300)] + [(1000 + k, f"text {k} " * 20) for k in range(300)]
    got = sharding(frame(spark, rows), shards=4).groupBy("shard").agg({"size": "sum"}).collect()
    assert max(r[1] for r in got) < 1.1 * min(r[1] for r in got)


@pytest.mark.parametrize("same", [None, 7])
def test_one_id_in_most_rows(spark, monkeypatch, same):
    monkeypatch.setattr(module_of_sharding, "BIN", 40)  # several bins of places
    rows = [(same, "copy " * 20)] * 300 + [(same, f"text {k} " * 20) for k in range(300)] + [(k, None) for k in range(100)]
    got = sharding(frame(spark, rows), shards=4).collect()
    assert len(got) == 700
    for s in range(4):
        assert sorted(r.place for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_rebalancing_moves_little(spark, docs, tmp_path):
    rnd = random.Random(2)
    slots = [Slot(k, rnd.randint(1, 1000), 3) for k in range(500)]
    first = ShardMap.deal(slots, 8, (Group(5, 498, 2),))
    grown = first.rebalanced(slots, 9)
    moved = [k for k in first.shard_of if first.shard_of[k] != grown.shard_of[k]]
    assert grown.version == 2 and {grown.shard_of[k] for k in moved} <= {8} | set(range(8)) and len(moved) < 120
    load = Counter()
    for s in slots:
        load[grown.shard_of[s.slot]] += s.bytes
    assert max(load.values()) < 1.05 * sum(load.values()) / 9
    same = first.rebalanced(slots)
    assert same.shard_of == first.shard_of
    first.write(spark, str(tmp_path / "map"))
    grown.write(spark, str(tmp_path / "map"))
    assert ShardMap.read(spark, str(tmp_path / "map")) == grown and ShardMap.read(spark, str(tmp_path / "map"), 1) == first


def test_the_stored_map_is_kept_and_edited(spark, docs, tmp_path):
    path = str(tmp_path / "map")
    shards = lambda n: {r.doc_id: r.shard for r in sharding(docs, n, path=path).collect()}
    first, again, more = shards(4), shards(4), shards(5)
    assert first == again and first.keys() == more.keys() and len(set(more.values())) == 5
    assert sum(first[k] != more[k] for k in first) < len(first) / 2
    assert ShardMap.read(spark, path).version == 3


# quality rules
def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c, rep, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), [0] * len(w), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            rep[i : i + 3] = [1, 1, 1]
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(rep)


def test_base_features(docs, rows, nothing):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules(nothing).count() == 0


def test_limits_follow_their_group(spark):
    clean = [" ".join(f"w{k:03}x{j:02}" for j in range(60)) for k in range(120)]
    marked = [t.replace(" ", " # ", 12) for t in clean]
    rows = [(2 * k, t) for k, t in enumerate(clean)] + [(2 * k + 1, t) for k, t in enumerate(marked)]  # source s0 without, s1 with symbols
    rows += [(10_000, marked[0] + " tail"), (10_001, marked[1].replace("w", "#####w"))]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows), prior=5).collect()}
    assert all(got[d].kept for d, _ in rows[:240]) and not got[10_000].kept and not got[10_001].kept
    assert got[0].most_symbol_rate < got[1].most_symbol_rate


def test_sketches_are_exact_to_a_cell(spark, docs):
    """Limits against quantiles of the rates themselves, mixed as the docstring says."""
    got = quality_rules(docs).collect()
    keep = [(r, docs_of) for r in got if not r.base_failed for docs_of in [r.doc_id]]
    source = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    for rate in RATES:
        cells = defaultdict(list)
        for r, d in keep:
            cells[source[d]].append(r[rate.name])

        def share(cell, lang, src):
            every = [x for v in cells.values() for x in v]
            own = [x for (a, _), v in cells.items() if a == lang for x in v]
            p = sum(x <= cell for x in every) / len(every)
            p = (sum(x <= cell for x in own) + 50 * p) / (len(own) + 50)
            return (sum(x <= cell for x in cells[lang, src]) + 50 * p) / (len(cells[lang, src]) + 50)

        def share_of(cell, lang):
            every, own = ([x for (a, _), v in cells.items() if a == lang or whole for x in v] for whole in (True, False))
            return (sum(x <= cell for x in own) + 50 * sum(x <= cell for x in every) / len(every)) / (len(own) + 50)

        grid = sorted({x for v in cells.values() for x in v})
        for lang, src in list(cells):
            high, mid = (next(c for c in grid if share(c, lang, src) >= q - 1e-12) for q in (rate.level, 0.5))
            limit = {r["most_" + rate.name] for r, d in keep if source[d] == (lang, src)}
            bulk = next(c for c in grid if share_of(c, lang) >= 0.5)
            most = next(c for c in grid if c >= bulk and share_of(c + rate.gap, lang) - share_of(c, lang) < VALLEY)
            own = min(CELLS, high + rate.reach * (high - mid))
            assert limit == {min(own, most) if mid <= most else own}


@pytest.mark.parametrize("share", [5, 15, 30])
def test_junk_in_a_source_lifts_no_limit(spark, share):
    rnd = random.Random(share)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    rows, junk = [], set()
    for k in range(600):
        w = [word() for _ in range(rnd.randint(60, 120))]
        if k % 100 < share:
            junk.add(2 * k)
            w = [x + "##$"[: max(1, len(x) // 3)] for x in w] if k % 2 else [*w[:30], *w[:30], *w[30:]]  # a third of symbols, or a passage twice
        elif k % 7 == 0:
            w[9] += "#"
        rows.append((2 * k, " ".join(w)))
    got = {r.doc_id: r.kept for r in quality_rules(frame(spark, rows)).collect()}  # one source
    assert sum(not got[d] for d in junk) >= 0.9 * len(junk)
    assert sum(not v for d, v in got.items() if d not in junk) <= 0.01 * (600 - len(junk))


def test_many_sources(spark):
    """Quantiles follow the cells that sources have, not a grid for each."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), (F.col("id") % 10_000).cast("string").alias("source"), F.lit(False).alias("base_failed"), *((F.col("id") % (7 + k)).alias(r.name) for k, r in enumerate(RATES)))
    assert limits(rows).count() == 10_000


# classifiers
def labelled(spark, n=240):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for d in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))]
        bad, toxic = d % 4 == 0, d % 5 == 1
        if bad:
            w = [x.upper() + "!!" for x in w] if d % 8 else [x + "$$$" for x in w]
        if toxic:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["idiot", "moron", "blorf"])
        rows.append((d, " ".join(w)))
        labels.append((d, int(not bad), int(toxic)))
    labels += [(None, 1, 0), (3, None, None), (3, 1, 0), (99_999, 0, 1)]
    return frame(spark, [*rows, (n + 1, None), (n + 2, ""), (None, "plain text")]), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize(("classify", "column", "fold"), [(quality_classifier, "quality", (4, 2)), (toxicity, "toxic", (5, 0))])
def test_classifiers(spark, nothing, classify, column, fold):
    import zlib

    docs, labels = labelled(spark)
    rows = classify(docs, labels).collect()
    truth = {r.doc_id: r[column] for r in labels.where(f"{column} is not null").collect()}
    right = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and len(right) > 20 and sum(right) >= 0.95 * len(right)
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1])
    assert classify(nothing, labels).count() == 0
    none = labels.where("false")
    assert len({r.score for r in classify(docs, none).collect()}) == 1
    again = {r.doc_id: r.score for r in classify(docs.repartition(3), labels).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    import zlib

    docs, labels = labelled(spark)
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality, r.toxic) for r in labels.collect()], LABELS)
    scores = lambda x: {r.doc_id: r.score for r in quality_classifier(docs, x).collect()}
    assert scores(labels) == scores(turned)


def test_isotonic():
    x, y = isotonic(np.array([0.0, 1, 2, 3, 3]), np.array([0.0, 1, 0, 1, 1]))
    assert list(np.interp([0, 1, 2, 3], x, y)) == [0, 0.5, 0.5, 1]


def test_words_are_normalised_as_unicode():
    assert unicodedata.normalize("NFC", "é") == "é"
