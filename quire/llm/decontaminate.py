"""Benchmark decontamination by a prefix-filtered join of shingles.

Words are runs of ASCII letters, digits and all characters from U+0080 on, A-Z
in lower case. A window is `window` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. A document's word is hit when
it lies in an occurrence of a window.

A window can only occur where all its shingles of `shingle` words do, so its
necessary prefix is its rarest shingle in the order of corpus frequency, which
one pass over all documents counts. A second pass joins the documents' shingles
with these, drops candidates that don't fit in (positional and length bounds),
and compares the remaining windows with the document word by word.

The benchmark is taken in blocks of at most `block_bytes` of item text, one after
the other: a block's windows (some ten times its bytes, all in numpy arrays) are
broadcast, its hits are written to the checkpoint folder, and the broadcast is
released before the next block is read. A benchmark of one block, as almost all
are, needs no writing; in others only documents with hits are written and joined.

Null, empty or wordless texts and items have no words. Items that share an
item_id are one; a null item_id is an id of its own that is left out of id lists.
Repeated documents are judged each; a null doc_id is a value like others. Of
equally rare shingles a window's first is its prefix. Very long texts are taken
whole, in a block of their own. Extra columns are ignored, or carried under
their names, whatever these are. An empty benchmark hits nothing; an empty table
of documents gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._rounds import cut, plain_names, shuffles_dropped
from quire.llm._text import LOWER, NOT_ALNUM, U64, Words, blocks, covered, grams, hash_words, inside, pair, split_words, spread, text_bytes

BITS = U64((1 << 22) - 1)


@dataclass
class Windows:
    """Distinct windows of a block of items in the order of their prefix shingles' hashes."""

    low: np.ndarray  # bytes of the items
    word_start: np.ndarray
    word_end: np.ndarray
    first: np.ndarray  # first word
    length: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray
    offset: np.ndarray  # of the prefix in the window
    shingle: np.ndarray  # words in the prefix
    item_at: np.ndarray  # bounds of each window's items in `item`
    item: np.ndarray  # places in `ids`
    ids: list[int | None]

    def words(self, k: int) -> list[bytes]:
        at = range(int(self.first[k]), int(self.first[k] + self.length[k]))
        return [self.low[self.word_start[i] : self.word_end[i]].tobytes() for i in at]

    def of(self, k: int) -> list[int | None]:
        return [self.ids[i] for i in self.item[self.item_at[k] : self.item_at[k + 1]]]


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray]:
    low = LOWER[buf]
    w = split_words(low, offs, NOT_ALNUM)
    return low, w, hash_words(low, w.start, w.end)


def _sized(h: np.ndarray, n: int) -> np.ndarray:
    """grams() that differ for different n."""
    return pair(grams(h, n), np.full(max(len(h) - n + 1, 0), n, U64))


def _item_windows(items: pa.Table, window: int, shingle: int, counts: Callable[[np.ndarray, list[int]], np.ndarray]) -> Windows:
    """Windows of item_id, text; counts: how often each of sorted shingle hashes (of the given sizes) occurs in the corpus."""
    low, w, h = _words(*text_bytes(items["text"]))
    ids: list[int | None] = []
    place = {}
    for x in items["item_id"].to_pylist():
        if x not in place:
            place[x] = len(ids)
            ids.append(x)
    owner = np.array([place[x] for x in items["item_id"].to_pylist()], np.int64)
    full = np.flatnonzero(inside(w.first, window, len(h)))
    firsts, sizes, hashes = [full], [np.full(len(full), window)], [_sized(h, window)[full] if len(full) else np.zeros(0, U64)]
    for n in range(1, window):
        short = w.first[:-1][w.count == n]
        firsts.append(short)
        sizes.append(np.full(len(short), n))
        hashes.append(_sized(h, n)[short] if len(short) else np.zeros(0, U64))
    first, size, code = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(hashes)
    item = owner[np.searchsorted(w.first, first, "right") - 1] if len(first) else first
    # one entry for equal windows, with all items that have it
    order = np.lexsort((item, code))
    first, size, code, item = first[order], size[order], code[order], item[order]
    new, pair_new = np.ones(len(code), bool), np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    pair_new[1:] = new[1:] | (item[1:] != item[:-1])
    number = np.cumsum(new) - 1
    item, number, (first, size, code) = item[pair_new], number[pair_new], (x[new] for x in (first, size, code))
    # each window's rarest shingle
    own = np.minimum(size, shingle)
    prefix, offset = np.zeros(len(first), U64), np.zeros(len(first), np.int64)
    sets = {}
    for n, m in {(int(a), int(b)) for a, b in zip(*np.unique(np.stack([own, size]), axis=1), strict=True)}:
        mine = np.flatnonzero(size == m)
        sets[n, m] = mine, _sized(h, n)[first[mine][:, None] + np.arange(m - n + 1)]
    codes = np.unique(np.concatenate([x.ravel() for _, x in sets.values()])) if sets else np.zeros(0, U64)
    seen = counts(codes, sorted({n for n, _ in sets})) if len(codes) else np.zeros(0, np.int64)
    for mine, x in sets.values():
        rarest = seen[np.searchsorted(codes, x)].argmin(axis=1)
        offset[mine], prefix[mine] = rarest, x[np.arange(len(mine)), rarest]
    order = np.argsort(prefix, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    by = np.argsort(back[number], kind="stable") if len(number) else number
    item_at = np.searchsorted(back[number][by], np.arange(len(order) + 1)) if len(number) else np.zeros(1, np.int64)
    small = lambda x: x.astype(np.int32)
    return Windows(low, small(w.start), small(w.end), small(first[order]), small(size[order]), code[order], prefix[order], small(offset[order]), small(own[order]), item_at, small(item[by]), ids)


def _marked(codes: np.ndarray) -> np.ndarray:
    table = np.zeros(int(BITS) + 1, bool)
    table[(codes & BITS).astype(np.int64)] = True
    return table


def _lookup(h: np.ndarray, codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, index into sorted codes) of the hashes that are among the codes."""
    at = np.flatnonzero(table[(h & BITS).astype(np.int64)])
    k = np.minimum(np.searchsorted(codes, h[at]), len(codes) - 1)
    same = codes[k] == h[at]
    return at[same], k[same]


def shingle_counts(docs: DataFrame, codes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How often each of the sorted shingle hashes occurs in all documents."""
    given = docs.sparkSession.sparkContext.broadcast(codes)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = given.value
        table, total = _marked(codes), np.zeros(len(codes), np.int64)
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            for lo, hi in blocks(offs):
                _, w, h = _words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for n in sizes:
                    at, k = _lookup(_sized(h, n), codes, table)
                    fits = at + n <= w.first[np.searchsorted(w.first, at, "right")] if len(at) else np.zeros(0, bool)
                    total += np.bincount(k[fits], minlength=len(codes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(codes), np.int64)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out


def _find(w: Words, h: np.ndarray, low: np.ndarray, win: Windows, table: np.ndarray, sizes: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of each occurrence."""
    starts, which = [], []
    for n, lengths in sizes:
        at, k = _lookup(_sized(h, n), win.prefix, table)
        lo = np.searchsorted(win.prefix, win.prefix[k], "left")
        count = np.searchsorted(win.prefix, win.prefix[k], "right") - lo
        cand, start = spread(lo, count), np.repeat(at, count)
        start = start - win.offset[cand]
        doc = np.searchsorted(w.first, np.repeat(at, count), "right") - 1
        ok = (start >= w.first[doc]) & (start + win.length[cand] <= w.first[doc + 1])  # positional and length bounds
        start, cand = start[ok], cand[ok]
        for m in lengths:
            mine = win.length[cand] == m
            s, c = start[mine], cand[mine]
            same = _sized(h, m)[s] == win.hash[c] if len(s) else np.zeros(0, bool)
            starts.append(s[same])
            which.append(c[same])
    start, cand = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, which))
    begin, end = w.start.tolist(), w.end.tolist()
    exact = [all(low[begin[s + j] : end[s + j]].tobytes() == x for j, x in enumerate(win.words(c))) for s, c in zip(start.tolist(), cand.tolist(), strict=True)]
    exact = np.array(exact, bool)
    return start[exact], cand[exact]


def _block(docs: DataFrame, items: pa.Table, window: int, shingle: int) -> tuple[DataFrame, Broadcast]:
    """docs with n_words, hits (spans of words) and items for one block of items; and what to release when that has run."""
    win = _item_windows(items, window, shingle, lambda codes, sizes: shingle_counts(docs, codes, sizes))
    lengths = {(int(n), int(m)) for n, m in zip(*np.unique(np.stack([win.shingle, win.length]), axis=1), strict=True)}
    sizes = [(n, sorted(m for k, m in lengths if k == n)) for n in sorted({n for n, _ in lengths})]
    given = docs.sparkSession.sparkContext.broadcast(win)
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = given.value
        table = _marked(win.prefix)
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            for lo, hi in blocks(offs):
                low, w, h = _words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                start, cand = _find(w, h, low, win, table, sizes)
                hit = covered(start, start + win.length[cand], len(h))
                doc = np.searchsorted(w.first, start, "right") - 1
                ids: dict[int, set] = defaultdict(set)
                for d, c in zip(doc.tolist(), cand.tolist(), strict=True):
                    ids[d].update(win.of(c))
                spans: dict[int, list] = defaultdict(list)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    while a < b:  # a run over a document's end belongs to both
                        d = int(np.searchsorted(w.first, a, "right")) - 1
                        stop = min(b, int(w.first[d + 1]))
                        spans[d].append((a - int(w.first[d]), stop - int(w.first[d])))
                        a = stop
                part = batch.slice(lo, hi - lo)
                columns = [pa.array(w.count), pa.array([[{"start": a, "end": b} for a, b in spans.get(d, ())] for d in range(hi - lo)], pairs), pa.array([sorted(ids.get(d, ()), key=lambda x: (x is None, x or 0)) for d in range(hi - lo)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in part.schema.names), *columns], [*part.schema.names, "n_words", "hits", "items"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema), "n_words long, hits array<struct<start:long,end:long>>, items array<long>"])
    return docs.mapInArrow(hits, schema), given


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block_bytes: int) -> DataFrame:
    """docs (doc_id, text and columns of positional names) with n_words, hits, items."""
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    number = math.ceil((listed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes) or 1
    with shuffles_dropped(docs.sparkSession):
        if number == 1:
            return _block(docs, listed.toArrow(), window, shingle)[0]
        return _united(docs, listed, number, window, shingle)


MERGED = """aggregate(array_sort(flatten(collect_list(hits))), cast(array() as array<struct<start:long,end:long>>),
  (out, x) -> case when size(out) > 0 and element_at(out, -1).end >= x.start
    then concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, x.end))))
    else concat(out, array(x)) end)"""


def _united(docs: DataFrame, listed: DataFrame, number: int, window: int, shingle: int) -> DataFrame:
    """One block of items after the other; a document's hits in all of them are joined to it by id and text."""
    code = F.xxhash64("text")
    found = None
    for k in range(number):
        items = listed.where(F.pmod(F.xxhash64("text"), F.lit(number)) == k).toArrow()  # about block_bytes
        rows, given = _block(docs.select("doc_id", "text"), items, window, shingle)
        rows = cut(rows.where(F.size("hits") > 0).select("doc_id", code.alias("code"), "hits", "items").dropDuplicates(["doc_id", "code"]))
        given.unpersist()
        found = rows if found is None else found.unionByName(rows)
    merged = found.groupBy("doc_id", "code").agg(F.expr(MERGED).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.withColumnsRenamed({"doc_id": "found_id", "code": "found_code"})
    none = pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    counted = _block(docs, none, window, shingle)[0].drop("hits", "items")
    joined = counted.join(merged, F.col("doc_id").eqNullSafe(F.col("found_id")) & code.eqNullSafe(F.col("found_code")), "left")
    return joined.select(*counted.columns, F.coalesce("hits", F.expr("cast(array() as array<struct<start:long,end:long>>)")).alias("hits"), F.coalesce("items", F.expr("cast(array() as array<long>)")).alias("items"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, hits (spans of words), items (ids with occurring windows)."""
    return _searched(_plain(docs.select("doc_id", "text")), benchmark, window, shingle, block_bytes).select("doc_id", "n_words", "hits", "items")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of `docs` with no hit word."""
    inner = _plain(plain_names(docs, ("doc_id", "text")))
    return _searched(inner, benchmark, window, shingle, block_bytes).where(F.size("hits") == 0).select(*inner.columns).toDF(*docs.columns)
