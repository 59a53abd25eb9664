"""N-gram Jaccard self-join of documents, with overlaps counted in vertical fragments of the n-gram order.

A document's set holds the hashes of its distinct shingles of `n` words, A-Z in
lower case; with fewer words, the whole sequence is its one shingle; without
words it is empty and linked with nothing. Two documents link when intersection
size >= `percent` % of union size.

1. Document frequencies of all shingles are counted in shards. The global order
   of n-grams is: in one document, then in few, then in many, by hash within
   each. A document in whose set more are alone than a link allows is out.
2. The order is cut into fragments, more than the n-grams in which two linked
   documents of a size class can differ; so they agree in a whole fragment
   (small sets: in one of their first size - ceil(percent * size) + 1 n-grams).
   Documents that do are joined through the least of them, and connected
   candidates form a cell.
3. The global order of n-grams (by their hashes, so that all fragments are of
   like size) is cut vertically into `PARTS` fragments, and every set of a cell
   with it. A task counts the partial overlaps of one fragment, for all pairs of
   a cell or of two blocks of a large cell, as a product of incidence matrices.
   Pairs that can't reach the threshold even if all that lies outside the
   fragment were common are struck out there. The partial counts go out as
   packed triangles, and a second task sums them for each pair; pairs with a
   count from every fragment that reach the threshold are links, of which a
   spanning set is passed on.
4. Components of the links.

Equal sets are collapsed inside each chunk first. Hashes have 64 bits. Null,
empty or wordless text: no words. Null doc_id: one document that comes last and
whose id stays null; rows that share a doc_id are one document and share a
component. Ties: of equal sets the least doc_id stands for all. Very long texts
are taken whole; a set of theirs is cut over the fragments like any other. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._repeats import _split
from quire.llm._rounds import by_chunk, cut, layout, run, shuffles_dropped, sorted_chunk
from quire.llm.components import components
from quire.llm._text import LOWER, U64, blocks, grams, hash_words, inside, mix, pack, pair, split_words, spread, text_bytes, unpack

#: Fragments of the global order of n-grams.
PARTS = 4
#: Documents, and bytes of their sets, of a cell that are compared in one piece.
CELL = 768
CELL_BYTES = 32 << 20
#: Columns of one matrix product.
COLUMNS = 2048
#: Bytes of sets that small cells share a group with.
BUCKET_BYTES = 16 << 20
MANY = 64
LAST = np.iinfo(np.int64).max


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each document): each document's distinct shingles in order of their hashes."""
    every, sizes = [], []
    for lo, hi in blocks(offs):
        low = LOWER[buf[offs[lo] : offs[hi]]]
        w = split_words(low, offs[lo : hi + 1] - offs[lo])
        h = hash_words(low, w.start, w.end)
        g = grams(h, n)
        at = np.flatnonzero(inside(w.first, n, len(h))[: len(g)])
        found, doc = [g[at]], [np.searchsorted(w.first, at, "right") - 1]
        for k in range(1, n):  # shorter documents
            short = np.flatnonzero(w.count == k)
            if len(short):
                found.append(pair(grams(h, k)[w.first[short]], np.full(len(short), k, U64)))
                doc.append(short)
        h, doc = np.concatenate(found), np.concatenate(doc)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        every.append(h[new])
        sizes.append(np.bincount(doc[new], minlength=hi - lo))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(every) if every else np.zeros(0, U64), np.append(0, np.cumsum(size))


def equal_sets(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document the first document of the chunk with the same set; itself if its set is empty."""
    size = np.diff(first)
    total = np.append(U64(0), np.cumsum(mix(h + U64(7))))[first]
    code = pair(total[1:] - total[:-1], size.astype(U64))
    _, lead, back = np.unique(code, return_index=True, return_inverse=True)
    return np.where(size > 0, lead[back], np.arange(len(size)))


def prefix_size(size: np.ndarray, percent: int) -> np.ndarray:
    return size + (-percent * size) // 100 + 1  # size - ceil(percent * size) + 1


def size_classes(most: int, percent: int) -> np.ndarray:
    """Upper bounds of size classes; linked sets are in one class or in two that follow each other."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 100 // percent))
    bounds.append(max(bounds[-1] + 1, bounds[-1] * 100 // percent))
    return np.array(bounds)


def _rank(group: np.ndarray) -> np.ndarray:
    """Place of each entry in its group; groups are in a row."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))


def _signatures(token: np.ndarray, doc: np.ndarray, kind: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(47-bit signature, document): two linked documents share at least one.

    Sets of n-grams (sorted by document and n-gram) are cut at fixed places of
    the order, more of them than two linked sets of that size class can differ
    in n-grams, so that some fragment of two n-grams or more is equal; each
    difference d spoils one fragment at most, so each document needs its first
    d + 1 such fragments, those that no other document can have counted in.
    Sets too small for enough such fragments use the prefix of single n-grams.
    """
    if not len(token):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    bounds = size_classes(int(size.max(initial=1)), percent)
    own = np.searchsorted(bounds, np.maximum(size, 1), "left")
    largest = size * 100 // percent
    found, docs = [], []
    for step in (0, 1):
        label = own + step
        mine = np.ones(len(doc), bool) if step == 0 else (largest > bounds[own])[doc]
        if not mine.any():
            continue
        t, d, k = token[mine], doc[mine], kind[mine]
        upper = bounds[label]
        differ = (100 - percent) * (size + np.minimum(upper, largest)) // (100 + percent)
        pieces = np.maximum(1, np.ceil(1.93 * 2 * (100 - percent) / (100 + percent) * upper)).astype(U64)
        part = (t >> U64(16)) * pieces[d] >> U64(32)
        new = np.ones(len(t), bool)
        new[1:] = (d[1:] != d[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(t)))
        code = pair(np.add.reduceat(mix(t + U64(3)), head), (count.astype(U64) << U64(40)) + part[head])
        of, lone, rare = d[head], np.minimum.reduceat(k, head) == 0, np.bitwise_or.reduceat((k == 1).astype(np.uint8), head) > 0
        good = count >= 2
        enough = np.bincount(of[good], minlength=len(size)) > differ
        spoilt = np.bincount(of[good & lone], minlength=len(size))
        at = np.flatnonzero(good & ~lone)
        at = at[np.lexsort((part[head[at]], ~rare[at], of[at]))]
        at = at[_rank(of[at]) < (differ + 1 - spoilt)[of[at]]]
        found.append(pair(code[at], label[of[at]].astype(U64)))
        docs.append(of[at])
        few = np.flatnonzero(~enough[d])
        few = few[np.lexsort((t[few], k[few], d[few]))]
        few = few[(_rank(d[few]) < prefix_size(size[d[few]], percent)) & (k[few] > 0)]
        found.append(pair(t[few], label[d[few]].astype(U64) + U64(1 << 20)))
        docs.append(d[few])
    return np.concatenate(found) >> U64(17), np.concatenate(docs)


def _candidates(n: int, percent: int) -> Callable:
    """Chunk program: n_shingles, key, same (first equal document of the chunk), roots (least candidates)."""

    def program(ids: np.ndarray, buf: np.ndarray, offs: np.ndarray, shards: int) -> Generator:
        h, first = shingle_sets(buf, offs, n)
        size, same = np.diff(first), equal_sets(h, first)
        mine = np.flatnonzero((same == np.arange(len(size))) & (size > 0))
        token = h[spread(first[mine], size[mine])] >> U64(16)
        doc = np.repeat(mine, size[mine])
        # round 1: in how many documents
        keys, back, count = np.unique(token, return_inverse=True, return_counts=True)
        deal, to, bound = _split(mix(keys) % U64(shards), shards)
        k, c = keys[deal], np.minimum(count, 255)[deal].astype(U64)
        got = yield {int(s): pack(k[a:b], 6) + pack(c[a:b], 1) for s, a, b in zip(to, bound[:-1], bound[1:], strict=True)}
        kind = np.zeros(len(keys), np.uint8)
        for s, a, b in zip(to, bound[:-1], bound[1:], strict=True):
            kind[deal[a:b]] = np.frombuffer(got[int(s)], np.uint8)
        # round 2: signatures that linked documents share
        kind = kind[back]
        alone = np.bincount(doc[kind == 0], minlength=len(size))
        may = (alone < prefix_size(size, percent))[doc]
        signature, doc = _signatures(token[may], doc[may], kind[may], size, percent)
        by = np.lexsort((doc, signature))
        signature, doc = signature[by], doc[by]
        keys, lead = np.unique(signature, return_index=True)
        deal, to, bound = _split(mix(keys) % U64(shards), shards)
        k, d = keys[deal], ids[doc[lead]][deal].astype(U64)
        got = yield {int(s): pack(k[a:b], 6) + pack(d[a:b], 8) for s, a, b in zip(to, bound[:-1], bound[1:], strict=True)}
        root = np.zeros(len(keys), np.int64)
        for s, a, b in zip(to, bound[:-1], bound[1:], strict=True):
            root[deal[a:b]] = unpack(got[int(s)], 8).astype(np.int64)
        roots, owner = root[np.searchsorted(keys, signature)], doc
        differ = roots != ids[owner]
        edge = np.unique(np.stack([owner[differ], roots[differ]]), axis=1) if differ.any() else np.zeros((2, 0), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(edge[0], np.arange(len(size) + 1)), pa.int32()), pa.array(edge[1]))
        return pa.table({"key": ids, "n_shingles": size, "same": ids[same], "roots": lists})

    return program


def _frequency(blobs: list[bytes]) -> list[bytes]:
    """Shard's part of round 1: 0 in one document, 1 in several, 2 in many."""
    sizes = [len(b) // 7 for b in blobs]
    key = np.concatenate([unpack(memoryview(b)[: 6 * m], 6) for b, m in zip(blobs, sizes, strict=True)])
    count = np.concatenate([np.frombuffer(b, np.uint8, offset=6 * m) for b, m in zip(blobs, sizes, strict=True)])
    _, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, weights=count)[back]
    kind = (total > 1).astype(np.uint8) + (total > MANY)
    at = np.cumsum([0, *sizes])
    return [kind[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _least(blobs: list[bytes]) -> list[bytes]:
    """Shard's part of round 2: the least document of each n-gram."""
    sizes = [len(b) // 14 for b in blobs]
    key = np.concatenate([unpack(memoryview(b)[: 6 * m], 6) for b, m in zip(blobs, sizes, strict=True)])
    doc = np.concatenate([unpack(memoryview(b)[6 * m :], 8) for b, m in zip(blobs, sizes, strict=True)]).astype(np.int64)
    distinct, back = np.unique(key, return_inverse=True)
    least = np.full(len(distinct), LAST)
    np.minimum.at(least, back, doc)
    least, at = least[back].astype(U64), np.cumsum([0, *sizes])
    return [pack(least[a:b], 8) for a, b in zip(at[:-1], at[1:], strict=True)]


def overlaps(h: np.ndarray, doc: np.ndarray, docs: int, columns: int = COLUMNS) -> np.ndarray:
    """Intersection sizes of all pairs of `docs` sets, summed over stretches of columns."""
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    number = np.cumsum(new) - 1
    count = np.bincount(number, minlength=1)
    shared = count[number] > 1  # an n-gram of one document is in no intersection
    number, doc = number[shared], doc[shared]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    total = np.zeros((docs, docs), np.float32)
    for lo in range(0, int(number.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(number, (lo, lo + columns))
        part = np.zeros((docs, min(columns, int(number[b - 1]) - lo + 1)), np.float32)
        part[doc[a:b], number[a:b] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Of the links in a symmetric matrix, as few as keep their documents connected."""
    left, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], front = False, [start]
        while front:
            k = front.pop()
            near = np.flatnonzero(linked[k] & left)
            left[near] = False
            out += [(k, int(m)) for m in near]
            front += near.tolist()
    return out


OUT = np.uint32(0xFFFFFFFF)


def partial_overlaps(members: list[np.ndarray], size: np.ndarray, percent: int) -> bytes:
    """Overlaps of all pairs of sets in one fragment as a packed upper triangle; OUT for pairs that can't be links."""
    own = np.array([len(m) for m in members])
    docs = np.repeat(np.arange(len(members)), own)
    count = overlaps(np.concatenate(members), docs, len(members))
    a, b = np.triu_indices(len(members), 1)
    both = count[a, b]
    most = both + np.minimum((size - own)[a], (size - own)[b])
    may = 100 * most >= percent * (size[a] + size[b] - most)
    return zlib.compress(np.where(may, both, OUT).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _triangle(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _bounds(*keys: np.ndarray) -> list[int]:
    """Where rows in a row with equal keys begin, and the end."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return [*np.flatnonzero(new).tolist(), len(keys[0])]


PARTIAL = "cell long, i int, j int, part int, keys binary, sizes binary, counts binary"


def _partial(table: pa.Table, percent: int) -> pa.Table:
    """Partial overlaps in each fragment of each cell (or pair of blocks) that the group holds."""
    table = table.sort_by([(c, "ascending") for c in ("cell", "i", "j", "part", "key", "whole")])
    cell, i, j, part, key, size = (table[c].to_numpy() for c in ("cell", "i", "j", "part", "key", "size"))
    blobs, heads = table["members"].combine_chunks() if table.num_rows else table["members"], _bounds(cell, i, j, part)
    out: list[tuple] = []
    for lo, hi in zip(heads[:-1], heads[1:], strict=True):
        if hi - lo > 1:
            members = [np.frombuffer(blobs[k].as_py(), "<u8") for k in range(lo, hi)]
            out.append((cell[lo], i[lo], j[lo], part[lo], key[lo:hi].astype("<i8").tobytes(), size[lo:hi].astype("<i8").tobytes(), partial_overlaps(members, size[lo:hi], percent)))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["cell", "i", "j", "part", "keys", "sizes", "counts"])


def _summed(table: pa.Table, percent: int) -> pa.Table:
    """Links: partial overlaps summed over the fragments for each pair."""
    table = table.sort_by([(c, "ascending") for c in ("cell", "i", "j", "part")])
    heads = _bounds(*(table[c].to_numpy() for c in ("cell", "i", "j")))
    left, right = [], []
    for lo, hi in zip(heads[:-1], heads[1:], strict=True):
        key, size = (np.frombuffer(table[c][lo].as_py(), "<i8") for c in ("keys", "sizes"))
        total, may = np.int64(0), np.bool_(True)
        for k in range(lo, hi):
            part = _triangle(table["counts"][k].as_py())
            total, may = total + part.astype(np.int64), may & (part != OUT)
        a, b = np.triu_indices(len(key), 1)
        good = may & (100 * total >= percent * (size[a] + size[b] - total))
        linked = np.zeros((len(key), len(key)), bool)
        linked[a[good], b[good]] = linked[b[good], a[good]] = True
        links = spanning(linked)
        left += [int(key[x]) for x, _ in links]
        right += [int(key[y]) for _, y in links]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _cell_sets(docs: DataFrame, labels: DataFrame, chunks: int, n: int) -> DataFrame:
    """cell, key, whole (a hash of the set), size, part, members: the sets of documents with a cell, cut into fragments; one for equal sets of a chunk."""

    def sets(table: pa.Table, cells: pa.Table) -> pa.Table:
        table, ids = sorted_chunk(table)
        h, first = shingle_sets(*text_bytes(table["text"]), n)
        same = equal_sets(h, first)
        where = dict(zip(cells["key"].to_pylist(), cells["cell"].to_pylist(), strict=True))
        rows = [d for d in range(len(ids)) if same[d] == d and first[d + 1] > first[d] and int(ids[d]) in where]
        cuts = np.array([(k << 64) // PARTS for k in range(1, PARTS)], U64)
        columns: list[list] = [[] for _ in range(6)]
        for d in rows:
            own = h[first[d] : first[d + 1]]  # in the order of hashes
            at = [0, *np.searchsorted(own, cuts).tolist(), len(own)]
            whole = int(mix(np.array([mix(own + U64(5)).sum()], U64)).astype(np.int64)[0])
            for k in range(PARTS):
                for column, value in zip(columns, (where[int(ids[d])], int(ids[d]), whole, len(own), k, own[at[k] : at[k + 1]].astype("<u8").tobytes()), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "key", "whole", "size", "part", "members"])

    keyed = labels.select(F.pmod(F.xxhash64(F.when(F.col("key") != LAST, F.col("key"))), F.lit(chunks)).cast("int").alias("chunk"), "key", "cell")
    return by_chunk(docs, chunks).groupBy("chunk").cogroup(keyed.groupBy("chunk")).applyInArrow(sets, "cell long, key long, whole long, size long, part int, members binary")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that keep the documents of each cell connected as all its links do."""
    weight = F.octet_length("members").cast("long")
    every = sets.groupBy("cell").agg(F.count_if(F.col("part") == 0).alias("docs"), F.sum(weight).alias("bytes")).where(F.col("docs") > 1)
    small = (F.col("docs") <= CELL) & (F.col("bytes") <= CELL_BYTES)
    number = F.when(small, 1).otherwise(F.greatest(F.ceil(F.col("docs") / (CELL // 2)), F.ceil(F.col("bytes") / (CELL_BYTES // 2)))).cast("int")
    every = cut(every.select("cell", "bytes", number.alias("number")))  # a row for each cell
    total = every.where("number = 1").agg(F.sum("bytes")).first()[0] or 0
    buckets = max(8, math.ceil(total / BUCKET_BYTES))
    own = F.pmod(F.xxhash64("key", "whole"), F.col("number")).cast("int")
    blocked = sets.join(every.select("cell", "number"), "cell").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("number") - 1)).alias("other")
    pairs = blocked.select("cell", "key", "whole", "size", "part", "members", "own", "number", other)
    pairs = pairs.select("cell", "key", "whole", "size", "part", "members", "number", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # small cells share groups of about BUCKET_BYTES; a fragment of a pair of blocks is a group by itself
    shared = F.pmod(F.xxhash64("cell"), F.lit(buckets))
    unit = F.when(F.col("number") == 1, F.struct(shared.alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "part")).otherwise(F.struct(F.col("cell").alias("k"), "i", "j", "part"))
    counted = pairs.select("cell", "key", "whole", "size", "part", "members", "i", "j", unit.alias("unit")).groupBy("unit").applyInArrow(lambda t: _partial(t, percent), PARTIAL)
    whole = F.when(F.col("j") == 0, F.struct(shared.alias("k"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))).otherwise(F.struct(F.col("cell").alias("k"), "i", "j"))
    return counted.select("*", whole.alias("unit")).groupBy("unit").applyInArrow(lambda t: _summed(t, percent), "a long, b long")


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, chunk_bytes: int | None = None, shard_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links lead to)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and 100 at most")
    chunks, shards = layout(docs, chunk_bytes, shard_bytes)

    with shuffles_dropped(docs.sparkSession):
        seen = cut(run(docs, _candidates(n, percent), [_frequency, _least], "key long, n_shingles long, same long, roots array<long>", chunks, shards))
        near = seen.select(F.col("key").alias("a"), F.explode("roots").alias("b"))
        cells = components(near).select(F.col("node").alias("key"), F.col("root").alias("cell"))
        sets = cut(_cell_sets(docs, cells, chunks, n))
        links = _links(sets, percent)
        equal = seen.select(F.col("key").alias("a"), F.col("same").alias("b"))
        joined = components(links.unionByName(equal))
    found = seen.select("doc_id", "key", "n_shingles").join(joined, F.col("key") == F.col("node"), "left")
    least = F.coalesce("root", "key")
    return found.select("doc_id", "n_shingles", F.when(least != LAST, least).alias("component_id"))
