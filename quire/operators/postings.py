"""Trigram postings with places: which texts hold a term, how often and where, without the texts.

An index row is a trigram of one field in one segment, a run of texts that one
task has indexed together: the texts that hold it (`ids`, as steps), how often
(`counts`), and at which characters (`places`, as steps within a text). The row
of the empty trigram has the lengths of the segment's texts as its counts. Texts
are those of the column, in lower case.

A term of three characters or more starts wherever trigrams that cover it start
at the right distances, so a segment's rows of these few trigrams, brought
together, give all its occurrences. The work of a query follows the postings of
its terms; a segment bounds what one task holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX = "field string, gram string, segment long, ids array<long>, counts array<int>, places array<int>"
#: Characters of a segment; a longer text is a segment of its own.
SEGMENT = 1 << 21
GRAM = 3


def _steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each value less the one before; the values at `first` stay."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _segment(field: str, number: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """All index rows of some texts, in the order of their ids."""
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    texts = [texts[k] for k in order]
    ids = np.array(ids, np.int64)[order]
    size = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    end = np.cumsum(size)
    text_of = np.repeat(np.arange(len(texts)), size)
    at = np.flatnonzero(np.arange(len(chars)) + GRAM <= end[text_of]) if len(chars) else np.zeros(0, np.int64)
    c = chars.astype(np.uint64)
    code = c[at] | c[at + 1] << np.uint64(21) | c[at + 2] << np.uint64(42)
    turn = np.argsort(code, kind="stable")
    at, code = at[turn], code[turn]
    text = text_of[at]
    place = at - (end - size)[text]
    new_gram = np.append(True, code[1:] != code[:-1])[: len(code)]
    new_text = new_gram | np.append(True, text[1:] != text[:-1])[: len(code)]
    grams, entries = np.flatnonzero(new_gram), np.flatnonzero(new_text)
    spelled = np.stack([chars[at[grams] + k] for k in range(GRAM)], 1).tobytes().decode("utf-32-le") if len(grams) else ""
    per_gram = np.append(np.searchsorted(entries, grams), len(entries))  # entries of each trigram
    lists = lambda values, offsets, kind: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
    first = per_gram[:-1]
    n = len(grams) + 1
    with_empty = lambda rows, own: np.concatenate([own, rows])
    id_steps = _steps(ids[text[entries]], first) if len(entries) else np.zeros(0, np.int64)
    own_ids = _steps(ids, np.array([0])) if len(ids) else ids
    id_offsets = np.concatenate([[0], len(ids) + per_gram])
    counts = np.diff(np.append(entries, len(at)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([field] * n), pa.array(["", *(spelled[GRAM * k : GRAM * k + GRAM] for k in range(n - 1))]), pa.array(np.full(n, number, np.int64)),
            lists(with_empty(id_steps, own_ids), id_offsets, pa.int64()), lists(with_empty(counts, np.maximum(size - GRAM + 1, 0)).astype(np.int32), id_offsets, pa.int32()),
            lists(_steps(place, entries).astype(np.int32), np.concatenate([[0, 0], np.append(grams, len(at))[1:]]), pa.int32()),
        ],
        ["field", "gram", "segment", "ids", "counts", "places"],
    )


def build(texts: DataFrame, fields: dict[str, Column], part: int = 0) -> DataFrame:
    """Index rows of `texts`, which have an `id`, for each field's text. Null texts are empty.

    part: of an index that is made in several calls each has its own, so that their segments differ; below 2,048, as tasks are below a million.
    """
    columns = [F.lower(F.coalesce(c, F.lit(""))).alias(f"field{k}") for k, c in enumerate(fields.values())]
    names = list(fields)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size = (part << 52) + (TaskContext.get().partitionId() << 32), [], [[] for _ in names], 0
        for batch in batches:
            for key, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(key)
                for k, t in enumerate(own):
                    held[k].append(t)
                    size += len(t)
                if size >= SEGMENT:
                    yield from (_segment(f, number, ids, t) for f, t in zip(names, held, strict=True))
                    number, ids, held, size = number + 1, [], [[] for _ in names], 0
        if ids:
            yield from (_segment(f, number, ids, t) for f, t in zip(names, held, strict=True))

    return texts.select(F.col("id").cast("long"), *columns).mapInArrow(work, INDEX)


def cover(term: str) -> dict[int, str]:
    """Trigrams that cover a term, by where they start in it."""
    low = term.lower()
    return {k: low[k : k + GRAM] for k in sorted({*range(0, len(low) - GRAM, GRAM), len(low) - GRAM})}


def matches(index: DataFrame, field: str, terms: list[str], segment: tuple[str, ...] = ("segment",)) -> DataFrame:
    """The columns `segment`, id, length (in trigrams) and tf (occurrences of each term, which may overlap) of the texts that hold any term."""
    covers = [cover(t) for t in terms]
    wanted = sorted({g for c in covers for g in c.values()})
    rows = index.where((F.col("field") == field) & F.col("gram").isin(["", *wanted]))
    kinds = {f.name: f.dataType.simpleString() for f in index.schema}

    def find(table: pa.Table) -> pa.Table:
        lists = {g: (np.cumsum(i), np.array(c, np.int64), np.array(p, np.int64)) for g, i, c, p in zip(table["gram"].to_pylist(), *(table[c].to_numpy() for c in ("ids", "counts", "places")), strict=True)}
        ids, lengths = lists.get("", (np.zeros(0, np.int64), np.zeros(0, np.int64), None))[:2]
        tf = np.zeros((len(ids), len(covers)), np.int64)
        for k, own in enumerate(covers):
            found = None
            for start, gram in own.items():
                if gram not in lists:
                    found = np.zeros(0, np.int64)
                    break
                held, counts, places = lists[gram]
                rank = np.repeat(np.searchsorted(ids, held), counts)
                base = np.cumsum(counts) - counts
                at = np.cumsum(places)
                at -= np.repeat(at[base] - places[base], counts)  # places of each text from its first on
                key = (rank << 32) + (at - start)
                key = key[at >= start]
                found = key if found is None else np.intersect1d(found, key, assume_unique=True)
                if not len(found):
                    break
            tf[:, k] = np.bincount(found >> 32, minlength=len(ids))
        any_of = np.flatnonzero(tf.any(axis=1))
        flat = pa.ListArray.from_arrays(pa.array((np.arange(len(any_of) + 1) * len(covers)).astype(np.int32)), pa.array(tf[any_of].ravel(), pa.int64()))
        named = [table[c][:1].combine_chunks().take(pa.array(np.zeros(len(any_of), np.int64))) for c in segment]
        return pa.table([*named, pa.array(ids[any_of]), pa.array(lengths[any_of]), flat], [*segment, "id", "length", "tf"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in segment), "id long, length long, tf array<long>"])
    return rows.groupBy(*segment).applyInArrow(find, schema)


def holding(found: DataFrame) -> DataFrame:
    """Of `matches`, those that hold every term."""
    return found.where(F.forall("tf", lambda x: x > 0))
