"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of presence: the number of
different runs of one to four bytes that both hold (lower case, everything in
ASCII but letters as a space), over the root of the product of their own
numbers. Runs are hashed into 2**18 places. A bounded sample of labelled texts
is taken, as many of each language as the bound allows; some of these are the
Nystroem landmarks. Tasks sum the products of the sample's kernel rows, and the
driver solves one-versus-rest kernel ridge regression in the landmarks' space,
as large as the number of landmarks. All documents are scored by products of a
batch's presence matrix, which is sparse, with the landmarks' presence matrix
times the regression's coefficients: the second product is made once.

Null texts and texts without a letter are `und` with score 0, as is everything
where no language can be learned. A text that shares nothing with a landmark, or
a tie, gets the language with most rows in the sample, then the least name. Very
long texts are read whole, in a block of their own. Null doc_id: scored, never
learned from, not held out. Repeated rows are scored each, alike; rows that share
a doc_id and a language are one in the sample, with the least text. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._rounds import cut
from quire.llm._text import M1, M3, U64, blocks, load64, text_bytes

BITS, LONGEST = 18, 4
WIDTH = 1 << BITS
_PLAIN = np.array([b if b >= 0x80 or 97 <= (b | 32) <= 122 else 32 for b in range(256)], np.uint8)
#: Parts that the sample is dealt to; each sends one matrix to the driver.
PARTS = 8


def spectra(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted places of the runs that each text holds."""
    buf, offs = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    mark = np.zeros(WIDTH, bool)
    for lo, hi in blocks(offs):
        part, at = _PLAIN[buf[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        eight = load64(part)
        runs = []
        for n in range(1, LONGEST + 1):
            h = ((eight & U64((1 << 8 * n) - 1)) ^ U64(n << 40)) * M1
            h ^= h >> U64(29)
            runs.append((h * M3 >> U64(64 - BITS)).astype(np.int32))
        for d in range(hi - lo):
            for n, run in enumerate(runs, 1):
                mark[run[at[d] : max(at[d + 1] - n + 1, at[d])]] = True
            found = np.flatnonzero(mark)
            mark[found] = False
            yield found


def rows_times(found: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    """Product of a batch's presence matrix, each row over the root of its sum, with `dense`."""
    out = np.zeros((len(found), dense.shape[1]))
    for k, places in enumerate(found):
        if len(places):
            out[k] = dense[places].sum(axis=0, dtype=np.float64) / len(places) ** 0.5
    return out


def kernel(found: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Kernel of each text with each landmark: a product of two sparse presence matrices."""
    out, place = np.zeros((len(found), len(marks))), np.zeros(WIDTH, bool)
    size = np.array([len(m) for m in marks])
    shown, every = np.flatnonzero(size), np.concatenate([*marks, np.zeros(0, np.int64)])
    first = (np.cumsum(size) - size)[shown]
    for k, places in enumerate(found):
        if len(places) and len(shown):
            place[places] = True
            out[k, shown] = np.add.reduceat(place[every], first, dtype=np.int64) / np.sqrt(len(places) * size[shown])
            place[places] = False
    return out


@dataclass
class KernelRidge:
    languages: list[str]
    weight: np.ndarray  # of each place and language
    shift: np.ndarray  # of each language

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return rows_times(found, self.weight) + self.shift


def folded(marks: list[np.ndarray], coefficients: np.ndarray) -> np.ndarray:
    """Product of the landmarks' presence matrix and the coefficients: one weight for each place and language."""
    out = np.zeros((WIDTH, coefficients.shape[1]))
    for places, c in zip(marks, coefficients, strict=True):
        if len(places):
            out[places] += c / len(places) ** 0.5
    return out.astype(np.float32)


def solve(within: np.ndarray, products: np.ndarray, targets: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """Coefficients of the landmarks, by language. within: kernel among landmarks; products, targets: sums over the sample."""
    value, vector = np.linalg.eigh(within)
    keep = value > 1e-6 * max(value.max(), 1e-300)
    root = vector[:, keep] / np.sqrt(value[keep])  # of the inverse
    inner = root.T @ products @ root + ridge * n * np.eye(int(keep.sum()))
    return root @ np.linalg.solve(inner, root.T @ targets)


def language_sample(docs: DataFrame, folds: int, held_out: int, sample: int) -> DataFrame:
    """doc_id, lang, rank, text of at most `sample` rows outside the held-out fold, about as many of each language as the bound allows.

    A row's rank is what its place in its language is expected to be, by a hash of
    doc_id: the hash as a fraction of its range, times the language's number of
    rows. Least ranks are taken, so no task sees a language's rows together.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = base.where("lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)
    many = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language; the model is 2**18 numbers for each
    few = known.select("doc_id", "lang").join(F.broadcast(many), "lang").withColumn("rank", part * F.col("n")).where(F.col("rank") < 2 * sample).select("doc_id", "lang", "rank").distinct()
    chosen = few.orderBy("rank", "lang", "doc_id").limit(sample)
    return known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))  # chosen: `sample` rows at most


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = 4000, landmarks: int = 256, ridge: float = 1e-4) -> KernelRidge:
    spark = docs.sparkSession
    rows = cut(language_sample(docs, folds, held_out, sample).repartition(PARTS, "doc_id", "lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # of the sample
    if not counts:
        return KernelRidge([], np.zeros((WIDTH, 0), np.float32), np.zeros(0))
    languages = sorted(counts, key=lambda x: (-counts[x], x))

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<u4").tobytes() for x in spectra(batch["text"])], pa.binary())], ["found"])

    chosen = rows.orderBy("rank", "lang", "doc_id").limit(landmarks).select("text").mapInArrow(places, "found binary").collect()
    marks = sorted((np.frombuffer(r.found, "<u4").astype(np.int64) for r in chosen), key=lambda x: x.tolist())
    given = spark.sparkContext.broadcast((languages, marks))  # at most 2**18 places of each landmark

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, marks = given.value
        number = {x: k for k, x in enumerate(languages)}
        products, targets = np.zeros((len(marks),) * 2), np.zeros((len(marks), len(languages)))
        total, classes = np.zeros(len(marks)), np.zeros(len(languages))
        for batch in batches:
            rows = kernel(list(spectra(batch["text"])), marks)
            wanted = np.eye(len(languages))[[number[x] for x in batch["lang"].to_pylist()]]
            products += rows.T @ rows
            targets += rows.T @ wanted
            total += rows.sum(axis=0)
            classes += wanted.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (products, targets, total, classes)], ["products", "targets", "total", "classes"])

    parts = rows.select("lang", "text").mapInArrow(sums, "products binary, targets binary, total binary, classes binary").collect()  # PARTS rows
    m = len(marks)
    products, targets, total, classes = (sum(np.frombuffer(r[k]) for r in parts) for k in range(4))
    n = int(classes.sum())
    shift = classes / n
    centred = targets.reshape(m, -1) - np.outer(total, shift)
    return KernelRidge(languages, folded(marks, solve(kernel(marks, marks), products.reshape(m, m), centred, n, ridge)), shift)


def language_id(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = 4000, landmarks: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from at most `sample` rows (a documented bound), with `landmarks` of them as landmarks."""
    model = fit(docs, folds, held_out, sample, landmarks)
    given = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 places by the languages
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_pylist()
            if model.languages:
                scores = model.scores(list(spectra(batch["text"])))
                best = scores.argmax(axis=1)
                said = [model.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(scores[np.arange(len(best)), best], 0, 1), 0.0)
            else:
                said, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = base.mapInArrow(work, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "lang_pred", "score")
