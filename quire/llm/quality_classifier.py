"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators are hashed into a fixed space: byte trigrams of the text, and one to
three consecutive word shapes (case, length, what the word ends in, whether it
repeats the word before). Each indicator is scaled by its class log-count ratio
and each document to unit length; a linear hinge-loss model is fit by dual
coordinate descent, and its margins are turned into scores by a logistic curve
fit on margins of documents that the model hasn't seen.

Labels are learned from at most `sample` labelled rows (a documented bound),
those of least hash of doc_id; all documents are scored.

Null or empty texts have no indicators and get the score of an empty text.
Very long texts are scored whole, in a block of their own. Null doc_id: scored,
never learned from, not held out. A score that equals the threshold predicts 1;
equal texts have equal scores. An empty table gives an empty result.
Repeated rows are scored each. Rows that share a doc_id in the labels count as
one with the greater label. Without labels of both classes every score is the
share of label 1 (0.5 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._text import U64, blocks, grams, hash_words, pair, split_words, text_bytes

BYTES, SHAPES = 1 << 16, 1 << 14
WIDTH = BYTES + SHAPES
_LETTER = np.array([97 <= (b | 32) <= 122 or b >= 0xC0 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])


def _shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A small number for each word."""
    upper = np.append(0, np.cumsum(_UPPER[buf]))
    letter = np.append(0, np.cumsum(_LETTER[buf]))
    n_upper, n_letter, size = upper[end] - upper[start], letter[end] - letter[start], end - start
    last, second = buf[end - 1], buf[np.maximum(end - 2, start)]
    case = np.where(n_upper == 0, 0, np.where((n_upper == 1) & _UPPER[buf[start]], 1, np.where(2 * n_upper >= n_letter, 2, 3)))
    tail = np.where(_LETTER[last] | (last >= 0x80), 0, last)
    twin = (last == second) & (tail > 0)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][np.diff(first) > 0]] = False  # a document's first word has none before it
    length = np.minimum(np.ceil(np.log2(size + 1)).astype(np.int64), 7)
    return case + 4 * length + 32 * twin + 64 * same + 128 * tail.astype(np.int64) + (1 << 16) * (n_letter == 0)


def indicators(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted indicator numbers of each document."""
    mark = np.zeros(WIDTH, bool)
    for lo, hi in blocks(offs):
        part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        b = part.astype(np.uint32)
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.uint32)
        code = (code * np.uint32(2654435761)) >> np.uint32(16)
        w = split_words(part, at)
        shape = _shapes(part, w.start, w.end, hash_words(part, w.start, w.end), w.first).astype(U64) if len(w.start) else np.zeros(0, U64)
        runs = [(pair(grams(shape, n), np.full(max(len(shape) - n + 1, 0), n, U64)) % U64(SHAPES)).astype(np.int64) + BYTES for n in (1, 2, 3)]
        for d in range(hi - lo):
            mark[code[at[d] : max(at[d + 1] - 2, at[d])]] = True
            for n, run in enumerate(runs):
                mark[run[w.first[d] : max(w.first[d + 1] - n, w.first[d])]] = True
            found = np.flatnonzero(mark)
            mark[found] = False
            yield found


@dataclass
class NbSvm:
    """Margins of scaled indicators, and the logistic curve that turns them into scores."""

    weight: np.ndarray  # of the scaled indicator, times its scale
    square: np.ndarray  # of the scale
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.square[found].sum()) ** 0.5
        return self.bias + (float(self.weight[found].sum()) / norm if norm else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -50, 50))))


def log_count_ratio(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) with one added to each count of documents."""
    counts = np.ones((2, WIDTH))
    for found, y in zip(rows, label, strict=True):
        counts[int(y), found] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of least |w|^2 / 2 + sum of cost * hinge loss (Hsieh et al., 2008); the bias is a constant feature."""
    values = []
    for found in rows:
        v = scale[found]
        norm = float(np.sqrt(v @ v))
        values.append(v / norm if norm else v)
    y = np.where(label > 0, 1.0, -1.0)
    diagonal = np.array([v @ v + 1 for v in values])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(WIDTH), 0.0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in random.permutation(len(rows)):
            found, v = rows[k], values[k]
            gradient = y[k] * (w[found] @ v + bias) - 1
            new = min(max(alpha[k] - gradient / diagonal[k], 0.0), cost[k])
            step = (new - alpha[k]) * y[k]
            if step:
                alpha[k] = new
                w[found] += step * v
                bias += step
    return w, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by Newton steps, with Platt's softened targets."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _fit_once(rows: list[np.ndarray], label: np.ndarray, cost: float, epochs: int) -> NbSvm:
    scale = log_count_ratio(rows, label)
    share = label.mean()
    each = np.where(label > 0, cost / (2 * share), cost / (2 * (1 - share)))  # both classes weigh the same
    w, bias = dual_coordinate_descent(rows, label, scale, each, epochs)
    return NbSvm(w * scale, scale**2, bias, 1.0, 0.0)


def fit_rows(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, epochs: int = 12) -> NbSvm:
    if not len(label) or label.min() == label.max():
        share = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.5
        return NbSvm(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0, float(np.log(share / (1 - share))))
    margin, fold = np.zeros(len(label)), np.arange(len(label)) % 3
    for k in range(3):
        train = fold != k
        if label[train].min() == label[train].max():
            margin[~train] = 2.0 * label[~train] - 1
            continue
        model = _fit_once([rows[i] for i in np.flatnonzero(train)], label[train], cost, epochs)
        margin[~train] = [model.margin(rows[i]) for i in np.flatnonzero(~train)]
    model = _fit_once(rows, label, cost, epochs)
    model.slope, model.shift = _logistic(margin, label)
    return model


def labelled_sample(labels: DataFrame, column: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """doc_id and label of at most `sample` rows outside the held-out fold, those of least hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out)
    return known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def sampled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, label, text of the chosen ids: one row for each, of repeated ids the least text. chosen: a bounded number of rows of two numbers."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, held_out: int = 2, sample: int = 4000) -> NbSvm:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype("<u4").tobytes() for x in indicators(*text_bytes(batch["text"]))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    texts = sampled_texts(docs, labelled_sample(labels, column, folds, held_out, sample))
    rows = texts.mapInArrow(work, "doc_id long, label int, found binary").toArrow().sort_by([("doc_id", "ascending"), ("found", "ascending")])
    return fit_rows([np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in rows["found"]], rows["label"].to_numpy())


def score(docs: DataFrame, model: NbSvm, to: str = "quality_score") -> DataFrame:
    """`docs` with a column `to`."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each hashed indicator
    others = [f.name for f in docs.schema]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            found = [model.score(x) for x in indicators(*text_bytes(batch["text"]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*others, to])

    return docs.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{to}` double"]))


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, sample=sample)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
