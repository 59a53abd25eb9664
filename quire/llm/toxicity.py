"""Toxicity: gradient-boosted trees over a few dense features, with isotonic calibration.

Features of a text: densities of lexicon words, lexicon words near a word of
the second person, second-person words, capitals, exclamation and other
punctuation, and obfuscated words (letters mixed with digits or symbols, or a
letter drawn out), besides the text's length. The lexicon is learned, not
given: the words that at least `support` toxic documents of the labelled sample
hold, in different surroundings, and that are far rarer elsewhere.

Labels are learned from at most `sample` labelled rows (a documented bound),
those of least hash of doc_id. The isotonic curve must not see margins of rows that
the lexicon or the trees have learned from, so the rows are parted into `FOLDS` by
hash of the text, which keeps copies together, and each part gets its margins from
a lexicon and trees of the others; the model itself learns from all of them. A
point of the curve is drawn to the share of label 1 as if `DOUBT` more rows of
that share had been seen there, so one or two labels make no alarm. All documents
are scored.

Null or empty texts have zero features and get the score of an empty text.
Very long texts are scored whole, in a block of their own. Null doc_id: scored,
never learned from, not held out. A score that equals the threshold predicts 1;
equal texts have equal scores. An empty table gives an empty result.
Repeated rows are scored each. Rows that share a doc_id in the labels count as
one with the greater label. Without labels of both classes every score is the
share of label 1 (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._rounds import cut
from quire.llm._text import LOWER, NOT_ALNUM, SPACE, blocks, byte_set, hash_words, pair, split_words, text_bytes
from quire.llm.quality_classifier import labelled_sample, sampled_texts

SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "du", "dich", "dir", "ihr", "tu", "te", "toi", "vous", "usted", "tú")
NEAR = 5
BINS = 32
DOUBT = 2.0
FOLDS = 5
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_ALPHA = np.array([97 <= (b | 32) <= 122 or b >= 0x80 for b in range(256)])
_SIGN = byte_set("@$!*#%&+|")
_PUNCT = byte_set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _codes(words: Iterable[str]) -> np.ndarray:
    parts = [w.encode() for w in words]
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return np.unique(hash_words(np.frombuffer(b"".join(parts), np.uint8), end - [len(p) for p in parts], end)) if parts else np.zeros(0, np.uint64)


def _among(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.zeros(len(h), bool)
    return codes[np.minimum(np.searchsorted(codes, h), len(codes) - 1)] == h


def dense_features(buf: np.ndarray, offs: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row for each document."""
    docs, low = len(offs) - 1, LOWER[buf]
    w = split_words(low, offs, NOT_ALNUM)
    h = hash_words(low, w.start, w.end)
    bad, you = _among(h, lexicon), _among(h, _codes(SECOND_PERSON))
    seen = np.append(0, np.cumsum(you))
    doc = w.doc
    at = np.arange(len(h))
    near = seen[np.minimum(at + NEAR + 1, w.first[doc + 1])] - seen[np.maximum(at - NEAR, w.first[doc])] > 0
    per_doc = lambda mask, first: np.diff(np.append(0, np.cumsum(mask))[first])
    n, size = np.maximum(w.count, 1), np.maximum(np.diff(offs), 1)
    letters, capitals = per_doc(_ALPHA[buf], offs), per_doc(_UPPER[buf], offs)
    hits = per_doc(bad, w.first)
    kinds = np.zeros(docs)
    if bad.any():
        pairs = np.unique(np.stack([doc[bad].astype(np.uint64), h[bad]]), axis=1)
        kinds = np.bincount(pairs[0].astype(np.int64), minlength=docs)
    s = split_words(buf, offs, SPACE)
    sums = [np.append(0, np.cumsum(t[buf])) for t in (_ALPHA, _DIGIT, _SIGN)]
    alpha, digit, _ = (c[s.end] - c[s.start] for c in sums)
    core = np.maximum(s.end - 1, s.start)  # a sign at the end is punctuation
    inner = sums[2][core] - sums[2][s.start]
    drawn = np.zeros(len(buf), bool)
    drawn[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _ALPHA[buf[2:]]
    drawn = np.append(0, np.cumsum(drawn))
    odd = (alpha > 0) & ((digit > 0) | (inner > 0) | (drawn[s.end] - drawn[np.minimum(s.start + 2, s.end)] > 0))
    parts = [hits / n, np.log1p(hits), kinds, per_doc(bad & near, w.first) / n, np.log1p(per_doc(bad & near, w.first)), per_doc(you, w.first) / n, capitals / np.maximum(letters, 1),
             per_doc(buf == 33, offs) / size, per_doc(_PUNCT[buf], offs) / size, per_doc(odd, s.first) / np.maximum(s.count, 1), np.log1p(w.count)]
    return np.stack(parts, axis=1).astype(float)


@dataclass
class Trees:
    """Boosted trees of fixed depth as arrays (feature, limit of each inner node; value of each leaf), with an isotonic curve."""

    lexicon: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float
    curve_x: np.ndarray
    curve_y: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.curve_x, self.curve_y)


def boost(x: np.ndarray, y: np.ndarray, depth: int = 3, rounds: int = 60, rate: float = 0.15, least: float = 2.0, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(features, limits, leaf values, base margin): Newton boosting of the logistic loss on histograms."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, inner = np.full(len(y), base), 2**depth - 1
    features, limits, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            mine = node == k
            best = 1e-6
            gs, hs = g[mine], h[mine]
            total_g, total_h = gs.sum(), hs.sum()
            for f, c in enumerate(cuts):
                if not len(c) or not mine.any():
                    continue
                b = binned[mine, f]
                left_g, left_h = (np.cumsum(np.bincount(b, weights=v, minlength=len(c) + 1))[:-1] for v in (gs, hs))
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
                gain[(left_h < least / 4) | (right_h < least / 4)] = 0
                if gain.max() > best:
                    best, feature[k], limit[k] = gain.max(), f, c[int(gain.argmax())]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > limit[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + ridge)
        margin += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return np.array(features), np.array(limits), np.array(values), base


def isotonic(margin: np.ndarray, y: np.ndarray, doubt: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve of least squares through (margin, y), by pooling adjacent violators.

    doubt: rows of the mean of y that are added to each level, which then rises again by its running maximum.
    """
    order = np.argsort(margin, kind="stable")
    xs, inverse = np.unique(margin[order], return_inverse=True)
    total, weight = np.bincount(inverse, weights=y[order]), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # sum, weight, first x, last x
    for x, t, n in zip(xs, total, weight, strict=True):
        pools.append([t, n, x, x])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + n, pools[-1][2], last]
    x = np.array([v for p in pools for v in (p[2], p[3])])
    level = np.array([(p[0] + doubt * y.mean()) / (p[1] + doubt) for p in pools for _ in (0, 1)])
    return x, np.maximum.accumulate(level)


def _constant(y: np.ndarray) -> Trees:
    share = float(y.mean()) if len(y) else 0.0
    return Trees(_codes(()), np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0, np.zeros(1), np.full(1, share))


def word_contexts(text: str | None) -> dict[str, int]:
    """Each word of a text with the least hash of the words before and after it."""
    buf, offs = text_bytes(pa.array([text or ""]))
    low = LOWER[buf]
    w = split_words(low, offs, NOT_ALNUM)
    h = np.concatenate([[0], hash_words(low, w.start, w.end), [0]]).astype(np.uint64)
    around = pair(h[:-2], h[2:]).astype(np.int64).tolist()
    out: dict[str, int] = {}
    for a, b, c in zip(w.start, w.end, around, strict=True):
        word = low[a:b].tobytes().decode()
        out[word] = min(out.get(word, c), c)
    return out


def learned_words(sample: DataFrame, support: int = 6, lift: float = 8.0) -> list[str]:
    """Words of the labelled sample that are far more common in toxic documents. The sample is bounded, and its toxic words with it.

    A document counts by one pair of neighbours of the word, and equal pairs
    count once, so that neither a long document nor copies of a toxic one make
    its plain words look toxic.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = sorted(word_contexts(text).items())
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64()), pa.array([label] * len(found), pa.int32())], ["word", "context", "label"])

    seen = sample.select("label", "text").mapInArrow(work, "word string, context long, label int").groupBy("word", "context").agg(F.max("label").alias("label"))
    counts = seen.groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    totals = Counter({r[0]: r[1] for r in sample.groupBy("label").count().collect()})
    ratio = ((F.col("toxic") + 0.5) / (totals[1] + 1)) / ((F.col("n") - F.col("toxic") + 0.5) / (totals[0] + 1))
    rows = counts.where(F.col("toxic") >= support).where((ratio >= lift) & (2 * F.col("toxic") >= F.col("n"))).select("word").collect()
    return sorted(r["word"] for r in rows)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = 8000) -> Trees:
    chosen = labelled_sample(labels, column, folds, held_out, sample)  # at most `sample` rows of two numbers
    texts = cut(sampled_texts(docs, chosen).withColumn("fold", F.coalesce(F.pmod(F.xxhash64("text"), F.lit(FOLDS)), F.lit(0)).cast("int")))  # read often
    sizes = Counter({(r["fold"], r["label"]): r["count"] for r in texts.groupBy("fold", "label").count().collect()})
    both = lambda used: all(sum(sizes[k, label] for k in used) for label in (0, 1))
    if not both(range(FOLDS)):
        return _constant(np.array([label for (_, label), n in sizes.items() for _ in range(n)], float))
    others = [[k for k in range(FOLDS) if k != f] for f in range(FOLDS)]
    apart = all(both(used) for used in others)  # else the curve sees what the trees have learned from
    used = [list(range(FOLDS)), *(others if apart else [])]
    lexicons = [_codes(learned_words(texts.where(F.col("fold").isin(u)))) for u in used]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            for lo, hi in blocks(offs):
                x = np.hstack([dense_features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lexicon) for lexicon in lexicons])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], part["fold"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "fold", "x"])

    rows = texts.mapInArrow(work, "doc_id long, label int, fold int, x array<double>").toArrow()
    x, y = np.array(rows["x"].to_pylist()), rows["label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, rows["doc_id"].to_numpy()])
    y, fold = y[order], rows["fold"].to_numpy()[order]
    views = np.split(x[order], len(lexicons), axis=1)
    learn = lambda view, mine, lexicon: Trees(lexicon, *boost(view[mine], y[mine]), np.zeros(1), np.zeros(1))
    model = learn(views[0], np.ones(len(y), bool), lexicons[0])
    margin = model.margin(views[0])
    for k, (view, lexicon) in enumerate(zip(views[1:], lexicons[1:], strict=True)):
        if (fold == k).any():
            margin[fold == k] = learn(view, fold != k, lexicon).margin(view[fold == k])
    model.curve_x, model.curve_y = isotonic(margin, y, DOUBT)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample))  # sixty trees and a lexicon

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            for lo, hi in blocks(offs):
                found = model.score(dense_features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], model.lexicon))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
