"""Quality rules: fixed base rules, then limits learned per language and source from mergeable quantile sketches.

Words are `[^\\x20\\x09-\\x0D]+`. Base features of a text: words, code points in
words, symbols `[#*$%&|<>]`, lines with a word that equal an earlier line, and
words in 3-word windows that the text has twice or more.

Adaptive part: three rates (symbols per word character, repeated words per
word, repeated lines per line) are summed up in quantile sketches, histograms of
`CELLS` equal cells over 0 to 1. Sketches merge by adding their counts, so they
are built by partial aggregation; a quantile is off by one cell at most, and the
same rows give the same sketch in any order. Each language and source has its
own limits: with q the `level` quantile of a rate and m its median, a document
goes when its rate is beyond q + reach * (q - m). Where a source holds more junk
than 1 - level, that would be a limit that the junk has set, so it may not
exceed the language's: the least rate, from the median on, with less than `VALLEY`
of the language's documents within `gap` cells above it. A share of junk below a
half leaves the median alone, and so leaves the valley between the texts that
make up the bulk and a mode of junk, wherever it lies. It is measured in shares
of documents, so it is the same at any size. A source whose own median lies beyond
its language's valley is of another kind and has its own limit alone. No limit is
a constant.

A small group says little by itself, so every group's distribution is mixed with
its language's, which counts as `prior` more documents, and the language's with
that of all documents; one formula holds for groups of any size. Documents that
fail the base rules stay out of the sketches. A source's quantiles are read off
its own cells and its language's curve, which is one row, so the work follows the
number of cells that sources have.

Null text: no words, so it fails the base rules; so does an empty one. Null lang
or source is a value of its own. Repeated rows count each; equal rates are
judged alike (a rate in the limit's own cell is kept). Very long texts: worked
on in one block of their own, whole. Null doc_id: a row like others. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._rounds import cut
from quire.llm._text import blocks, byte_set, grams, hash_words, inside, pair, split_words, text_bytes

SYMBOL = byte_set("#*$%&|<>")
NEW_LINE = byte_set("\n")
FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
CELLS = 1000
PRIOR = 50
VALLEY = 0.0025


@dataclass(frozen=True)
class Rate:
    """A share `part` of `whole` and how its limit is read off a sketch."""

    name: str
    part: str
    whole: str
    level: float
    reach: int
    gap: int


RATES = (
    Rate("symbol_rate", "n_symbols", "word_chars", 0.9, 3, 60),
    Rate("repeat_rate", "n_repeat_words", "n_words", 0.95, 3, 150),
    Rate("dup_line_rate", "n_dup_lines", "n_lines", 0.98, 1, 400),
)


def _per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask))[offs])


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(twice or more in its document, equal to an earlier one) for each hash; hashes are in document order."""
    order = np.argsort(pair(doc.astype(np.uint64), h), kind="stable")
    d, x = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    many[order[1:][same]] = True
    later[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, later


def base_features(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    w = split_words(buf, offs)
    h = hash_words(buf, w.start, w.end)
    chars = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
    number = np.append(0, np.cumsum(chars[w.end] - chars[w.start]))
    repeat = np.zeros(len(h), bool)
    g = grams(h, 3)
    if len(g):
        start = np.flatnonzero(inside(w.first, 3, len(h))[: len(g)])
        many, _ = _again(np.searchsorted(w.first, start, "right") - 1, g[start])
        for k in range(3):
            repeat[start[many] + k] = True
    line = split_words(buf, offs, NEW_LINE)  # lines with a byte; those without have no word
    worded = np.searchsorted(w.start, line.end) > np.searchsorted(w.start, line.start)
    start, end, doc = line.start[worded], line.end[worded], line.doc[worded]
    _, later = _again(doc, hash_words(buf, start, end))
    docs = len(offs) - 1
    return {
        "n_words": w.count, "word_chars": np.diff(number[w.first]), "n_symbols": _per_doc(SYMBOL[buf], offs),
        "n_lines": np.bincount(doc, minlength=docs), "n_dup_lines": np.bincount(doc[later], minlength=docs), "n_repeat_words": _per_doc(repeat, w.first),
    }


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_bytes(batch["text"])
        for lo, hi in blocks(offs):
            found = base_features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part[c] for c in ("doc_id", "lang", "source")] + [pa.array(x.astype(np.int64)) for x in found.values()], ["doc_id", "lang", "source", *found])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base features of each row."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return texts.mapInArrow(_features, f"doc_id long, lang string, source string, {FEATURES}")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rate, cell, n: the histograms of all groups; at most CELLS + 1 rows for each of a group's rates."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.col(r.name).alias("cell")) for k, r in enumerate(RATES)))).alias("x")
    return measured.where(~F.col("base_failed")).select("lang", "source", cells).groupBy("lang", "source", "x.rate", "x.cell").agg(F.count("*").alias("n"))


def _of(values: list[float | int]) -> Column:
    """The value of each row's rate."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("rate") + 1)


def _shares(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, rate, cell, n) with `below`, the number up to each cell, and `total`."""
    every = Window.partitionBy(*keys, "rate")
    return cells.select("*", F.sum("n").over(every.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("below"), F.sum("n").over(every).alias("total"))


def language_curves(by_source: DataFrame, prior: int) -> DataFrame:
    """lang, rate, cell, p: cumulative shares of each language, mixed with those of all documents, at every cell that any document has."""
    overall = _shares(by_source.groupBy("rate", "cell").agg(F.sum("n").alias("n")), []).select("rate", "cell", (F.col("below") / F.col("total")).alias("p"))
    own = by_source.groupBy("lang", "rate", "cell").agg(F.sum("n").alias("n")).withColumnsRenamed({"lang": "own_lang", "rate": "own_rate", "cell": "own_cell"})
    grid = by_source.select("lang").distinct().join(F.broadcast(overall))  # at most CELLS + 1 rows for each rate
    joined = grid.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & (F.col("rate") == F.col("own_rate")) & (F.col("cell") == F.col("own_cell")), "left")
    shares = _shares(joined.select("lang", "rate", "cell", "p", F.coalesce("n", F.lit(0)).alias("n")), ["lang"])
    return shares.select("lang", "rate", "cell", ((F.col("below") + F.lit(float(prior)) * F.col("p")) / (F.col("total") + F.lit(float(prior)))).alias("p"))


def curve_rows(curves: DataFrame) -> DataFrame:
    """lang, rate, curve (its cells in order, as one array), most: the last cell before the valley."""
    w = Window.partitionBy("lang", "rate")
    ahead = [F.when(F.col("rate") == k, F.max("p").over(w.orderBy("cell").rangeBetween(0, r.gap))) for k, r in enumerate(RATES)]
    seen = curves.withColumn("ahead", F.coalesce(*ahead)).withColumn("mid", F.min(F.when(F.col("p") >= 0.5, F.col("cell"))).over(w))
    last = F.min(F.when((F.col("cell") >= F.col("mid")) & (F.col("ahead") - F.col("p") < VALLEY), F.col("cell")))  # the greatest cell has nothing above it
    return seen.groupBy("lang", "rate").agg(F.sort_array(F.collect_list(F.struct("cell", "p"))).alias("curve"), last.alias("most"))


def limits(measured: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and the greatest cell that each rate may have."""
    by_source = cut(sketches(measured))
    curves = curve_rows(language_curves(by_source, prior)).withColumnRenamed("lang", "of_lang")
    # between two of a source's own cells its count is fixed, so the first cell whose mixed share is enough is read off the language's curve
    w = Window.partitionBy("lang", "source", "rate").orderBy("cell")
    shares = _shares(by_source, ["lang", "source"]).select("lang", "source", "rate", "cell", "below", "total", F.coalesce(F.lead("cell").over(w), F.lit(CELLS + 1)).alias("next"), F.row_number().over(w).alias("at"))
    first = F.struct(F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("below"), F.col("cell").alias("next"))
    spans = F.when(F.col("at") == 1, F.array(first, F.struct("cell", "below", "next"))).otherwise(F.array(F.struct("cell", "below", "next")))
    stretches = shares.select("lang", "source", "rate", "total", F.inline(spans))
    joined = stretches.join(curves.withColumnRenamed("rate", "of_rate"), F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("rate") == F.col("of_rate")))

    def quantile(level: Column) -> Column:
        need = (level * (F.col("total") + F.lit(float(prior))) - F.col("below")) / F.lit(float(prior))
        enough = F.try_element_at(F.filter("curve", lambda x: x["p"] >= need), F.lit(1))["cell"]
        return F.min(F.when(F.greatest("cell", enough) < F.col("next"), F.when(enough.isNotNull(), F.greatest("cell", enough))))

    read = joined.groupBy("lang", "source", "rate").agg(quantile(_of([r.level for r in RATES])).alias("high"), quantile(F.lit(0.5)).alias("mid"), F.max("most").alias("most"))
    own = F.least(F.lit(CELLS), F.col("high") + _of([r.reach for r in RATES]) * (F.col("high") - F.col("mid")))
    limit = F.when(F.col("mid") <= F.col("most"), F.least(own, F.col("most"))).otherwise(own)
    return read.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == k, limit)).alias(f"most_{r.name}") for k, r in enumerate(RATES)))


def quality_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, base features, base_failed, kept, the three rates (in cells) and their limits."""
    cell = lambda r: F.expr(f"{CELLS} * {r.part} div greatest({r.whole}, 1)").alias(r.name)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = cut(features(docs).select("*", failed.alias("base_failed"), *map(cell, RATES)))  # a few numbers a document: texts are read once
    found = limits(measured, prior).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(found, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    verdict = ~F.col("base_failed")
    for r in RATES:
        verdict = verdict & (F.col(r.name) <= F.col(f"most_{r.name}"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(verdict, F.lit(False)).alias("kept"), *(r.name for r in RATES), *(f"most_{r.name}" for r in RATES))
