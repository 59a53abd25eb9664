"""Ranked and plain search over chapters.

Terms are literal: wildcards and quotes in them mean themselves. Everything is
one scan of the chapters; corpus statistics are one aggregate of a few numbers.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import occurrences, quoted
from quire.operators import postings

# Okapi BM25 (Robertson and Zaragoza, 2009).
K1, B = 1.2, 0.75
SHORTEST_INDEXED = 3


def split_terms(keywords: str) -> list[str]:
    return keywords.split()


def like(column: Column, term: str) -> Column:
    """Does the column hold the term, ASCII case aside? One pass that stops at the first hit."""
    return F.coalesce(column, F.lit("")).rlike("(?i)" + quoted(term))


def like_snippet(terms: list[str]) -> Column:
    """Around the first term (in the query's order) that the content holds as written; else the title."""
    content, out = F.coalesce(F.col("content"), F.lit("")), None
    for term in terms:
        at = F.locate(term, content)
        start = F.greatest(F.lit(0), at - 21)
        piece = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(content, start + 1, at - 1 - start + len(term) + 30), F.lit("…"))
        out = F.when(at > 0, piece) if out is None else out.when(at > 0, piece)
    title = F.coalesce(F.col("title"), F.lit(""))
    return title if out is None else out.otherwise(title)


def search_like(chapters: DataFrame, terms: list[str], doc_id: int | None = None, chapter_id: int | None = None, top_k: int = 5) -> DataFrame:
    """Chapters whose content or title holds every term, in document order."""
    hits = chapters.where(reduce(and_, (like(F.col("content"), t) | like(F.col("title"), t) for t in terms)))
    hits = hits.where(F.col("doc_id") == doc_id) if doc_id is not None else hits
    hits = hits.where(F.col("id") == chapter_id) if chapter_id is not None else hits
    return hits.orderBy("order_num", "id").limit(top_k).withColumn("hit", like_snippet(terms))


def indexed_text() -> Column:
    """What full-text search looks at."""
    return F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" "), F.coalesce(F.col("content"), F.lit("")))


def match(text: Column, terms: list[str]) -> Column:
    """Full-text match: every term of three characters or more is a substring, case aside."""
    return reduce(and_, (F.lower(text).contains(t.lower()) for t in terms))


def bm25(chapters: DataFrame, terms: list[str]) -> DataFrame:
    """Chapters that match all terms with `rank`, least first; statistics are over all chapters."""
    text = chapters.withColumn("__text", indexed_text())
    counted = text.select("*", F.greatest(F.lit(0), F.length("__text") - 2).alias("__d"), *(occurrences(F.col("__text"), t).alias(f"__f{k}") for k, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("__n"), F.avg("__d").alias("__avg"), *(F.count_if(F.col(f"__f{k}") > 0).alias(f"__df{k}") for k in range(len(terms))))
    hits = counted.where(reduce(and_, (F.col(f"__f{k}") > 0 for k in range(len(terms))))).join(F.broadcast(stats))  # one row, by its aggregate
    return hits.withColumn("rank", -relevance([F.col(f"__f{k}") for k in range(len(terms))], F.col("__d"))).select(*chapters.columns, "rank")


def relevance(tf: list[Column], length: Column) -> Column:
    """Okapi BM25 of a text with these numbers of occurrences, given __n, __avg and the terms' numbers of texts __df0, __df1, ..."""
    score = F.lit(0.0)
    for k, f in enumerate(tf):
        n, df = F.col("__n"), F.col(f"__df{k}")
        idf = F.log((n - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.col("__avg")))
    return score


def ranked_matches(found: DataFrame, n_terms: int, totals: DataFrame) -> DataFrame:
    """Of postings.matches the texts that hold all terms, with `rank`, least first. totals: one row of __n and __avg of all texts."""
    stats = found.agg(*(F.count_if(F.element_at("tf", k + 1) > 0).alias(f"__df{k}") for k in range(n_terms))).join(F.broadcast(totals))  # one row each
    hits = postings.holding(found).join(F.broadcast(stats))
    return hits.withColumn("rank", -relevance([F.element_at("tf", k + 1) for k in range(n_terms)], F.col("length"))).select(*found.columns, "rank")


def best_window(text: Column, terms: list[str], size: int) -> Column:
    """Where the window of `size` characters begins that shows most: of the windows that begin with a term's hit the one with
    most different terms, then most hits, then the first; moved to have its hits in the middle, within the text.

    Windows and texts are counted in trigrams, of which a text has two less than characters. One pass over the hits
    of a text, with a pointer for each term at either end of the window; meant for the few texts that are shown.
    """
    wanted, grams = [t.lower() for t in terms], size - 2

    def start(low: str) -> int:
        hits = [[m.start() for m in re.finditer(f"(?={re.escape(t)})", low)] for t in wanted]
        first, past, best = [0] * len(wanted), [0] * len(wanted), None
        for at in sorted({i for h in hits for i in h}):
            shown, end = 0, at
            for k, h in enumerate(hits):
                while first[k] < len(h) and h[first[k]] < at:
                    first[k] += 1
                while past[k] < len(h) and h[past[k]] < at + grams:
                    past[k] += 1
                if past[k] > first[k]:
                    shown += 999 + past[k] - first[k]
                    end = max(end, h[past[k] - 1] + len(wanted[k]) - 2)
            if best is None or shown > best[0]:
                best = shown, at, end
        if best is None:
            return 0
        return max(0, min(best[1] - int((grams - (best[2] - best[1])) / 2), len(low) - 2 - grams))

    @F.pandas_udf("int")
    def starts(low: pd.Series) -> pd.Series:
        return low.fillna("").map(start).astype("int32")

    return starts(F.lower(text))


def snippet(text: Column, terms: list[str], width: int = 14) -> Column:
    """The best window of `width` characters, hits in brackets, ellipses where it is cut."""
    size = max(width, *map(len, terms))
    quoted = "(?i)(" + "|".join(f"\\Q{t}\\E" for t in sorted(terms, key=len, reverse=True)) + ")"

    start = best_window(text, terms, size)
    marked = F.regexp_replace(F.substring(text, start + 1, F.lit(size)), quoted, "【$1】")
    return F.concat(F.when(start > 0, "…").otherwise(""), marked, F.when(start + size < F.length(text), "…").otherwise(""))


def search_content(chapters: DataFrame, keywords: str, doc_id: int | None = None, chapter_id: int | None = None, top_k: int = 5) -> DataFrame:
    """Best chapters for the keywords with id, chapter_path, title, hit; short terms make the whole query a plain search."""
    terms = split_terms(keywords)
    if not terms:
        raise ValueError("no keywords")
    if any(len(t) < SHORTEST_INDEXED for t in terms):
        return search_like(chapters, terms, doc_id, chapter_id, top_k).select("id", "chapter_path", "title", "hit")
    ranked = bm25(chapters, terms)
    ranked = ranked.where(F.col("doc_id") == doc_id) if doc_id is not None else ranked
    ranked = ranked.where(F.col("id") == chapter_id) if chapter_id is not None else ranked
    return ranked.orderBy("rank", "id").limit(top_k).select("id", "chapter_path", "title", snippet(indexed_text(), terms).alias("hit"), "rank")


def find_title(chapters: DataFrame, keywords: str, doc_id: int | None = None, most: int = 20) -> DataFrame:
    """Chapters whose title holds all terms, in document order: case aside if every term is long enough and any chapter matches so, else ASCII case aside."""
    terms = split_terms(keywords)
    if not terms:
        raise ValueError("no keywords")
    own = chapters.where(F.col("doc_id") == doc_id) if doc_id is not None else chapters
    plain = reduce(and_, (like(F.col("title"), t) for t in terms))
    title = F.coalesce(F.col("title"), F.lit(""))
    # every plain hit is a full-text hit too, so that one scan serves both
    hits = own.where(match(title, terms) if all(len(t) >= SHORTEST_INDEXED for t in terms) else plain)
    return hits.orderBy("order_num", "id").limit(most).select("id", "level", "chapter_path", "title")
