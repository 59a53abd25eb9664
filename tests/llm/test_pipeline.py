from collections import Counter

import corpus_pipeline
import pytest
from corpora import corpus
from test_jaccard import brute
from test_repeats import characters_left
from test_text_operators import brute_hits, labelled
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs, labels = labelled(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    shared = spark.createDataFrame([(5000 + d, t, "en", "s", None if t is None else len(t)) for d, t in corpus(7, 40)], plain.schema)
    plain.union(shared).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    item = next(t for _, t in corpus(7, 40) if t and len(t) > 900)
    spark.createDataFrame([(1, " ".join(item.split()[5:40]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    (_, quality), (_, near), (_, repeats), (_, contamination), (_, encode) = corpus_pipeline.STAGES

    kept = quality(spark, docs, folder).cache()
    assert kept.columns == columns and set(pairs(kept)) < set(pairs(docs))
    assert not [t for _, t in pairs(kept) if t and t.count("$$$") > 10]

    one = near(spark, kept, folder).cache()
    classes = brute([(d, t) for d, t in pairs(kept) if d is not None])
    assert one.columns == columns and {d for d, _ in pairs(one) if d is not None} == {d for d, (_, c) in classes.items() if c == d}

    cut = repeats(spark, one, folder).cache()
    assert cut.columns == columns and Counter(pairs(cut)) == Counter(characters_left(pairs(one)))

    clean = contamination(spark, cut, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = brute_hits([(d, t) for d, t in pairs(cut) if d is not None], items)
    assert clean.columns == columns and {d for d, _ in pairs(clean) if d is not None} == {d for d, x in hits.items() if not x[1]}

    library = Tokenizer.from_file(VOCABULARY)
    out = {r.doc_id: r.n_tokens for r in encode(spark, clean, folder).collect()}
    assert out == {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in pairs(clean)}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()} == out


def test_columns_of_any_name(spark, folder):
    """Names that the stages use themselves, or that need quoting, are carried as they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5100")
    for name in ("kept", "kept_chars", "n_bytes", "gone", "__gone", "hits", "items", "n_words", "carry0", "chunk", "a.b", "__quality_score"):
        docs = docs.withColumn(name, F.col("doc_id") + 1)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, folder)
        assert rows.columns == docs.columns
        rows = rows.collect()
        assert rows and all(r["a.b"] == r["kept"] == r["doc_id"] + 1 for r in rows if r["doc_id"] is not None)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_empty(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
