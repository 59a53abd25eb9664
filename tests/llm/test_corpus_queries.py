"""The registered queries over a small folder of tables, against their SQL in another engine or a brute-force version."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from corpora import corpus
from test_text_operators import encoding, labelled
from tokenizers import Tokenizer

from quire.llm.queries import ORACLE_SQL, QUERIES, RANKS, VOCABULARY


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled texts, texts with copies and shared passages, null and empty ones, null languages."""
    path = tmp_path_factory.mktemp("whole")
    docs, labels = labelled(spark)
    plain = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    shared = [(5000 + d, t, (None, "en", "de")[d % 3], f"s{d % 4}", None if t is None else len(t)) for d, t in corpus(11, 60)]
    copies = [(7000 + k, shared[20][1], "en", "s0", 1) for k in range(120)]
    long = [(9000, " ".join(f"long{k % 4001}" for k in range(30_000)), "en", "s1", 1)]
    plain.union(spark.createDataFrame([*shared, *copies, *long], plain.schema)).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    texts = [t for _, t, *_ in shared if t and len(t) > 400]
    items = [(1, " ".join(texts[0].split()[3:30]).upper()), (10, texts[1][:150]), (9, "one"), (4, None), (5, "..."), (6, " ".join(texts[2].split()[5:17]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="module")
def other(folder):
    con = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


def test_every_query_has_sql_or_a_test_here():
    assert set(QUERIES) - set(ORACLE_SQL) == {"op4_quality_classifier", "op5_toxicity", "op7_packing", "op8_bpe", "op11_whitening", "op12_alignment", "op13_language_id"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, folder, other, name):
    found = other.execute(ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    expected = [dict(zip(columns, row, strict=True)) for row in found.fetchall()]
    got = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
    order = lambda r: (r["doc_id"], sorted((k, str(v)) for k, v in r.items()))
    assert sorted(got, key=order) == sorted(expected, key=order)


@pytest.mark.parametrize(("name", "folds", "held", "threshold"), [("op4_quality_classifier", 4, 2, 0.7), ("op5_toxicity", 5, 0, 0.5)])
def test_classifier_columns(spark, folder, other, name, folds, held, threshold):
    rows = QUERIES[name](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(x for (x,) in other.execute("select doc_id from documents").fetchall())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    texts = dict(other.execute("select doc_id, text from documents").fetchall())
    scores = defaultdict(set)
    for r in rows:
        scores[texts[r.doc_id] or ""].add(r.score)
    assert all(len(x) == 1 for x in scores.values())  # equal texts, equal scores


def test_packing_query(spark, folder, other):
    encode, pieces = encoding(open(RANKS, "rb").read(), public_tokenizers.PATTERN), defaultdict(dict)
    for r in QUERIES["op7_packing"](spark, folder).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 2048 and r.cu_lengths[-1] == r.n_tokens
        for s, a, b in zip(r.segments, r.cu_lengths, r.cu_lengths[1:], strict=False):
            pieces[s.doc_id][s.offset] = ids[a:b].tolist()
    texts = {d: t for d, t in other.execute("select doc_id, text from documents").fetchall() if t}
    assert {d: [t for at in sorted(p) for t in p[at]] for d, p in pieces.items()} == {d: encode.encode_ordinary(t) for d, t in texts.items()}


def test_bpe_query_digests(spark, folder, other):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    texts = dict(other.execute("select doc_id, text from documents").fetchall())
    for r in QUERIES["op8_bpe"](spark, folder).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
