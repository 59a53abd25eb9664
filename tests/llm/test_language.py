"""Languages against a dense version of the same kernel and regression, and held-out accuracy."""

import random
import zlib

import numpy as np

from quire.llm import language_id as module
from quire.llm.language_id import language_id
from quire.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, score int, lang_pred int, held_out string"


def texts(seed=2, docs=240):
    rnd = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "and", "er", "wh"], "de": ["sch", "ung", "ein", "ü", "ver", "ß"], "fr": ["eau", "é", "que", "aux", "oi", "ç"]}
    out = []
    for k in range(docs):
        lang = ("en", "de", "fr", "en")[k % 4]
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.choice([1, 3, 30, 200]))]
        out.append((k, " ".join(words).capitalize(), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, g, "s", 1, 2, "x") for d, t, g in rows], SCHEMA).repartition(3)


def spectrum(text):
    """Runs of one to four bytes, as the kernel takes them."""
    plain = bytes(b if b >= 0x80 or 97 <= (b | 32) <= 122 else 32 for b in text.lower().encode())
    return {plain[i : i + n] for n in range(1, 5) for i in range(len(plain) - n + 1)}


def test_kernel_is_that_of_the_sets():
    import pyarrow as pa

    own = [t for _, t, _ in texts(docs=12)] + [""]
    got = module.kernel(list(module.spectra(pa.array(own))), list(module.spectra(pa.array(own[:5]))))
    sets = [spectrum(t) for t in own]
    want = [[len(s & z) / max(len(s) * len(z), 1) ** 0.5 for z in sets[:5]] for s in sets]
    assert np.abs(got - want).max() < 0.01  # but for runs that share a place


def test_folded_scores_are_those_of_the_dual():
    """All rows as landmarks: kernel ridge regression by its dual, from dense kernels."""
    import pyarrow as pa

    rows = texts(docs=40)
    found = list(module.spectra(pa.array([t for _, t, _ in rows])))
    k = module.kernel(found, found)
    y = np.eye(3)[[("en", "de", "fr").index(g) for _, _, g in rows]]
    y = y - y.mean(axis=0)
    coefficients = module.solve(k, k @ k, k @ y, 40, 1e-3)
    dual = k @ np.linalg.solve(k + 40 * 1e-3 * np.eye(40), y)
    assert np.abs(module.rows_times(found, module.folded(found, coefficients)) - dual).max() < 1e-3
    assert np.abs(k @ coefficients - dual).max() < 1e-3


def test_held_out_languages_and_cases(spark):
    rows = texts()
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 345 !?", "en"), (903, "日本語", None), (None, "the and", "en"), (905, "e", None), (906, " ".join(["ungein"] * 30_000), None), (rows[8][0], rows[8][1], rows[8][2])]
    found = language_id(frame(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    truth, got = {d: g for d, _, g in rows}, {r.doc_id: r for r in found}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert [(got[d].lang_pred, got[d].score) for d in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred in truth.values() and got[905].lang_pred in truth.values() and got[906].lang_pred == "de"


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = texts(docs=80)
    turned = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else g) for d, t, g in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language_id(frame(spark, x)).collect()} for x in (rows, turned))
    assert a == b


def test_sample_is_bounded_and_takes_every_language(spark):
    rows = texts(docs=200) + [(5000 + k, "solo", "xx") for k in range(9)]
    found = module.language_sample(frame(spark, rows), 4, 2, 40).collect()
    assert len(found) == 40 and {r.lang for r in found} == {"en", "de", "fr", "xx"}


def test_without_labels(spark):
    assert {(r.lang_pred, r.score) for r in language_id(frame(spark, [(1, "a b", None), (2, None, None)])).collect()} == {("und", 0.0)}
    assert language_id(frame(spark, [])).collect() == []
    assert {(r.lang_pred, r.score) for r in language_id(frame(spark, [(k, "a b", "en") for k in range(9)])).collect()} == {("en", 1.0)}


def test_query(spark, tmp_path):
    frame(spark, texts(docs=40)).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_language_id"](spark, str(tmp_path)).columns == ["doc_id", "held_out", "lang_pred", "score"]
