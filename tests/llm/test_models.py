"""Language identification and quality classification: held-out accuracy, gradients, odd rows."""

import zlib

import numpy as np
import pytest

from spendscope.llm import byte_cnn, nbsvm
from spendscope.llm.byte_cnn import ByteCnn, identify_language, windows_of
from spendscope.llm.nbsvm import ngram_sets, score_quality
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def test_windows_cover_the_text():
    windows, lengths = windows_of("Ab" * 300, 256)
    assert windows.shape == (3, 256) and lengths.tolist() == [256, 256, 88]
    assert windows.ravel()[:600].tobytes() == b"ab" * 300 and not windows.ravel()[600:].any()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    model = ByteCnn.fresh(["a", "b", "c"], rng, filters=3)
    for p in model.parameters():
        p += rng.normal(0, 0.2, p.shape).astype(np.float32)
    model.tables = [t.astype(np.float64) for t in model.tables]
    x, y = rng.integers(97, 101, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        chances = byte_cnn.softmax(np.maximum(model.highest(x), 0) @ model.dense.astype(float) + model.offset)
        return -np.log(chances[np.arange(6), y]).mean()

    for p, g in zip(model.parameters(), model.gradients(x, y), strict=True):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 40)]:
            before = p[at]
            p[at] = before + 1e-3
            up = loss()
            p[at] = before - 1e-3
            down = loss()
            p[at] = before
            assert (up - down) / 2e-3 == pytest.approx(g[at], abs=2e-3)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify_language(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert found["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_training_sample_is_spread_over_languages_and_texts(spark):
    rows = [(i, "a" * 5000 + "z" * 5000, "en") for i in range(4000)] + [(10_000 + i, f"b{i}", "rare") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = byte_cnn.training_sample(docs, "text", "lang", "doc_id", 200, 1000)
    rare = [i for i, _, v in rows if v == "rare" and zlib.crc32(str(i).encode()) % 4 != 2]
    assert langs.count("en") == 100 and langs.count("rare") == len(rare)
    assert all(len(t) <= 1000 for t in texts)
    late = sum("z" in t for t in texts) / 100
    assert 0.6 < late < 0.9  # of two stretches at least one lies in the later half, mostly


def test_languages_of_odd_rows(spark, docs_of):
    model = byte_cnn.train(["the cat is here " * 20, "der Hund ist da " * 20] * 4, ["en", "de"] * 4, epochs=2)
    found = {(r["doc_id"], r["lang_pred"]) for r in identify_language(docs_of([*ODD, (20, "123 !? ½²Ⅷ")]), keep=("score", "keys"), model=model).collect()}
    assert {d for d, p in found if p == "und"} == {7, 8, 9, 20} and {p for _, p in found} <= {"und", "en", "de"}
    assert identify_language(docs_of([]), model=model).count() == 0
    nothing = identify_language(docs_of(ODD).selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, labels).toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    assert found["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]
    assert (found["predicted"] == (found["score"] >= 0.3)).all()
    held = found[found["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() > 0.97


def test_quality_of_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)], "doc_id long, quality int, toxic int, score string")
    rows = [(i, "plain words of prose" if i % 2 else "$$$ %%% $$$ win!!") for i in range(40)]
    found = {r["doc_id"]: r for r in score_quality(docs_of([*rows, (100, None), (101, ""), (None, "some prose"), (102, "prose " * 9000)]), labels, keep=("score",)).collect()}
    assert len(found) == 44 and found[1]["predicted"] == 1 and found[2]["predicted"] == 0
    assert found[100][3] == found[101][3]  # the column kept from the input stands before
    assert score_quality(docs_of([]), labels).count() == 0
    assert {r["score"] for r in score_quality(docs_of(rows), labels.where("quality = 1")).collect()} == {1.0}
    assert {r["score"] for r in score_quality(docs_of(rows), labels.limit(0)).collect()} == {0.5}


def test_shapes_do_not_reach_over_texts():
    """The n-grams of a text do not depend on the texts beside it."""
    texts = ["same", "same same SAME a1 $x", "", None, "ab", "é"]
    together = list(ngram_sets(texts))
    assert [s.tolist() for s in together] == [next(ngram_sets([t])).tolist() for t in texts]
    assert len(together[2]) == len(together[3]) == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.append(rng.integers(0, 500, 20), 1000 + (k % 2))) for k in range(200)]
    labels = np.arange(200) % 2
    model = nbsvm.train(sets, labels)
    assert all((model.score(s) > 0.5) == bool(v) for s, v in zip(sets, labels, strict=True))


def test_repeated_id_is_one_training_document(spark):
    from spendscope.llm.nbsvm import training_sample

    rows = [(i, f"text number {i} of some words") for i in range(40)]
    first = spark.createDataFrame([(i, i // 20) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([*rows, *((i, f"again {n}") for i in range(20) for n in range(10))], "doc_id long, text string")
    sets, labels = training_sample(docs, first, "text", "quality", "doc_id", 60)
    once, expected = training_sample(spark.createDataFrame(rows, "doc_id long, text string"), first, "text", "quality", "doc_id", 60)
    assert len(sets) == len(once) and labels.tolist() == expected.tolist() and set(labels.tolist()) == {0, 1}
