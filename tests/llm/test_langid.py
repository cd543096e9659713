import pytest

from pathloom.llm import langid, queries

WORDS = {"en": "the and of with that was for this", "de": "der und nicht mit für auf ist ein", "fr": "le et des avec pour dans est une"}


def _rows(n=300):
    import random

    rng = random.Random(2)
    return [(" ".join(rng.choices(WORDS[lang].split(), k=30)), lang) for lang in WORDS for _ in range(n // 3)]


@pytest.fixture(scope="module")
def model():
    return langid.train(_rows())


def test_learns_and_repeats(model):
    pred, score = model.predict([t for t, _ in _rows()])
    assert sum(p == lang for p, (_, lang) in zip(pred, _rows(), strict=True)) >= 298 and all(0 <= s <= 1 for s in score)
    assert (langid.train(_rows()).table == model.table).all()


def test_odd_texts(model):
    assert model.predict(["", " \n", "123 --"]) == (["und"] * 3, [0.0] * 3)
    (pred,), (score,) = model.predict(["你好世界 再见"])
    assert pred in WORDS and score < langid.REJECT_BELOW
    foreign, mixed = "你好世界 再见 что это такое", "the and of with " * 20 + "der und nicht mit " * 20
    assert model.judge([foreign, mixed, "12", "the and of"])[2] == [True, False, True, False]
    assert langid.train([]).predict(["some text"]) == (["und"], [0.0])
    assert langid.train([("only one", "en")]).predict(["some text"])[0] == ["en"]


def test_long_texts_are_read_whole(model, monkeypatch):
    text = ("the and of " * 200 + "der und nicht " * 900).strip()
    whole = model.probabilities([text])
    monkeypatch.setattr(langid, "GROUP_CHARS", 500)
    assert abs(model.probabilities([text]) - whole).max() < 1e-6 and model.predict([text])[0] == ["de"]


def test_columns(odd, nothing, model):
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.rejected)
    assert langid.predict(nothing, model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    rows = found.collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98 and sum(r.rejected for r in rows) / len(rows) < 0.01


def test_parts_of_a_long_text_have_all_its_ngrams(monkeypatch):
    """Also of a run without white space, which is cut within a word."""
    import numpy as np

    text = "äbc" * 4000 + " the and " * 50 + "xyz" * 1000
    rows = np.sort(langid.subwords([text])[0])
    at, counts = langid.counted(text)
    monkeypatch.setattr(langid, "GROUP_CHARS", 101)
    assert (np.repeat(*map(np.array, langid.counted(text))) == rows).all() and (np.repeat(at, counts) == rows).all()


def test_whole_texts_are_learned():
    """The language of a text shows only far behind its beginning."""
    rows = [("12 34 " * 2000 + " ".join([w] * 40), lang) for lang in WORDS for w in WORDS[lang].split()]
    model = langid.train(rows)
    assert model.predict([w for w in ("the", "der", "des")])[0] == ["en", "de", "fr"]


def test_sample_by_language_and_text(spark):
    """A language of few rows in thousands is learned beside a hot text and a hot language."""
    hot = [("the same text of many rows and of no other", "en")] * 3000
    many = [(f"der und nicht mit {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}wort für auf", "de") for k in range(2000)]
    rare = [(f"le et des avec pour dans est une langue rare {w}", "fr") for w in WORDS["fr"].split() * 4] + [(None, "fr"), ("no label at all", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(hot + many + rare)], "doc_id bigint, text string, lang string")
    model = langid.fit(df, sample_rows=200)
    assert model.languages == ["de", "en", "fr"] and model.predict(["des avec pour une"])[0] == ["fr"]
    assert langid.fit(df.where("lang is null")).languages == []


def test_foreign_texts_go_however_sure_the_model_is(model):
    far = langid.Model(model.languages, model.table * 50, model.bias, 1.0, model.seen, model.usual)
    pred, score, rejected = far.judge(["Hallitus ilmoitti tänään uudesta koululaista josta keskustellaan eduskunnassa", "the and of with that"])
    assert score[0] > langid.REJECT_BELOW and rejected == [True, False]


def test_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "the and of", "x", "y", 5, "z")], "doc_id bigint, text string, lang_pred string, score string, rejected int, h string")
    row = langid.predict(df, model).first()
    assert (row.doc_id, row.lang_pred, row.rejected, row.h) == (1, "en", False, "z")
    assert langid.fit(df.selectExpr("*", "'en' AS lang", "'q' AS n", "'r' AS rank")).languages == ["en"]
