"""Rejection of texts in no known language, and what counts as a letter."""

import random

import pytest

from ledgerspark.llm import langid

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model_and_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.withColumn("held", langid.held_out("doc_id")).filter("held AND text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").collect()
    return langid.trained(docs), rows


def test_held_out_texts_are_told_and_kept(model_and_rows):
    model, rows = model_and_rows
    found, scores, rejected = model.predict([r.text for r in rows])
    right = [f == r.lang for f, r in zip(found, rows)]
    assert sum(right) >= 0.98 * len(rows) and sum(r and ok for r, ok in zip(rejected, right)) <= 0.01 * len(rows)
    assert all(0 <= s <= 1 for s in scores)
    # The temperature lies inside its grid.
    assert 0.021 < model.temperature < 19


SCRIPTS = {"latin": "abcdefghijklmnopqrstuvwxyz     ", "greek": "αβγδεζηθικλμνξοπρστυφχψω    ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя     ", "han": "的一是不了人我在有他这中大来上国", "devanagari": "अआइईउऊएऐओऔकखगघचछजझटठ    "}


@pytest.mark.parametrize("script", SCRIPTS)
def test_other_scripts_and_random_letters_are_rejected(model_and_rows, script):
    draw = random.Random(3)
    texts = ["".join(draw.choice(SCRIPTS[script]) for _ in range(draw.randint(30, 400))) for _ in range(200)]
    assert sum(model_and_rows[0].predict(texts)[2]) >= 180


def test_shuffled_letters_are_rejected(model_and_rows):
    draw = random.Random(4)
    texts = ["".join(draw.sample(list(r.text[:400]), len(r.text[:400]))) for r in model_and_rows[1] if len(r.text) > 60]
    assert sum(model_and_rows[0].predict(texts)[2]) >= 0.9 * len(texts)


def test_numbers_are_no_letters(model_and_rows):
    texts = ["½", "²", "①", "Ⅻ", "123", "", " _ ", "٣", "€"]
    found, scores, rejected = model_and_rows[0].predict(texts)
    assert set(found) == {"und"} and not scores.any() and all(rejected)
    assert "und" not in model_and_rows[0].predict(["a", "é", "日", "ª", "x½"])[0]


def test_one_language_alone():
    words = ["the tree stands in the garden behind the house", "a river runs along the old road to the town", "they read the letter and went home again"]
    model = langid.fit([" ".join([w] * n) for w in words for n in range(1, 12)], ["en"] * 33)
    assert model.predict(["the garden behind the old house"])[0] == ["en"]
    assert langid.fit([], []).predict(["x"])[0] == ["und"]
