import random
import zlib

import numpy as np
import pytest

from quernel.llm import langid

WORDS = {"en": ["the", "and", "tion", "that", "with", "ough", "her"], "de": ["der", "und", "ich", "schaft", "ung", "ein", "über"], "fr": ["les", "que", "eau", "dans", "ément", "oi", "ç"]}


def make(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def slow_phrases(train, text):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def slow_model(model, samples):
    """Training strings and needs, by plain search."""
    trains, needs = [], []
    for lang in model.langs:
        read = ["".join(map(chr, model.read(t))) for t in samples[lang]]
        if len(read) == 1:
            read = [read[0][: (len(read[0]) + 1) // 2], read[0][(len(read[0]) + 1) // 2 :]]
        trains.append("".join(read[::2]))
        rest = "".join(read[1::2])
        needs.append((slow_phrases(trains[-1], rest) + 1) / (len(rest) + 1))
    return trains, needs


@pytest.mark.parametrize(("piece", "batch"), [(512, 4096), (7, 4096), (7, 5), (1, 3)])
def test_predictions_as_by_search(monkeypatch, piece, batch):
    """Phrases, languages and scores equal those of a plain parse of whole texts, wherever pieces and batches of them end; a language with little text too."""
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "BATCH_PIECES", batch)
    rng = random.Random(3)
    samples = {lang: [make(rng, lang, 60) for _ in range(4)] for lang in ("en", "de")} | {"fr": [make(rng, "fr", 3)]}
    model = langid.Model(samples)
    trains, needs = slow_model(model, samples)
    assert model.need.tolist() == pytest.approx(needs)
    texts = [make(rng, lang, n) + " Ж 12 x" for lang in WORDS for n in (1, 40, 200)] + ["a", samples["en"][0] * 3]
    want = [[slow_phrases(t, "".join(map(chr, model.read(x)))) for t in trains] for x in texts]
    assert model.phrases([model.read(x) for x in texts]).tolist() == want
    langs, scores = model.predict(texts)
    for x, lang, score in zip(want, langs, scores):
        rates = sorted((a / b, k) for k, (a, b) in enumerate(zip(x, needs)))
        assert lang == model.langs[rates[0][1]] and score == pytest.approx(rates[1][0] / (rates[0][0] + rates[1][0]))


def test_ties_go_to_the_first_name():
    model = langid.Model({"b": ["same words here"], "a": ["same words here"]})
    assert model.predict(["same words", None, "", "7"]) == (["a", "und", "und", "und"], [0.5, 0.0, 0.0, 0.0])


def docs(spark, n=240):
    rng = random.Random(9)
    rows = [(i, make(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 120)), lang if rng.random() < 0.9 else None, lang) for i in range(n)]
    rows += [(n, None, "en", None), (n + 1, "", "en", None), (n + 2, "12 !? \n", "en", None), (n + 3, "漢字", None, None), (n + 4, make(rng, "de", 60_000), None, "de"), (None, make(rng, "fr", 20), None, "fr")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_accuracy_and_contract(spark, tmp_path):
    rows, frame = docs(spark)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    out = langid.op10_langid(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    hits = held = 0
    for i, text, _, true in rows:
        r = by[i]
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) and 0 <= r.score <= 1
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in WORDS
        if r.held_out and true in WORDS:
            held += 1
            hits += r.lang_pred == true
    assert held > 30 and hits >= 0.97 * held
    assert by[len(rows) - 2].lang_pred == "de"


def test_labels_and_sources_are_no_inputs(spark):
    _, frame = docs(spark, 60)
    model = langid.learn(frame)
    a = langid.identify(frame, model).select("text", "lang_pred", "score").collect()
    b = langid.identify(frame.selectExpr("-doc_id AS doc_id", "text", "'en' AS lang", "score").repartition(3), model).select("text", "lang_pred", "score").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(frame, langid.learn(frame)).collect()] == [("und", 0)]
    one = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(frame, langid.learn(one)).collect()] == [("en", 1)]
    assert langid.identify(frame.limit(0), langid.learn(frame.limit(0))).count() == 0


def test_large_alphabets():
    """26 languages of 3000 letters each, which share none: learned and predicted, in some megabytes."""
    rng = random.Random(1)
    alphabet = [c for c in map(chr, [*range(0x3400, 0x9FFF), *range(0x20000, 0x2A000), *range(0xAC00, 0xD7A3)]) if c.isalpha()]
    words = [["".join(own[i : i + 2]) for i in range(0, 3000, 2)] for own in (alphabet[k * 3000 : k * 3000 + 3000] for k in range(26))]
    assert sum(map(len, words)) == 26 * 1500
    samples = {f"l{k:02}": ["".join(rng.choice(own) for _ in range(700)) for _ in range(12)] for k, own in enumerate(words)}
    model = langid.Model(samples)
    assert model.bytes < 40 << 20 and model.symbols > 60_000
    texts = ["".join(rng.choice(own) for _ in range(80)) for own in words]
    assert model.predict(texts)[0] == sorted(samples)


def test_languages_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOC_CHARS", 50)
    monkeypatch.setattr(langid, "LONG_CHARS", 2000)
    rng = random.Random(2)
    rows = [(i, make(rng, "de", 4), "de") for i in range(20)] + [(30 + i, make(rng, "fr", 60 + i), "fr") for i in range(3)] + [(40, make(rng, "en", 5000), "en")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "fr"]  # en's only text is longer than what is learned from
    assert model.predict([make(rng, "fr", 30), make(rng, "de", 30)])[0] == ["fr", "de"]
