import random
import re
from collections import Counter

import duckdb
import pytest

from quernel.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def texts():
    rng = random.Random(3)
    prose = "the cat and a dog, of the house; in that garden it was for us"
    out = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b a b a b", "é 漢 😀 é 漢 😀", "a \na\na \n\n\na", "\x0b\x0c\r", "#*$%&|<> |", prose * 6, (prose + "\n") * 9, "THE " * 60, "word " * 70, " ".join(f"w{i}" for i in range(80))]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "the", "Of", "#", "é", "1", "|"]) + rng.choice(["", " ", " ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 150))))
    return out


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("quality"))
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows + rows[:9], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return rows, quality.op13_quality(spark, path), path


def test_counts_equal_brute_force(judged):
    rows, out, _ = judged
    found = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) + 9
    for i, text in rows:
        r = found[i]
        n_words, *_, n_repeat = want = brute(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, repr(text)
        assert r.base_failed == (n_words < 50 or 100 * n_repeat > 50 * n_words)
        assert r.kept == (r.failed == "") and not (r.base_failed and r.kept)


def test_sql(judged, spark):
    _, out, path = judged
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    found = con.execute(quality.SQL)
    names = [c[0] for c in found.description]
    assert names == out.columns
    key = lambda t: str(t)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(found.fetchall(), key=key)


def test_rules(spark):
    prose = " ".join(f"the house{i} and dog{i} of garden{i} is green{i}" for i in range(10))
    cases = {"": prose, "few_words": "the cat", "symbols": prose.replace("is green", "is $$$ green"), "capitals": prose.upper(), "stop_words": " ".join(f"wort{i}" for i in range(90)), "word_length": " ".join(f"of {'x' * 40}{i}" for i in range(50)), "words_without_letter": prose + " 123" * 0 + " ".join(f" {i}" for i in range(200))}
    out = quality.judge(spark.createDataFrame([(k, v, "mine", 7) for k, v in cases.items()], "want string, text string, kept string, extra int")).collect()
    for r in out:
        assert r.failed == ([r.want] if r.want else []) and r.kept == (r.want == "") and r.extra == 7, r.want
    only = {"short": ("n_words", None, None, 100)}
    assert quality.judge(spark.createDataFrame([(prose,)], "text string"), rules=only).first().kept
    assert quality.judge(spark.createDataFrame([], "text string")).count() == 0


def test_long_text_and_no_python(spark, judged):
    _, out, _ = judged
    assert not re.search("Python|Arrow|Pandas|Exchange", out._jdf.queryExecution().executedPlan().toString())
    text = " ".join(f"w{i % 70_000}" for i in range(140_000)) + "\n" + "z" * 1_000_000
    r = quality.judge(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.n_words, r.n_repeat_words) == (140_001, 140_000)


def test_clean_documents_stay(spark):
    for sf in ("sf0.01",):
        path = f"/root/testdata/{sf}"
        labels = spark.read.parquet(f"{path}/labels.parquet").where("quality = 1").select("doc_id")
        out = quality.op13_quality(spark, path).join(labels, "doc_id").where("not base_failed")
        assert out.where("not kept").count() <= 0.01 * out.count()
        low = spark.read.parquet(f"{path}/labels.parquet").where("quality = 0").select("doc_id")
        bad = quality.op13_quality(spark, path).join(low, "doc_id")
        assert bad.where("kept").count() <= 0.2 * bad.count()


