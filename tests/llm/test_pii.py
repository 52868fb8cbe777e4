import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quernel.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 9 <= len(number) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None,
    "",
    "mail a@b.c_foo@bar.com, x@y x@y. x@y.z. 😀 me@host.example.org é",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 9.9.9 10.0.0.256 12.34.56.78",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5500 0000 0000 0004",
    "+1 (555) 123-4567 +12 +123456789 +1234567890123456 ++49 30 1234567.",
    "iban DE89 3704 0044 0532 0130 00 and DE89370400440532013001; ssn 123-45-6789",
    "no context 123-45-6789",
    "a" * 5_000,
    "a@" * 3_000,
    "a@b" + ".c" * 3_000,
    "1" * 5_000,
    "1 " * 3_000 + "1-" * 2_000,
    "1." * 6_000,
    "+1" + "-" * 5_000,
    "x@y.zz " * 2_000,
    "the key 24be64439e3e49cf46b2d7c90f3602a3d0b907ff is my token; " + "-" * 60 + " api_key: aaaaaaaaaaaaaaaaaaaaaaaaaaaa1",
    "no word beside 24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
    "token of commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff",
    "my bank: DE89370400440532013000" + "." * 50 + "tracking DE89370400440532013000",
]


def rows(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return {r.doc_id: r.pii for r in pii.find(frame).select("doc_id", "pii").collect()}


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["1", "23", "4111", "256", ".", "-", " ", "+", "@", "a", "b.c", "_", "(", ")", "é", "😀", "@x.y"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts = TEXTS + mixed
    found = rows(spark, texts)
    for i, text in enumerate(texts):
        base = [f"{s.kind}:{s.start}:{s.end}" for s in found[i] if s.kind in pii.BASE]
        assert base == brute(text), text[:200] if text else text


def test_long_runs_take_linear_time(spark):
    """The plain patterns would take hours on some of these."""
    long = {"a" * 500_000: 0, "a@" * 200_000: 0, "a@b" + ".c" * 200_000: 1, "1" * 500_000: 0, "1 " * 200_000: 0, "1." * 400 + "x": 100, "+1" + "-" * 500_000: 0}
    found = rows(spark, list(long))
    assert [len(found[i]) for i in range(len(long))] == list(long.values())


def test_many_matches_take_linear_time(spark):
    text = "from 10.0.0.1 to 10.0.0.2, " * 8_000
    found = rows(spark, [text])[0]
    assert [f"{s.kind}:{s.start}:{s.end}" for s in found if s.kind in pii.BASE] == brute(text)


def test_checks_and_context(spark):
    found = rows(spark, TEXTS)
    assert [(s.kind, s.start, s.end) for s in found[6] if s.kind in ("iban", "ssn")] == [("iban", 5, 32), ("ssn", 65, 76)]
    assert not [s for s in found[7] if s.kind == "ssn"]
    scores = {s.kind: s.score for s in found[5]}
    assert scores["phone"] == pytest.approx(0.7)
    assert all(s.score == pytest.approx(1.0) for s in found[4] if s.kind == "card" and s.start < 40)


def test_context_on_both_sides_raises_and_lowers(spark):
    found = rows(spark, TEXTS[-4:])
    extra = [[(s.kind, s.start, s.end) for s in found[i] if s.kind not in pii.BASE] for i in range(4)]
    assert extra == [[("secret", 8, 48)], [], [], [("iban", 9, 31)]]


def test_a_column_like_the_operators_own_stays(spark):
    frame = spark.createDataFrame([("a@b.c", "x", "y")], "text string, __email string, ___ip string")
    assert [tuple(r)[:3] for r in pii.find(frame).collect()] == [("a@b.c", "x", "y")]


def test_digest(spark, tmp_path):
    text = "write to me@host.org or +49 30 1234567"
    spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = pii.op2_pii(spark, str(tmp_path)).collect()
    assert len(out) == 3
    known = hashlib.sha256(",".join(brute(text)).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.base_sha256) for r in out) == sorted([("1", known)] * 2 + [("None", hashlib.sha256(b"").hexdigest())])


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "text string")).count() == 0


def test_native(spark):
    plan = pii.find(spark.range(3).select(F.lit("a@b.c").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
