import hashlib
import random

import duckdb

from quernel.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.md5(f"<|{r or ''}|>\n{x or ''}<|end|>\n".encode()).digest()
            convs.setdefault(c, []).append((t is not None, t or 0, digest, r or "", x or ""))
    said = {c: tuple((r, x) for *_, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, v in said.items():
        if any((w[: len(v)] == v and len(w) > len(v)) or (w == v and d < c) for d, w in said.items()):
            continue
        out[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in v)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        base = rng.choice(["a", "b", "c"])
        rows += [(c, t + rng.choice([0, 5]) * 0, "user" if t % 2 == 0 else "assistant", f"{base}{t}" if rng.random() < 0.95 else "other") for t in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "lost"), (500, None, None, None), (501, 0, "user", ""), (502, 0, "user", "x"), (502, 0, "user", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r.conv_id: r.rendered for r in chat.render(frame).collect()} == brute(rows)


def test_empty_and_long(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, t, "user", "y" * 1000) for t in range(300)] + [(2, t, "user", "y" * 1000) for t in range(299)]
    out = chat.render(spark.createDataFrame(long, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns) for r in out] == [(1, 300)]


def test_tied_turns_as_in_sql(spark, tmp_path):
    """Turns that tie, have no number or repeat: the order is the brute force's and the SQL's."""
    rng = random.Random(9)
    rows = []
    for c in range(200):
        rows += [(c, rng.choice([None, 0, 1, 1, 2]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "\U0001f600", "", None])) for _ in range(rng.randint(1, 5))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: (r.n_turns, r.n_chars, r.rendered) for r in chat.op4_chat(spark, str(tmp_path)).collect()}
    assert {c: x[2] for c, x in out.items()} == brute(rows)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert out == {c: tuple(x) for c, *x in db.execute(chat.SQL).fetchall()}
