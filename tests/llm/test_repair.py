import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from quernel.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv, turn, role, text) -> conv -> its rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        at = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        seed = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(seed.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        at += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for at in out.values():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def brute(turns):
    """The result for one conversation: Dijkstra over (turn, roles so far as far as they matter) with (cost, audit) as the key."""
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # roles so far: any start of a sentence of the grammar is known by its last two roles and whether it is empty
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(heap)
        key = (i, said[:1] and said[-2:])
        if key in done:
            continue
        done.add(key)
        if i == len(turns) and GRAMMAR.match(said):
            text = "\n".join(lines)
            return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), wrong, cost, audit, hashlib.sha256(text.encode()).hexdigest()
        grows = lambda c: any(GRAMMAR.match(said + c + rest) for rest in ("", "a", "ua"))
        for role in ("user", "assistant"):
            if grows(role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, said + role[0], (*lines, role + ":")))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, said, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] in ("s", "u", "a") and grows(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said + role[:1], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if grows(new[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, said + new[0], (*lines, f"{new}:{text}")))


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, fault string, copies string"


def query(spark, rows, path):
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return repair.op11_repair(spark, path)


def check(out, rows):
    want = {c: brute(t) for c, t in damaged(rows).items()}
    found = {r.conv_id: tuple(r[n] for n in NAMES) for r in out}
    assert len(out) == len(found)
    for c in {*want, *found}:
        assert found[c] == want[c], (c, damaged(rows)[c])


def conversations(seed, n=250):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No", "", " \t", "Why?", "And so on", "é 漢!", "One. \n", "x\x00y."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "Ürgh"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            fine = rng.random() < 0.5
            rows.append((c, t + rng.choice([0, 0, 0, 3]) if rng.random() < 0.95 else None, ("user", "assistant")[t % 2] if fine else rng.choice(roles), f"{t} fine." if fine else rng.choice([*texts, None])))
    return rows


def test_equals_brute_force(spark, tmp_path):
    rows = conversations(1)
    rows += [(None, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(4)] + rows[:30]
    rows += [(900 + c, 0, "user", "?") for c in range(40)]  # some of these lose their only turn
    check(query(spark, rows, str(tmp_path)).collect(), rows)


@pytest.mark.parametrize("tasks", [1, 7])
def test_blocks_of_a_few_turns(spark, tmp_path, tasks):
    """Long conversations over many blocks, each entered from every state."""
    rng = random.Random(tasks)
    rows = conversations(2, 30)
    for c in range(1000, 1006):
        rows += [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"{t}.", "Ok.", "cut", f"{t} cut", ""])) for t in range(rng.randint(40, 150))]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA).repartition(tasks)
    check(repair.repair(repair.damaged(frame), block=9).withColumnRenamed("conv", "conv_id").collect(), rows)


def test_a_turn_said_often(spark, tmp_path):
    rows = [(1, 0, "user", "Hello.")] * 3000 + [(1, 5, "user", "Hello.")] * 500 + [(1, 2, "assistant", "Oh, " + "very " * 200_000 + "long.")]
    out = query(spark, rows, str(tmp_path)).collect()
    check(out, rows)
    assert len(out[0].audit) > 3000 or out[0].audit in ("", "IK", "KI")


def test_empty_table(spark, tmp_path):
    out = query(spark, [], str(tmp_path))
    assert out.count() == 0 and out.columns == ["conv_id", *NAMES]


def test_string_ids(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), (" ", 1, "user", "Hi."), (None, 1, "assistant", "Hm.")]
    frame = spark.createDataFrame(rows, "c string, n int, r string, t string")
    out = repair.repair(repair.damaged(frame, "c", "n", "r", "t")).withColumnRenamed("conv", "conv_id").collect()
    check(out, rows)


def test_sql():
    rows = conversations(3)
    rows += [(None, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(4)] + rows[:30] + [(900 + c, 0, "user", "?") for c in range(40)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    out = con.execute(repair.SQL)
    assert [c[0] for c in out.description] == ["conv_id", *NAMES]
    assert {r[0]: r[1:] for r in out.fetchall()} == {c: brute(t) for c, t in damaged(rows).items()}
