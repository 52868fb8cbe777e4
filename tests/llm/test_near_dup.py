import random
import re

import pytest
from pyspark.sql import functions as F

from quernel.llm import common, near_dup


def shingle_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    """(doc_id, text) -> the component of each row."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def corpus(rng, n=60):
    vocab = [f"w{i}" for i in range(60)] + ["é", "ÀB", "Tab\tted"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 80))]
        rows.append((i * 10, " ".join(words)))
        for c in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i * 10 + c + 1, rng.choice([" ", "\n", "  \t"]).join(x.upper() if rng.random() < 0.3 and x.isascii() else x for x in copy)))
    return rows


SCHEMA = "doc_id long, text string"


def query(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return near_dup.op7_minhash_dedup(spark, str(path)).collect()


def test_components_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = corpus(rng)
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One"), (9004, "one"), (9005, "two words"), (9006, "a b a b"), (9007, "z" * 3000), (9008, " x")]
    rng.shuffle(rows)
    sets, found = brute(rows, 2)
    low = {}
    for (i, _), c in zip(rows, found):
        low[c] = min(low.get(c, i), i)
    got = {r.doc_id: r for r in query(spark, tmp_path, rows)}
    assert len(got) == len(rows)
    for (i, _), s, c in zip(rows, sets, found):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low[c], low[c] == i), i


def test_hot_group_of_near_copies(spark, tmp_path):
    """Far more than a leaf holds: exact copies, and copies with a word changed; none may be lost, and no pair of all pairs is made."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 550):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(5000)}" for _ in range(40))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in query(spark, tmp_path, rows)}
    assert all(got[i] == 0 for i in range(550)) and all(got[1000 + i] == 1000 + i for i in range(100))
    docs = spark.createDataFrame(rows, SCHEMA)
    base_ = near_dup.table(near_dup.signatures(docs, "text", 2), "t").where("fp is not null").groupBy("fp").agg(F.first("sig").alias("sig"))
    assert near_dup.candidates(near_dup.table(base_, "v"), 0.8).count() < 401 * 40


def test_ids_null_and_repeated(spark, tmp_path):
    got = query(spark, tmp_path, [(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "q r s"), (None, None)])
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "7", True), ("None", "5", False), ("None", "None", True)]


def test_empty_table(spark, tmp_path):
    assert query(spark, tmp_path, []) == []


def test_keep_one(spark):
    rng = random.Random(4)
    rows = [(i, t, "x", i, None) for i, t in corpus(rng, 30)] + [(None, "p q r s t u", "x", 0, None), (None, "p q r s t u", "y", 0, None), (1, None, "x", 0, None), (2, "", "x", 0, None), (0, rows0 := "m n o p q r", "x", 0, None), (0, rows0, "x", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long, h1 string").repartition(3)
    kept = near_dup.keep_one(docs, k=5, threshold=0.8)
    assert kept.columns == docs.columns
    got = kept.collect()
    _, found = brute([(r[0], r[1]) for r in rows], 5)
    groups = {}
    for r, c in zip(rows, found):
        groups.setdefault(c, []).append(r[0])
    empty = 2
    firsts = sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
    assert sorted(str(r.doc_id) for r in got) == firsts and len(got) == len(groups) and empty == sum(not r.text for r in got)
    assert near_dup.keep_one(docs.limit(0)).count() == 0


def test_words_at_piece_ends(monkeypatch):
    text = " ".join("word" * (i % 7 + 1) + str(i) for i in range(400)).encode()
    whole = near_dup.word_hashes(text).tolist()
    monkeypatch.setattr(near_dup, "PIECE", 50)
    assert near_dup.word_hashes(text).tolist() == whole
    assert near_dup.word_hashes(b"a" * 300 + b" b").tolist()[1] == near_dup.word_hashes(b"b").tolist()[0]


@pytest.mark.parametrize("share", [1_000_000, 7])
def test_components(spark, share, monkeypatch):
    monkeypatch.setattr(common, "TASK_LINKS", share)
    links = spark.createDataFrame([(1, 2), (3, 2), (4, 3), (9, 8), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(50)], "a long, b long")
    got = {r.node: r.root for r in near_dup.components(links).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), 1), 8: 8, 9: 8, **dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(200, 251), 200)}
    assert near_dup.components(links.limit(0)).count() == 0


def test_shares_of_a_node_are_joined_up(spark, tmp_path, monkeypatch):
    """A node of several groups, dealt to many shares: the components are those of brute force."""
    monkeypatch.setattr(near_dup, "SHARE", 16)
    monkeypatch.setattr(near_dup, "LEAF", 4)
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for i in range(70):
            words = list(base)
            words[rng.randrange(100)] = f"x{i}"
            rows.append((g * 1000 + i, " ".join(words)))
    _, found = brute(rows, 2)
    low = {}
    for (i, _), c in zip(rows, found):
        low[c] = min(low.get(c, i), i)
    assert {r.doc_id: r.component_id for r in query(spark, tmp_path, rows)} == {i: low[c] for (i, _), c in zip(rows, found)}


def test_thue_morse_words_differ(spark, tmp_path):
    signs = ["".join("ba"[bin(i).count("1") % 2 ^ side] for i in range(4096)) for side in (0, 1)]
    rows = [(side, f"{signs[side][:n]} {signs[side][:n]}") for side in (0, 1) for n in (4096,)]
    assert len(set(near_dup.word_hashes(" ".join(s[:n] for s in signs for n in (256, 1024, 4096)).encode()).tolist())) == 6
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dup.op7_minhash_dedup(spark, str(tmp_path)).collect()} == {(0, 0, True), (1, 1, True)}


def test_words_longer_than_the_sums(monkeypatch):
    texts = [b"abcdefgh" * 9, b"ab cd", b"x" * 70 + b" y"]
    want = [near_dup.word_hashes(t).tolist() for t in texts]
    monkeypatch.setattr(near_dup, "SUMMED", 16)
    assert [near_dup.word_hashes(t).tolist() for t in texts] == want


def test_vertices_of_large_nodes_go_on_without_a_comparison(spark, monkeypatch):
    """Of 300 near copies all nodes are large: what is compared before the last level gives edges only, no row for each vertex that goes on."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k:])) for i in range(300) for k in [rng.randrange(400)]]
    made, real = [], near_dup.table

    def kept(df, name="table"):
        out = real(df, name)
        if name == "nodes":
            made.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(near_dup, "table", kept)
    out = near_dup.group(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert out.select("root").distinct().count() == 1
    assert all("sketch" not in columns for columns, _ in made)
    assert made[0][1] < 300 * near_dup.TREES / 10
