import hashlib
import random

from quernel.llm import mixing


def brute_targets(sizes, weights, limit=3):
    """sizes by source -> targets, by clamping one round at a time."""
    total, clamped = sum(sizes.values()), set()
    while True:
        free = {s: weights[s] for s in sizes if s not in clamped}
        left = total - sum(limit * sizes[s] for s in clamped)
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s, x in share.items() if x > limit * sizes[s]}
        if not over:
            return {s: limit * sizes[s] if s in clamped else share[s] for s in sizes}
        clamped |= over


def table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return {r.doc_id: r for r in mixing.op6_mixing(spark, str(path)).collect()}


def test_targets_and_taken(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "a", "é", "z", None, "\U0001f600"]), None, 0) for i in range(400)]
    rows += [(1000, "tiny", "tiny", None, 0), (1001, None, "none", None, 0)]
    out = table(spark, tmp_path, rows)
    sizes = {}
    for i, text, source, *_ in rows:
        assert out[i].size == len((text or "").split())
        sizes[source] = sizes.get(source, 0) + out[i].size
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    targets = brute_targets(sizes, weights)
    taken = dict.fromkeys(sizes, 0)
    for i, _, source, *_ in rows:
        assert abs(out[i].target - targets[source]) < 1e-6 * max(1, targets[source])
        assert 0 <= out[i].taken <= 3 * out[i].size
        taken[source] += out[i].taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1
    again = {r.doc_id: r.taken for r in mixing.op6_mixing(spark, str(tmp_path)).collect()}
    assert again == {i: r.taken for i, r in out.items()}


def test_ties_repeated_rows_and_empty(spark, tmp_path):
    out = table(spark, tmp_path / "a", [(7, "a b c", "s", None, 0)] * 5 + [(None, None, None, None, None), (8, "x", "t", None, 0)])
    assert out[None].taken == 0 and out[7].taken <= 9
    assert table(spark, tmp_path / "b", []) == {}


def test_documents_as_mixed(spark):
    rows = [(i, f"  a{i} b{i}\n c{i}  ", "s" if i % 3 else "t", 9, hashlib.md5(b"x").hexdigest()) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = out.collect()
    words = sum(len(r.text.split()) for r in got)
    assert abs(words - 180) <= 2 and all(r.size == 9 for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
