import numpy as np

from quernel.llm import embed_dup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold=0.93):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links, parent = [0] * n, list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    return links, [find(i) for i in range(n)]


def test_links_and_components(spark):
    rng = np.random.default_rng(3)
    rows = []

    def put(v, label):
        rows.append((len(rows), None if v is None else [float(x) for x in v], label, "clash"))

    for g in range(12):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 8))):
            put(center + rng.standard_normal(16) * 0.12, g % 3)
    hot = rng.standard_normal(16)
    for i in range(60):
        put(hot + rng.standard_normal(16) * 0.05, 1)
    for _ in range(5):
        put(hot, 1)
        put(hot * 2, 1)
    for _ in range(150):
        put(rng.standard_normal(16), int(rng.integers(0, 3)))
    odd = [[1.0] * 15 + [float("nan")], [0.0] * 16, [1.0] * 15 + [float("inf")], [], None, [1.0] * 8]
    for v in odd:
        put(v, 1)
    rows.append((len(rows), [1.0] * 15 + [None], 1, "clash"))
    put(hot, None)
    got = {r.vec_id: r for r in embed_dup.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    links, found = brute(rows)
    low = {}
    for i, c in enumerate(found):
        low[c] = min(low.get(c, i), i)
    assert [got[i].n_links for i in range(len(rows))] == links
    assert [(got[i].component_id, got[i].kept) for i in range(len(rows))] == [(low[c], low[c] == i) for i, c in enumerate(found)]


def test_null_and_repeated_ids_and_empty(spark):
    v = [1.0, 2.0]
    rows = [(3, v, 1, ""), (3, v, 1, ""), (None, v, 1, ""), (None, None, 1, "")]
    got = embed_dup.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", True), ("None", 2, "3", False)]
    assert embed_dup.link(spark.createDataFrame([], SCHEMA)).count() == 0


def clumps(sizes, apart=0.31, label=1):
    """Tight clumps around directions of a plane, each the given angle from the one before."""
    rng = np.random.default_rng(11)
    out = []
    for c, size in enumerate(sizes):
        center = np.zeros(16)
        center[0], center[1] = np.cos(c * apart), np.sin(c * apart)
        out += [(center + rng.standard_normal(16) * 0.001, label) for _ in range(size)]
    return [(i, [float(x) for x in v], k, "") for i, (v, k) in enumerate(out)]


def test_links_beyond_full_lists(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "STRIPE", 16 * 8 * 10)  # several stripes
    rows = clumps([12, 12]) + [(i + 24, v, 2, "") for i, v, *_ in clumps([13, 30, 12])]
    got = {r.vec_id: r for r in embed_dup.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    links, _ = brute(rows)
    assert links[:24] == [23] * 24
    assert [got[i].n_links for i in range(len(rows))] == links
    assert [got[i].component_id for i in range(len(rows))] == [0] * 24 + [24] * 55
    assert sorted(i for i in got if got[i].kept) == [0, 24]


def test_planted_links_without_an_exhaustive_pass(spark, monkeypatch):
    """20,000 vectors with 50 planted links a label: the lists find them, the audit adds none and is a small part of all pairs."""
    compared = []
    real = embed_dup.against

    def counted(members, picked, threshold):
        compared.append(members.count() * picked.count())
        return real(members, picked, threshold)

    monkeypatch.setattr(embed_dup, "against", counted)
    rng = np.random.default_rng(5)
    vectors, labels = rng.standard_normal((20_000, 32)).astype(np.float32), np.arange(20_000) % 4
    pairs = set()
    for label in range(4):
        own = rng.permutation(np.flatnonzero(labels == label))[:100].reshape(50, 2)
        for a, b in own:
            vectors[b] = vectors[a] + rng.standard_normal(32).astype(np.float32) * 0.25 * rng.random()
            pairs.add((int(a), int(b)))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    pairs = {(a, b) for a, b in pairs if unit[a] @ unit[b] >= 0.93}
    assert len(pairs) > 150
    report = {}
    frame = spark.createDataFrame([(i, v.tolist(), int(k), "") for i, (v, k) in enumerate(zip(vectors, labels))], SCHEMA)
    got = {r.vec_id: r for r in embed_dup.link(frame, report=report).collect()}
    hit = sum(got[a].component_id == got[b].component_id for a, b in pairs)
    assert hit >= 0.99 * len(pairs)
    assert not report["exact"] and report["rounds"] <= embed_dup.LEAST
    assert sum(compared) < 0.05 * 20_000**2 / 4
    linked = sum(r.n_links for r in got.values())
    assert 2 * hit <= linked <= 2 * hit + 20


def test_lists_are_enlarged(spark):
    """A vertex whose K places are all taken by what may be links gets room for more, and a further step fills it."""
    rows = clumps([30])
    vertices = spark.createDataFrame([(i, v) for i, v, *_ in rows], "id long, v array<double>").selectExpr("id", "1 AS label", "16 AS dim", "v", "1L AS copies")
    vertices = embed_dup.as_bytes(vertices).selectExpr("id", "dim", "q", "raw", "30L AS n", "7L AS `group`")
    lists = embed_dup.refine(embed_dup.merged(embed_dup.first_lists(embed_dup.buckets(vertices, 0))), vertices)
    full = embed_dup.saturated(lists, None, 0.93)
    assert full.count() == 30 and {r.cap for r in full.collect()} == {embed_dup.K}
    room = full.selectExpr("v", "20 AS cap").where("v < 10")
    wider = embed_dup.refine(lists, vertices, room).groupBy("v").count().collect()
    assert {r["count"] for r in wider if r.v < 10} == {20} and {r["count"] for r in wider if r.v >= 10} == {embed_dup.K}


def test_chains_of_clumps(spark, monkeypatch):
    """Clumps of more vertices than a list holds at first, whose links to one another every list drops."""
    monkeypatch.setattr(embed_dup, "K", 3)
    rows = clumps([8, 8, 8], apart=0.3)
    got = [r for r in embed_dup.link(spark.createDataFrame(rows, SCHEMA)).collect()]
    links, found = brute(rows)
    assert {r.component_id for r in got} == {0} and {r.vec_id: r.n_links for r in got} == dict(enumerate(links))


def test_a_failed_audit_ends_in_an_exact_comparison(spark, monkeypatch):
    monkeypatch.setattr(embed_dup, "first_lists", lambda placed: placed.sparkSession.createDataFrame([], embed_dup.EDGES))
    monkeypatch.setattr(embed_dup, "ROUNDS", 2)
    monkeypatch.setattr(embed_dup, "LINKS", 1)
    rows, report = clumps([3, 4]), {}
    got = [r for r in embed_dup.link(spark.createDataFrame(rows, SCHEMA), report=report).collect()]
    assert {(r.n_links, r.component_id) for r in got} == {(6, 0)} and report["exact"]


def test_few_links_are_audited_once(spark, monkeypatch):
    """Fewer than LINKS links: a later round asks whether they lie within components by now, which gives what a comparison would."""
    monkeypatch.setattr(embed_dup, "AUDIT", 1_000_000)
    rows = clumps([3, 4])
    schema = "id long, `group` long, dim int, n long, raw binary, root long"
    members = lambda roots: spark.createDataFrame([(i, 7, 16, 7, embed_dup.unit(v).tobytes(), roots[i]) for i, v, *_ in rows], schema)
    kept, compared = {}, []
    real = embed_dup.against
    monkeypatch.setattr(embed_dup, "against", lambda *x: compared.append(1) or real(*x))
    for roots, same in (([0, 1, 2, 3, 3, 3, 6], 6), ([0, 0, 2, 3, 3, 3, 6], 8), ([0, 0, 0, 3, 3, 3, 3], 18)):
        assert embed_dup.audit(members(roots), 0.96, kept) == embed_dup.audit(members(roots), 0.96, {}) == {0: (18, same)}
    assert len(compared) == 4
