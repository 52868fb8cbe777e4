import random

from quernel.llm import line_dedup

SCHEMA = "doc_id long, source string, text string, n_lines string, keys long"
SPACE = " \t\n\v\f\r"


def brute(rows, ratio=0.1, least=5):
    pages, total = {}, {}
    for _, host, text, *_ in rows:
        total[host] = total.get(host, 0) + 1
        for x in {x.strip(SPACE) for x in (text or "").split("\n")} - {""}:
            pages[host, x] = pages.get((host, x), 0) + 1
    gone = {k for k, n in pages.items() if n >= least and n > total[k[0]] * ratio}
    out = []
    for i, host, text, *_ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host, x.strip(SPACE)) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [rng.choice(["Menu", "  Menu \t", "footer", "", " ", f"own {i}", f"own {rng.randrange(40)}", "rare"]) for _ in range(rng.randint(0, 12))]
        rows.append((i, host, "\n".join(lines), "clash", 1))
    rows += [(900, "a", None, "", 1), (901, None, None, "", 1), (902, "a", "Menu", "", 1), (903, "new", "Menu\nx", "", 1), (904, "b", "\n\n", "", 1)] + [(905, "a", "Menu\nfooter\nown", "", 1)] * 3
    out = line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA), "source")
    assert out.columns == ["doc_id", "source", "text", "keys", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == sorted((*x[:3], x[3] or "") for x in brute(rows))


def test_hosts(spark):
    urls = [("http://User@Ex.org:80/a?b",), ("https://b.c",), ("nothing",), (None,)]
    frame = spark.createDataFrame(urls, "url string")
    assert [r[0] for r in frame.select(line_dedup.host_of("url")).collect()] == ["ex.org", "b.c", None, None]
    pages = spark.createDataFrame([(f"http://h.org/{i}", f"nav\npage {i}") for i in range(8)] + [("http://g.org", "nav")], "url string, html string")
    out = line_dedup.drop_lines(pages, (line_dedup.host_of, "url"), "html")
    assert sorted(r.html for r in out.collect()) == sorted([f"page {i}" for i in range(8)] + ["nav"])


def test_empty_and_long(spark):
    assert line_dedup.drop_lines(spark.createDataFrame([], SCHEMA), "source").count() == 0
    text = "\n".join(["same"] * 20_000 + ["x" * 100_000])
    out = line_dedup.drop_lines(spark.createDataFrame([(i, "h", text, "", 1) for i in range(6)], SCHEMA), "source").collect()
    assert {(r.n_lines, r.n_dropped) for r in out} == {(20_001, 20_001)}
