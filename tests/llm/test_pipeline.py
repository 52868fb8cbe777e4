import hashlib
import random
import struct

from tokenizers import Tokenizer

import corpus_pipeline
from quernel.llm import bpe
from tests.llm.test_langid import WORDS, make


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        lang = rng.choice(list(WORDS))
        text = make(rng, lang, rng.randint(40, 90)) + ("\nShared footer." if i % 3 == 0 else "")
        rows.append((i, text, lang, rng.choice("ab"), len(text)))
    copies = [(1000 + i, rows[i][1], rows[i][2], rows[i][3], rows[i][4]) for i in range(10)]
    near = [(2000 + i, rows[20 + i][1] + " the", rows[20 + i][2], "a", 0) for i in range(5)]
    odd = [(3000, None, "en", "a", 0), (3001, "123 ?", "en", None, 5), (3002, "", None, "b", 0)]
    frame = spark.createDataFrame(rows + copies + near + odd, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == frame.columns
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("language_id") == {r[0] for r in rows + copies + near}
    assert not any("Shared footer." in r.text.split("\n") for r in seen["line_dedup"]) and ids("line_dedup") == ids("language_id")
    assert ids("minhash_near_dedup") == {r[0] for r in rows} and len(seen["minhash_near_dedup"]) == len(rows)
    words = lambda name: sum(len(r.text.split()) for r in seen[name])
    assert abs(words("mixing") - words("minhash_near_dedup")) <= 4
    library = Tokenizer.from_file(bpe.default_path())
    want = sorted((r.doc_id, struct.pack(f"<{len(e.ids)}I", *e.ids)) for r, e in zip(seen["mixing"], library.encode_batch([r.text for r in seen["mixing"]], add_special_tokens=False)))
    assert sorted((r.doc_id, bytes(r.ids)) for r in seen["bpe"]) == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in whole) == want
    r = whole[0]
    assert r.decoded_sha256 == hashlib.sha256(library.decode(list(struct.unpack(f"<{r.n_tokens}I", r.ids)), skip_special_tokens=False).encode()).hexdigest()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    """Columns with the names that stages use inside, nulls, empty texts, repeated rows and a very long text: every stage but the last gives the columns back as they were."""
    rng = random.Random(3)
    extra = ["lang_pred", "score", "n_lines", "n_dropped", "fp", "h", "size", "whole", "words", "n_shingles", "n_tokens", "beside_1", "kept", "copy"]
    rows = [(i, make(rng, rng.choice(list(WORDS)), 30), "en", "a", 1, *[f"{i}:{c}" for c in extra]) for i in range(20)]
    rows += [rows[0], (None, None, None, None, None, *[None] * len(extra)), (50, "", None, "a", 0, *extra), (51, make(rng, "de", 30_000), "de", None, 5, *extra)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    before = {r.doc_id: [r[c] for c in extra] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        got = docs.collect()
        assert docs.columns[5:] == extra and all([r[c] for c in extra] == before[r.doc_id] for r in got), name
        assert {r.doc_id for r in got} >= {*range(20), 51}, name
    assert corpus_pipeline.token_ids(spark, docs, str(tmp_path)).count() == docs.count()
    plain = spark.createDataFrame([(1, "The end.", "en", "a"), (2, "The end.", "en", "a")], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.lines(spark, plain, str(tmp_path)).columns == plain.columns


def test_large_groups_of_copies_keep_one(spark, tmp_path):
    """Exact and near copies over a tenth of a source: one of each group is left with its lines; a footer of different pages still goes."""
    text = lambda rng: "\n".join(" ".join(rng.choice(WORDS["en"]) + str(rng.randrange(999)) for _ in range(20)) for _ in range(4))
    rng = random.Random(4)
    exact, near = text(rng), text(rng).split("\n")
    rows = [(i, text(rng) + "\nShared footer.", "en", "a", 0) for i in range(28)]
    rows += [(100 + i, exact, "en", "a", 0) for i in range(6)]
    rows += [(200 + i, "\n".join(near) + "\n" * i, "en", "a", 0) for i in range(6)]  # their texts differ, their lines don't
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()
    assert len(clean) == len(rows) and not any("Shared footer." in r.text for r in clean)
    assert {r.text for r in clean if 100 <= r.doc_id < 200} == {exact}
    assert {r.text.strip() for r in clean if r.doc_id >= 200} == {"\n".join(near)}
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(clean), str(tmp_path)).collect()
    assert sorted(r.doc_id // 100 for r in left) == [0] * 28 + [1, 2]
