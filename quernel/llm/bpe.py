"""BPE encoding and decoding of whole texts.

A word's merges are found with a segment tree over the ranks of adjacent pairs: the root holds the leftmost lowest rank, and a merge
changes three leaves, so a word of n symbols takes O(n log n) however long it is. Nodes have up to FAN children, whose minimum one call finds;
words of up to FAN symbols are a single node. Words repeat, so each worker keeps a bounded memo of what stands between white space.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import text_batches

NONE = 1 << 80
FAN = 16
#: Bytes of a worker's memo, roughly; it is emptied when full.
MEMO = 32 << 20
#: Bytes of ids of an output batch; decoded texts are about six times as long in memory.
OUT_BYTES = 2 << 20
#: Below this code point, and for ASCII, Python's tables agree with those of the tokenizers library; other texts take its normalizer and splitter.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u052f\u2010-\u2027]*")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable Latin-1, else the next free one from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file of BPE with word ends: normalizer, splitter, ranks and vocabulary."""

    def __init__(self, content: bytes):
        data = json.loads(content)
        model = data["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE file with an end-of-word suffix is needed")
        self.end = model["end_of_word_suffix"]
        #: the file without its vocabulary, for the library's normalizer and splitter
        self.rules = json.dumps({**data, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: left id << 20 | right id -> rank << 52 | id of the merged token; bits 20 to 51 are for the place
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: i << 52 | self.vocab[a + b] for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        known = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.names = [known.get(i) for i in range(max(known) + 1)]
        split = next(x for x in data["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.lexer = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.library = None
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0

    def merge(self, ids: list[int]) -> list[int]:
        """Applies merges until no pair has a rank: always the leftmost of the lowest rank."""
        n, get, none = len(ids), self.ranks.get, NONE
        # a leaf's key is the pair's rank and the merged token
        keys = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        if n > FAN:
            return self.merge_long(ids, keys)
        while keys:  # one node: its minimum is the root
            key = min(keys)
            if key == none:
                break
            i = keys.index(key)
            ids[i] = merged = key & 0xFFFFF
            del ids[i + 1], keys[i]
            if i < len(keys):
                keys[i] = get(merged << 20 | ids[i + 1], none)
            if i:
                keys[i - 1] = get(ids[i - 1] << 20 | merged, none)
        return ids

    def merge_long(self, ids: list[int], keys: list[int]) -> list[int]:
        """The same with levels of nodes. Keys also hold the place, so that the root names the leftmost; merged places stay as gaps."""
        n, get, none = len(ids), self.ranks.get, NONE
        keyed = lambda at, pair: none if (found := get(pair, none)) == none else found + (at << 20)
        levels = [[k if k == none else k + (i << 20) for i, k in enumerate(keys)]]
        while len(levels[-1]) > 1:
            levels.append([min(levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
        after, prior = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (key := levels[-1][0]) < none:
            i = key >> 20 & 0xFFFFFFFF
            j, merged = after[i], key & 0xFFFFF
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            changed = [(i, none)]
            if k < n:
                prior[k] = i
                changed = [(i, keyed(i, merged << 20 | ids[k])), (j, none)]
            if (p := prior[i]) >= 0:
                changed.append((p, keyed(p, ids[p] << 20 | merged)))
            for at, key in changed:
                levels[0][at] = key
                for level, above in zip(levels, levels[1:]):
                    at //= FAN
                    low = min(level[at * FAN : at * FAN + FAN])
                    if above[at] == low:
                        break
                    above[at] = low
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        inner = self.inner
        return self.merge([*(inner[b] for b in raw[:-1]), self.last[raw[-1]]])

    def runs(self, text: str) -> list[str]:
        """Normalizes a text without special tokens and splits it at white space, or into words where only the library's tables will do.

        Composing letters and their marks, or lower case, can lead out of PLAIN; such a text takes the library's way from its start, so runs of
        more than one word are always PLAIN.
        """
        if PLAIN.fullmatch(text):
            if text.isascii():
                return text.lower().split()
            clean = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            if PLAIN.fullmatch(clean):
                return clean.split()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules)
        clean = self.library.normalizer.normalize_str(text)
        return [clean[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    def words(self, run: str) -> list[str]:
        """The words of a run from runs(); a word is its own only word."""
        return [run] if run.isalpha() or not PLAIN.fullmatch(run) else self.lexer.findall(run)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens, and these themselves."""
        if self.cut is None or not any(s in text for s in self.special):
            yield text, False
            return
        for k, part in enumerate(self.cut.split(text)):
            if part:
                yield part, k % 2 == 1

    def packed(self, run: str) -> bytes:
        """A run's ids as little-endian bytes."""
        words = self.words(run)
        ids = self.word(run) if len(words) == 1 else [x for w in words for x in self.word(w)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(run) <= 64:
            if self.memo_bytes > MEMO:
                self.memo.clear()
                self.memo_bytes = 0
            self.memo[run] = out
            self.memo_bytes += 190 + len(run) + len(out)
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found: list[bytes] = []
        get = self.memo.get
        for part, special in self.parts(text):
            if special:
                found.append(struct.pack("<I", self.special[part]))
            else:
                found += [get(r) or self.packed(r) for r in self.runs(part)]
        return b"".join(found)

    def decode(self, ids_le: bytes) -> str:
        """The file names no decoder: the tokens, word ends and all, with a space between. Unknown ids are left out."""
        names, n = self.names, len(self.names)
        return " ".join([names[i] for i in np.frombuffer(ids_le, "<u4").tolist() if i < n and names[i] is not None])


_loaded: dict[bytes, WordBpe] = {}


def load(content: bytes) -> WordBpe:
    """The tokenizer of a file's content, once a worker."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded[key] = WordBpe(content)
    return _loaded[key]


def shipped(spark: SparkSession, path: str):
    """A broadcast of a vocabulary file: some MB that don't depend on the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, text: str = "text", path: str | None = None, decoded: bool = True) -> DataFrame:
    """Adds n_tokens long, ids_le binary (little-endian unsigned 32-bit ids) and decoded string to df; they replace columns of these names.

    Null and empty texts give no ids and an empty decoded text. Rows are neither joined nor shuffled, so repeated rows and ties don't matter. An empty table stays empty.
    """
    content = shipped(df.sparkSession, path or default_path())
    kept = df.drop("n_tokens", "ids_le", "decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(content.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            start, size = 0, 0
            out: tuple[list, list, list] = ([], [], [])
            for i, x in enumerate(batch.column(at)):
                raw = bpe.encode(x.as_py() or "")
                out[0].append(len(raw) // 4)
                out[1].append(raw)
                out[2].append(bpe.decode(raw) if decoded else None)
                size += len(raw)
                if size > OUT_BYTES or i + 1 == batch.num_rows:  # bounded output batches, however long the texts
                    cut = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], names=[f.name for f in schema])
                    start, size, out = i + 1, 0, ([], [], [])

    return text_batches(kept).mapInArrow(run, schema)


def ids_array(ids_le):
    """The ids of a binary column as array<bigint>, by Spark's own functions."""
    four = F.transform(F.sequence(F.lit(0), (F.length(ids_le) / 4).cast("int") - 1), lambda i: F.conv(F.hex(F.reverse(F.substring(ids_le, (i * 4 + 1).cast("int"), 4))), 16, 10).cast("long"))
    return F.when(F.length(ids_le) > 0, four).otherwise(F.array().cast("array<bigint>"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents; one row a document, digests of ids and decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
