"""Token counts by a compiled transducer.

BPE is compiled, as far as the texts need it, into a deterministic transducer over bytes. A state holds what later merges may still depend on:
the longest suffix read that starts a token, the last token of the encoding at each place in it, and the counts there. Each transition is
annotated with the tokens it adds (it may take some away, as merges shrink the count); reading a word's end adds the rest and returns to the start.
White space always leads to the start state. So a chunk of text is a state map of three parts: the run it continues, the tokens of what
lies between its first and last space, and the run it leaves open. These maps compose associatively, and long texts are counted by a prefix scan over theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.bpe import MEMO, WordBpe, byte_letters, default_path, load, shipped
from quernel.llm.common import text_batches

#: Code points of a chunk.
CHUNK = 1 << 15
#: Transitions and pair tests kept by a worker, and roughly the bytes of its states; beyond either the compiled part is dropped and grows anew.
#: They stay from task to task, as the memo of runs does, which is emptied by itself.
STEPS, STATE_BYTES = 600_000, 96 << 20
#: A transition is its next state's number << SHIFT, and the tokens it adds, plus BIAS.
SHIFT, BIAS = 20, 1 << 19
RESET = regex.compile(r"[ \t\n\r]")


class State(NamedTuple):
    suffix: str
    #: at each place of the suffix, from before its first letter: the last token there (None at the word's start), tokens since then
    tail: tuple[tuple[str | None, int], ...]


START = State("", ((None, 0),))


class ChunkMap(NamedTuple):
    """What a chunk does to the open run that enters it. closed is False where the chunk has no white space: then all of it is head."""

    head: str
    closed: bool
    tokens: int
    tail: str


class Transducer:
    def __init__(self, bpe: WordBpe):
        self.bpe, self.letters = bpe, byte_letters()
        self.value = {c: b for b, c in enumerate(self.letters)}
        # a token that its own letters don't merge to never appears
        self.prefixes = {t[:k] for t in bpe.vocab for k in range(1, len(t.removesuffix(bpe.end)) + 1)}
        self.memo: dict[str, int] = {}
        self.memo_bytes = 0
        self.clear()

    def clear(self) -> None:
        #: by state << 8 | byte
        self.steps: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.states, self.numbers, self.state_bytes = [START], {START: 0}, 0
        self.fits: dict[tuple[str | None, str], bool] = {}

    def fit(self, left: str | None, token: str) -> bool:
        """Whether the encoding of left and token side by side is just these two."""
        key = (left, token)
        if (known := self.fits.get(key)) is None:
            bare = token.removesuffix(self.bpe.end) if len(token) > len(self.bpe.end) else token
            ids = [self.bpe.inner[self.value[c]] for c in (left or "") + bare]
            if bare != token:
                ids[-1] = self.bpe.last[self.value[bare[-1]]]
            known = self.fits[key] = self.bpe.merge(ids) == [self.bpe.vocab[x] for x in (left, token) if x is not None]
        return known

    def last(self, state: State, letter: str, end: str) -> tuple[str, int]:
        """The last token once letter is read, and the number of tokens that it adds."""
        text = state.suffix + letter
        for k, (left, since) in enumerate(state.tail):  # from the longest token down
            token = text[k:] + end
            if token in self.bpe.vocab and self.fit(left, token):
                return token, 1 - since
        raise AssertionError("every letter is a token")

    def step(self, key: int) -> int:
        """The transition of a state << 8 | byte that no word has taken so far."""
        s, letter = self.states[key >> 8], self.letters[key & 255]
        token, added = self.last(s, letter, "")
        text = s.suffix + letter
        tail = [*((t, n + added) for t, n in s.tail), (token, 0)]
        k = 0
        while k < len(text) and text[k:] not in self.prefixes:
            k += 1
        new = State(text[k:], tuple(tail[k:]))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.state_bytes += 400 + 100 * len(new.tail)
        found = self.steps[key] = number << SHIFT | added + BIAS
        return found

    def finish(self, key: int) -> int:
        found = self.ends[key] = self.last(self.states[key >> 8], self.letters[key & 255], self.bpe.end)[1]
        return found

    def word(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        state, total, get = 0, 0, self.steps.get
        for byte in raw[:-1]:
            key = state << 8 | byte
            if (found := get(key)) is None:
                found = self.step(key)
            state = found >> SHIFT
            total += (found & (1 << SHIFT) - 1) - BIAS
        key = state << 8 | raw[-1]
        return total + (found if (found := self.ends.get(key)) is not None else self.finish(key))

    def read(self, run: str) -> int:
        """Tokens of a run without white space; the path of a run seen before is known."""
        if len(self.steps) + len(self.ends) + len(self.fits) > STEPS or self.state_bytes > STATE_BYTES:
            self.clear()
        total = sum([self.word(w) for w in self.bpe.words(run)])
        if len(run) <= 64:
            if self.memo_bytes > MEMO:
                self.memo.clear()
                self.memo_bytes = 0
            self.memo[run] = total
            self.memo_bytes += 150 + len(run)
        return total

    def run(self, text: str) -> int:
        """Tokens of whole runs between white space."""
        total = 0
        for part, special in self.bpe.parts(text):
            if special:
                total += 1
            else:
                get = self.memo.get
                total += sum([get(r) or self.read(r) for r in self.bpe.runs(part)])
        return total

    def chunk(self, text: str) -> ChunkMap:
        first = RESET.search(text)
        if first is None:
            return ChunkMap(text, False, 0, "")
        last = max(text.rfind(c) for c in " \t\n\r")
        return ChunkMap(text[: first.start()], True, self.run(text[first.start() : last]), text[last + 1 :])

    def compose(self, parts: list[ChunkMap]) -> ChunkMap:
        """The map of neighbouring chunks; associative in the lists it is given."""
        head, tokens, tail, closed = [], 0, [], False
        for p in parts:
            if not closed:
                head.append(p.head)
                if p.closed:
                    closed, tokens, tail = True, p.tokens, [p.tail]
            else:
                tail.append(p.head)
                if p.closed:
                    tokens += self.run("".join(tail)) + p.tokens
                    tail = [p.tail]
        return ChunkMap("".join(head), closed, tokens, "".join(tail))

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text of any length: the maps of its chunks, composed."""
        maps = [self.chunk(text[i : i + chunk]) for i in range(0, max(1, len(text)), chunk)]
        while len(maps) > 1:  # levels of the scan; only the map of the whole text is needed
            maps = [self.compose(maps[i : i + 16]) for i in range(0, len(maps), 16)]
        whole = self.compose(maps)
        return self.run(whole.head) + whole.tokens + self.run(whole.tail)


_compiled: dict[int, Transducer] = {}


def compiled(bpe: WordBpe) -> Transducer:
    if id(bpe) not in _compiled:
        _compiled[id(bpe)] = Transducer(bpe)
    return _compiled[id(bpe)]


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (boolean) to df; they replace columns of these names.

    Null and empty texts count 0. Rows are neither joined nor shuffled, so repeated rows and ties don't matter. An empty table stays empty.
    """
    content = shipped(df.sparkSession, path or default_path())
    kept = df.drop("n_bytes", "n_tokens", "over_limit")
    keys = [c for c in kept.columns if c != text]
    schema = T.StructType([*(kept.schema[c] for c in keys), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(load(content.value))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            n_bytes, n_tokens = [], []
            for x in batch.column(at):
                said = x.as_py() or ""
                n_bytes.append(len(said.encode("utf-8", "surrogatepass")))
                n_tokens.append(counter.count(said))
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[f.name for f in schema])

    return text_batches(kept).select(*keys, text).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts the tokens of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
