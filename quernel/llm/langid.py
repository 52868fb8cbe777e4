"""Language identification by cross-parsing: a suffix automaton of each language's text parses a document into longest matches, and the
language that needs the fewest phrases, against what its own texts need, wins.

Learned on a bounded sample of whole rows: of each of the MAX_LANGS most frequent languages up to TRAIN_DOCS different texts of at most DOC_CHARS code points, those with the smallest hashes (a language without
any such text: its shortest, up to LONG_CHARS). Every other one (of a single text the first half) makes the language's automaton, and the rest measure the phrases that the language itself needs.
Transitions of all automata are packed in one table by displacement: a state's place plus a symbol is an entry, which counts if it names that state. So they take as many entries as there are
transitions, some three a letter, however many letters a language has. Workers parse many pieces of texts in lockstep. Pieces don't bound matches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.common import text_batches

TRAIN_DOCS, DOC_CHARS, LONG_CHARS, MAX_LANGS = 48, 1500, 50_000, 512
PIECE = 512
#: Pieces parsed together; bounds a worker's memory.
BATCH_PIECES = 4096
UNKNOWN = "und"
#: Symbols: what pads a piece, white space and all that is no letter, letters not learned; then the learned letters.
PAD, SPACE, OTHER, FIRST = 0, 1, 2, 3


def letters() -> np.ndarray:
    """Of each code point: its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """A suffix automaton: state 0 is its root; it accepts every substring of its text."""

    def __init__(self, text: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


def displaced(states: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs transitions: place of each state, all of them different; then, by place + symbol, the place of the state that an entry is of (0: of none) and where that leads."""
    size = 2 * sum(map(len, states)) + 2 * symbols + len(states) + 1
    taken, used, place = bytearray(size), bytearray(size), [0] * len(states)
    # the widest first; those of a width go on where the one before was put, so that a width passes over the table once
    width, at = -1, 1
    for i in sorted(range(len(states)), key=lambda i: -len(states[i])):
        own = sorted(states[i])
        if len(own) != width:
            width, at = len(own), 1
        while used[at] or any(taken[at + c] for c in own):
            at += 1
            while at + symbols >= len(taken):
                taken += bytes(len(taken))
                used += bytes(len(used))
        place[i], used[at] = at, 1
        for c in own:
            taken[at + c] = 1
    n = max(place, default=0) + symbols + 1
    owner, leads = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i, found in enumerate(states):
        for c, s in found.items():
            owner[place[i] + c], leads[place[i] + c] = place[i], place[s]
    return np.array(place, np.int32), owner, leads


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        """samples: texts by language, in a fixed order."""
        low = letters()
        texts = {lang: [low[code_points(t)] for t in ts] for lang, ts in sorted(samples.items())}
        seen = np.unique(np.concatenate([x for ts in texts.values() for x in ts] or [np.zeros(0, np.uint32)]))
        seen = seen[seen > 0]
        self.symbols = FIRST + len(seen)
        self.kind = np.min_scalar_type(self.symbols)
        known = np.zeros(0x110000, self.kind)
        known[seen] = np.arange(FIRST, self.symbols)
        #: symbol of each code point
        self.symbol = np.where(low > 0, np.where(known[low] > 0, known[low], OTHER), SPACE).astype(self.kind)
        self.langs, roots, held, at = [], [], [], 0
        states: list[dict[int, int]] = []
        first: list[np.ndarray] = []
        for lang in texts:
            own = [r for r in map(self.read, samples[lang]) if (r >= OTHER).any()]
            if not own:
                continue
            if len(own) == 1:  # the one text in halves, a letter at least in the first
                cut = max((len(own[0]) + 1) // 2, int(np.argmax(own[0] >= OTHER)) + 1)
                own = [own[0][:cut], own[0][cut:]]
            automaton = Automaton(np.concatenate(own[::2]).tolist())
            self.langs.append(lang)
            roots.append(at)
            # a phrase begins at the root, whose transitions have a table of their own
            start = np.full(self.symbols, at, np.int32)
            for c, s in automaton.next[0].items():
                start[c] = at + s
            first.append(start)
            states += [{}] + [{c: at + s for c, s in found.items()} for found in automaton.next[1:]]
            at += len(automaton.next)
            held.append(np.concatenate(own[1::2]))
        place, self.owner, self.leads = displaced(states, self.symbols)
        # states go by their places from here on
        self.roots, self.first = place[np.array(roots, np.int64)], place[np.array(first, np.int64).reshape(len(first), self.symbols)]
        #: phrases a symbol that each language's own other text needs, one of each added: 1 where nothing is left to measure
        self.need = np.array([(self.phrases([rest])[0, k] + 1) / (len(rest) + 1) for k, rest in enumerate(held)])

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.symbol, self.first, self.owner, self.leads))

    def read(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of what is no letter as one space."""
        s = self.symbol[code_points(text)]
        if len(s) > 1:
            s = s[np.concatenate(([True], (s[1:] != SPACE) | (s[:-1] != SPACE)))]
        return s

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Longest-match phrases of each whole text in each language.

        Pieces of a text are parsed side by side, each from the root first; a piece that the one before leaves in another state is parsed again from that state,
        until no state changes. So matches run on over the ends of pieces, and the counts are those of one parse from front to back, whatever the pieces.
        """
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        roots = self.roots
        pieces, owner, goes_on = [], [], []
        carry = roots

        def parse() -> np.ndarray:
            block = np.zeros((len(pieces), max(map(len, pieces))), self.kind)
            for i, p in enumerate(pieces):
                block[i, : len(p)] = p
            block = np.ascontiguousarray(block.T)
            entry = np.repeat(roots[:, None], len(pieces), 1)
            if goes_on[0]:
                entry[:, 0] = carry
            left, count, todo = entry.copy(), np.zeros_like(entry), np.arange(len(pieces))
            while len(todo):
                state = entry[:, todo]
                tally = np.zeros_like(state)
                part = block if len(todo) == len(pieces) else block[:, todo]
                for row, whole in zip(part, part.all(1).tolist()):
                    at = state + row
                    miss = self.owner.take(at) != state
                    found = self.leads.take(at)
                    np.copyto(found, self.first.take(row, 1), where=miss)
                    if not whole:  # pieces that have ended stay where they are
                        live = row != PAD
                        miss &= live
                        np.copyto(found, state, where=~live)
                    tally += miss
                    state = found
                left[:, todo], count[:, todo] = state, tally
                after = np.where(goes_on[1:], left[:, :-1], entry[:, 1:])
                todo = 1 + np.flatnonzero((after != entry[:, 1:]).any(0))
                entry[:, 1:] = after
            np.add.at(out, np.array(owner), count.T)
            for x in (pieces, owner, goes_on):
                x.clear()
            return left[:, -1]

        for i, s in enumerate(texts):
            for k in range(0, len(s), PIECE):
                pieces.append(s[k : k + PIECE])
                owner.append(i)
                goes_on.append(k > 0)
                if len(pieces) == BATCH_PIECES:
                    carry = parse()
        if pieces:
            parse()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is 1 - r / (r + s), r and s the lowest and second lowest normalised phrases."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        read = [self.read(t or "") for t in texts]
        rows = [i for i, s in enumerate(read) if (s >= OTHER).any()]
        if rows:
            rate = self.phrases([read[i] for i in rows]) / self.need
            order = np.argsort(rate, axis=1, kind="stable")  # ties: the first language by name
            for i, r, o in zip(rows, rate, order):
                langs[i] = self.langs[o[0]]
                scores[i] = 1.0 if len(o) == 1 else float(r[o[1]] / (r[o[0]] + r[o[1]]))
        return langs, scores


def held_out(doc_id: str = "doc_id"):
    """Documents whose crc32 of the id as text leaves 2 by 4; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(df: DataFrame, text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from labelled rows: counts them by language, then takes a bounded sample of whole texts to the driver."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "size": F.length("text")})
    short = rows.where(F.col("size") <= DOC_CHARS)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.when(F.col("size") <= DOC_CHARS, F.col("h"))).alias("short"))
    found = {r["lang"]: r["short"] for r in counts.orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not found:
        return Model({})
    # about twice as many as needed pass; copies of a text share its hash and are one
    few, none = {k: n for k, n in found.items() if n}, [k for k, n in found.items() if not n]
    samples: dict[str, list[str]] = {}
    if few:
        share = F.try_element_at(F.create_map(*[F.lit(x) for k, n in few.items() for x in (k, min(1.0, 2.0 * train_docs / n))]), F.col("lang"))
        taken = short.where(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < share).groupBy("lang", "h").agg(F.min("text").alias("text"))
        for r in sorted(taken.collect(), key=lambda r: (r["lang"], r["h"] % (1 << 64))):
            if len(texts := samples.setdefault(r["lang"], [])) < train_docs:
                texts.append(r["text"])
    if none:
        for r in rows.where(F.col("lang").isin(none) & (F.col("size") <= LONG_CHARS)).groupBy("lang").agg(F.min(F.struct("size", "text")).alias("x")).collect():
            samples[r["lang"]] = [r["x"]["text"]]
    return Model(samples)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred string and score double to df; they replace columns of these names. Null and empty texts and texts without a letter: und, 0.

    Texts are parsed whole, however long. Languages that tie: the first by name. Repeated rows get equal predictions; an empty table stays empty.
    """
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))  # some three entries for each letter of the bounded sample, and a table of letters
    kept = df.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for k in range(0, batch.num_rows, 256):
                langs, scores = own.predict(column.slice(k, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 256).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return text_batches(kept).mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every whole text of documents; learned on those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
