"""A tokenizer of code points; ids in the order of first appearance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_chars(text: Column | str) -> Column:
    """The code points of a text; none of an empty or null one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")


#: Lead bytes of characters of two, three and four bytes; any other byte is one by itself, as is a lead byte that the end cuts off.
CHARACTER = "[\u00c0-\u00df](?s:.)|[\u00e0-\u00ef](?s:..)|[\u00f0-\u00f7](?s:...)|(?s:.)"


def split_bytes(raw: Column | str) -> Column:
    """array<binary>: the characters of UTF-8 bytes as their lead bytes tell, whatever follows these: for text that may be cut or broken. None of an empty or null value.

    Bytes are looked at one by one, as the 256 first code points, by a regular expression that never looks back; all in the JVM.
    """
    c = F.col(raw) if isinstance(raw, str) else raw
    found = F.regexp_extract_all(F.decode(F.coalesce(c, F.lit(b"")), "ISO-8859-1"), F.lit(CHARACTER), F.lit(0))
    return F.transform(found, lambda x: F.encode(x, "ISO-8859-1"))


def points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and where each text begins and ends."""
    said = [t or "" for t in texts]
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, said), np.int64, len(said)))))
    return np.frombuffer("".join(said).encode("utf-32-le", "surrogatepass"), np.uint32), ends


#: Code points (or bytes) whose arrays a worker holds at once; a longer text is looked at by itself.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in their order, a few at a time: PIECE bytes of text, or ids, of the column, or a single row with more."""
    values = batch.column(column)
    sizes = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
    ends = np.cumsum(pa.compute.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield batch.slice(at, end - at)
        at = end


def char_counts(df: DataFrame, text: str) -> DataFrame:
    """(token, n): each batch sends a count for each of its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 0)):
            n = np.bincount(points(batch.column(0).to_pylist())[0])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in at], pa.string()), pa.array(n[at].astype(np.int64))], names=["token", "n"])

    return df.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A column of lists of int."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


class CharTokenizer:
    """vocab: (token string, token_id int), as many rows as there are different characters: under 1.2 million whatever the corpus, so the driver may hold it."""

    def __init__(self, vocab: DataFrame):
        self.vocab = vocab
        self._tokens: list[str] | None = None

    @staticmethod
    def fit(df: DataFrame, text: str, order: str) -> CharTokenizer:
        """Each character's first place by (order, null first, position): the first of each batch, then a min per character before the one small sort."""
        kind = df.schema[order].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best: dict[int, tuple] = {}
                for o, said in (x for p in pieces(batch, 1) for x in zip(p.column(0).to_pylist(), p.column(1).to_pylist())):
                    if said:
                        chars, first = np.unique(np.frombuffer(said.encode("utf-32-le", "surrogatepass"), np.uint32), return_index=True)
                        key = (o is not None, o)
                        for c, p in zip(chars.tolist(), first.tolist()):
                            if c not in best or (key, p) < best[c]:
                                best[c] = (key, p)
                yield pa.RecordBatch.from_arrays([pa.array([k[1] for k, _ in best.values()], batch.schema.field(0).type), pa.array([p for _, p in best.values()], pa.int32()), pa.array([chr(c) for c in best], pa.string())], names=["o", "p", "token"])

        seen = df.select(F.col(order).alias("o"), F.col(text)).mapInArrow(run, f"o {kind}, p int, token string")
        first = seen.groupBy("token").agg(F.min(F.struct("o", "p")).alias("at"))
        return CharTokenizer(first.select("token", (F.row_number().over(Window.orderBy("at", "token")) - 1).alias("token_id")))

    @property
    def tokens(self) -> list[str]:
        """By id; read once."""
        if self._tokens is None:
            self._tokens = [r["token"] for r in sorted(self.vocab.collect(), key=lambda r: r["token_id"])]
        return self._tokens

    def encode(self, df: DataFrame, text: str, key: str, out: str = "ids") -> DataFrame:
        """(key, out array<int>); characters that aren't in the vocabulary are left out. A batch's texts are looked up by code point at once."""
        table = np.full(max(map(ord, self.tokens), default=0) + 2, -1, np.int32)
        for i, token in enumerate(self.tokens):
            table[ord(token)] = i
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in pieces(b, 1)):
                chars, ends = points(batch.column(1).to_pylist())
                ids = table[np.minimum(chars, len(table) - 1)]
                known = ids >= 0
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(np.concatenate(([0], np.cumsum(known)))[ends], ids[known])], names=[key, out])

        return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")

    def decode(self, df: DataFrame, ids: str, key: str, out: str = "text") -> DataFrame:
        """(key, out); ids that aren't in the vocabulary, and nulls, are left out."""
        table = np.array([ord(t) for t in self.tokens] or [0], np.uint32)
        n, kind = len(self.tokens), df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in pieces(b, 1)):
                column = batch.column(1)
                flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                known = (flat >= 0) & (flat < n)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
                said = table[flat[known]].tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([said[a:b] for a, b in zip(at, at[1:])], pa.string())], names=[key, out])

        return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, `{out}` string")

    @property
    def vocab_size(self) -> int:
        return len(self.tokens)

    def token(self, token_id: int) -> str:
        if not 0 <= token_id < len(self.tokens):
            raise IndexError("no such token")
        return self.tokens[token_id]

    def contains(self, token: str) -> bool:
        return token in self.tokens


def train_val_split(ids: Column | str) -> tuple[Column, Column]:
    """The first nine tenths (rounded down) and the rest."""
    c = F.col(ids) if isinstance(ids, str) else ids
    n = F.floor(F.size(c) * 9 / 10).cast("int")
    return F.slice(c, F.lit(1), n), F.slice(c, n + 1, F.size(c) - n)


def windows(ids: Column | str, width: int) -> Column:
    """array<struct<start, x, y>>: all contexts and the same shifted by one; none where there are fewer than width + 1 ids."""
    c = F.col(ids) if isinstance(ids, str) else ids
    starts = F.when(F.size(c) > width, F.sequence(F.lit(0), F.size(c) - width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(c, s + 1, width).alias("x"), F.slice(c, s + 2, width).alias("y")))


def chunk_at(ids: Column | str, start: Column, width: int) -> tuple[Column, Column]:
    """The context that starts there, and its targets."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(c, start + 1, width), F.slice(c, start + 2, width)
