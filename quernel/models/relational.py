"""The Transformer over DataFrames: rows of a sequence are rows of a table, so a sequence may be longer than any task holds.

Norms, residuals and the GELU are column expressions; affine maps are one pass over Arrow batches with the weights broadcast, whose size is the model's; attention is by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions import neural
from quernel.models.networks import GPT
from quernel.operators.attention import BLOCK, SPAN, attention


def affine(df: DataFrame, source: str, maps: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """df with a column array<double> for each of maps: source @ weight + bias. One pass; columns of these names are replaced."""
    kept = df.drop(*[c for c in maps if c != source])
    shipped = df.sparkSession.sparkContext.broadcast({k: (np.asarray(w, np.float64), np.asarray(b, np.float64).ravel()) for k, (w, b) in maps.items()})
    rest = [f for f in kept.schema.fields if f.name not in maps]
    schema = T.StructType([*rest, *(T.StructField(k, T.ArrayType(T.DoubleType())) for k in maps)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(batch.schema.get_field_index(source)).flatten().to_numpy(zero_copy_only=False)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            for weight, bias in shipped.value.values():
                y = x.reshape(n, -1) @ weight + bias if n else np.zeros((0, len(bias)))
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def block(df: DataFrame, weights: dict[str, np.ndarray], heads: int, causal: bool = True, rows: int = BLOCK, span: int = SPAN) -> DataFrame:
    """df (seq, pos, x array<double>) -> the same after x + o(attention(norm x)) and x + proj(gelu(fc(norm x))).

    weights: q, k, v, o, fc, proj and their biases q_b, …; ln1_g, ln1_b, ln2_g, ln2_b, as in GPT.state() for one block. (seq, pos) names a row: nulls take no part, and no pair may come twice.
    """
    norm = lambda c, n: neural.layernorm(c, neural.array_of(np.ravel(weights[f"{n}_g"])), neural.array_of(np.ravel(weights[f"{n}_b"])))
    maps = lambda *names: {n: (weights[n], weights[f"{n}_b"]) for n in names}
    base = df.select("seq", "pos", "x")
    seen = affine(base.select("seq", "pos", norm("x", "ln1").alias("h")), "h", maps("q", "k", "v"))
    mixed = affine(attention(seen, heads, causal, rows, span), "v", maps("o")).select("seq", "pos", "o")
    after = base.join(mixed, ["seq", "pos"]).select("seq", "pos", neural.add("x", "o").alias("x"))
    wide = affine(after.withColumn("h", norm("x", "ln2")), "h", maps("fc")).drop("h")
    out = affine(wide.withColumn("fc", neural.gelu("fc")), "fc", maps("proj"))
    return out.select("seq", "pos", neural.add("x", "proj").alias("x"))


def gpt_logits(df: DataFrame, model: GPT, rows: int = BLOCK, span: int = SPAN) -> DataFrame:
    """df (seq, pos long, id int) -> (seq, pos, logits array<double>): the model's forward pass with a row for each position. Ids and positions outside of the model are refused."""
    names, config = model.state(), model.config
    fits = F.col("id").between(0, config.vocab_size - 1) & F.col("pos").between(0, config.block_size - 1)
    tables = df.sparkSession.sparkContext.broadcast((names["tok"], names["pos"]))
    kept = df.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("an id or a position outside of the model")))).select("seq", F.col("pos").cast("long").alias("pos"), F.col("id").cast("int").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = tables.value
        for b in batches:
            x = tokens[b.column(2).to_numpy()] + places[b.column(1).to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["seq", "pos", "x"])

    out = kept.mapInArrow(run, f"seq {df.schema['seq'].dataType.simpleString()}, pos long, x array<double>")
    for k in range(config.n_layer):
        at = f"h{k}."
        out = block(out, {n.removeprefix(at): w for n, w in names.items() if n.startswith(at)}, config.n_head, rows=rows, span=span)
    last = neural.layernorm("x", neural.array_of(names["lnf_g"].ravel()), neural.array_of(names["lnf_b"].ravel()))
    return affine(out.select("seq", "pos", last.alias("x")), "x", {"logits": (names["head"], names["head_b"])}).select("seq", "pos", "logits")
