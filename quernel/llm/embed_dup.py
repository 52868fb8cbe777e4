"""Near-duplicate embeddings by NN-descent, among vectors of one label.

Equal vectors of a label are one vertex. Lists of each vertex's K best neighbours start from random hyperplane buckets and are refined by joining
the neighbours, forward and backward, of each vertex with one another. A list is saturated where all of it may be links: it is then allowed twice as many, up to MOST, and
refined again. Edges at the threshold, confirmed in double precision, give components.

An audit compares AUDIT vertices of each size class with all of their groups: linear work, whatever the links. A class passes where the lists had RECALL of the links that it shows (none missed of L
seen: a recall of 1 - 3 / L at 95 %); where one shows fewer than LINKS, LEAST rounds are done, and its links are kept, so that later rounds need not compare again. While a class fails, rounds with new hyperplanes go on; only one that still fails after ROUNDS,
by links that were missed, is compared exactly, stripe by stripe. The audit's figures are logged and returned in report.

What lists dropped while they were saturated is the cap's rest, which has an exact way: such vertices of a label are compared with one another stripe by stripe, as far as they are in several
components, and what links two of these joins them. Within a component every list is enlarged to all its members, compared block by block; only
counts leave the blocks, so a large group of near-copies costs no row for each of its pairs.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.llm.common import components, table

K, MOST, TABLES, CHUNK, OVERLAP, PER_BUCKET = 10, 40, 8, 96, 24, 5
ITERATIONS, LEAST, ROUNDS, AUDIT, LINKS, RECALL = 2, 2, 5, 256, 30, 0.995
#: Vectors are searched as bytes; what may reach the threshold within their error is confirmed.
MARGIN = 0.03
REVERSE, BLOCK = 48, 512
#: Bytes of vectors that go to all tasks at once, and rows that a task compares with them at once; they bound memory, not results.
STRIPE, ROWS = 4 << 20, 1024


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def unit(vector: list[float]) -> np.ndarray:
    """In double precision; scaled by the largest component first, so that no square over- or underflows."""
    x = np.array(vector, np.float64)
    x /= np.abs(x).max()
    return x / np.sqrt(x @ x)


def joined(column: pa.Array, dtype: type) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype).reshape(len(parts), -1)


def as_bytes(vertices: DataFrame) -> DataFrame:
    """id, label, dim and the vector v -> its unit vector, q as signed bytes and raw as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [unit(x.as_py()) for x in batch.column(3)]
            q = [np.rint(x * 127).astype(np.int8).tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(q, pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["id", "label", "dim", "copies", "q", "raw"])

    label = vertices.schema["label"].dataType.simpleString()
    return vertices.select("id", "label", "dim", "v", "copies").mapInArrow(run, f"id long, label {label}, dim int, copies long, q binary, raw binary")


def planes_of(n: Column) -> Column:
    """Hyperplanes of a bucket where a group has n vertices."""
    return F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.greatest(n, F.lit(1)) / 32.0)))).cast("int")


def buckets(vertices: DataFrame, round_: int) -> DataFrame:
    """vertices (id, label, dim, q, n of its label) -> for each table of hyperplanes: key long, place double (order within the bucket), id, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(2).to_pylist()
            dims, n, group = batch.column(1).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(q[i] for i in at), np.int8).reshape(len(at), -1).astype(np.float32)
                bits = np.clip(np.ceil(np.log2(np.maximum(n[at], 1) / 32.0)), 0, 40).astype(np.int64)
                for t in range(TABLES):
                    planes = np.random.default_rng([int(dim), round_, t]).standard_normal((x.shape[1], 41)).astype(np.float32)
                    side = x @ planes
                    code = ((side[:, :40] > 0).astype(np.uint64) << np.arange(40, dtype=np.uint64))
                    code = np.where(np.arange(40) < bits[:, None], code, np.uint64(0)).sum(1, dtype=np.uint64)
                    key = (code * np.uint64(0x9E3779B97F4A7C15) ^ group[at]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(t)
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(side[:, 40].astype(np.float64)), batch.column(0).take(take), batch.column(2).take(take)], names=["key", "place", "id", "q"])

    return vertices.select("id", "dim", "q", "n", "group").mapInArrow(run, "key long, place double, id long, q binary")


def best_of(ids: np.ndarray, q: np.ndarray, k: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k most similar others, above its floor: (v, u, sim)."""
    x = q.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -2
    most = min(int(k.max()), len(ids) - 1)
    top = np.argpartition(-s, most - 1, axis=1)[:, :most]
    sim = np.take_along_axis(s, top, 1)
    if most > k.min():
        order = np.argsort(-sim, axis=1, kind="stable")
        top, sim = np.take_along_axis(top, order, 1), np.take_along_axis(sim, order, 1)
    keep = (sim > (floor[:, None] if floor is not None else -1.5)) & (np.arange(most) < k[:, None])
    i, j = np.nonzero(keep)
    return ids[i], ids[top[i, j]], sim[i, j].astype(np.float64)


EDGES = "v long, u long, sim double"


def edge_batch(v, u, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(sim, pa.float64())], names=["v", "u", "sim"])


def first_lists(placed: DataFrame) -> DataFrame:
    """Buckets in the order of a further projection, compared within a window that slides by CHUNK. Tasks hold ranges of that order, so a bucket that many share goes over several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def flushed():
            return edge_batch(*best_of(np.array(ids), np.frombuffer(b"".join(rows), np.int8).reshape(len(rows), -1), np.full(len(ids), PER_BUCKET)))

        for batch in batches:
            if not batch.num_rows:
                continue
            for k, i, q in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if k != key or (rows and len(q) != len(rows[0])):
                    if len(ids) > 1:
                        yield flushed()
                    key, ids, rows = k, [], []
                elif len(ids) == CHUNK:
                    yield flushed()
                    ids, rows = ids[-OVERLAP:], rows[-OVERLAP:]
                ids.append(i)
                rows.append(q)
        if len(ids) > 1:
            yield flushed()

    return table(placed, "buckets").repartitionByRange("key", "place", "id").sortWithinPartitions("key", "place", "id").mapInArrow(run, EDGES)


def merged(edges: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """The best distinct neighbours of each vertex: K, or as many as room (v, cap) allows it."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    ranked = edges.groupBy("v", "u").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= (K if room is None else MOST))
    if room is not None:
        ranked = ranked.join(room, "v", "left").where(F.col("rank") <= F.coalesce("cap", F.lit(K))).drop("cap")
    return table(ranked.drop("rank"), "lists")


def saturated(lists: DataFrame, room: DataFrame | None, threshold: float) -> DataFrame:
    """v, cap: vertices whose lists are full of what may be links."""
    held = lists.groupBy("v").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    held = held.withColumn("cap", F.lit(K)) if room is None else held.join(room, "v", "left").withColumn("cap", F.coalesce("cap", F.lit(K)))
    return held.where((F.col("n") >= F.col("cap")) & (F.col("low") >= threshold - MARGIN)).select("v", "cap")


def refine(lists: DataFrame, vertices: DataFrame, room: DataFrame | None = None) -> DataFrame:
    """One step of NN-descent: the neighbours of each vertex meet one another. Long reverse lists are dealt to chunks that all get the forward list."""
    last = lists.groupBy("v").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    last = last.withColumn("cap", F.lit(K)) if room is None else last.join(room, "v", "left").withColumn("cap", F.coalesce("cap", F.lit(K)))
    last = last.select(F.col("v").alias("id"), "cap", F.when(F.col("n") < F.col("cap"), -1.5).otherwise(F.col("low")).alias("low"))
    told = vertices.select("id", "q").join(last, "id", "left").select("id", "q", F.coalesce("low", F.lit(-1.5)).alias("low"), F.coalesce("cap", F.lit(K)).alias("cap"))
    told = table(told, "told")
    back = lists.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("c"), F.ceil(F.col("n") / REVERSE).cast("int").alias("chunks"))
    forward = lists.select(F.col("v").alias("c"), F.col("u").alias("id")).unionByName(lists.select(F.col("v").alias("c"), F.col("v").alias("id")).distinct())
    forward = forward.join(back, "c", "left").select("c", "id", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    backward = lists.select(F.col("u").alias("c"), F.col("v").alias("id")).join(back, "c").select("c", "id", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"))
    met = forward.unionByName(backward).distinct().join(told, "id").groupBy("c", "chunk").agg(F.collect_list(F.struct("id", "q", "low", "cap")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out = []
                for members in batch.column(0).slice(k, 256):
                    m = members.values
                    if len(m) > 2:
                        out.append(best_of(m.field("id").to_numpy(), joined(m.field("q"), np.int8), m.field("cap").to_numpy(), m.field("low").to_numpy()))
                if out:
                    yield edge_batch(*(np.concatenate(x) for x in zip(*out)))

    found = met.select("members").mapInArrow(run, EDGES)
    return merged(lists.unionByName(found), room)


def confirmed(lists: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of the lists whose cosine reaches the threshold."""
    near = lists.where(F.col("sim") >= threshold - MARGIN).select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    side = lambda c, r: vertices.select(F.col("id").alias(c), F.col("raw").alias(r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return near.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rooted(vertices: DataFrame, roots: DataFrame) -> DataFrame:
    """vertices with root, of a vertex without links itself."""
    found = roots.select(F.col("node").alias("id"), "root")
    return vertices.join(found, "id", "left").select("id", "group", "dim", "n", "raw", F.coalesce("root", "id").alias("root"))


def against(members: DataFrame, picked: DataFrame, threshold: float) -> DataFrame:
    """picked, a stripe of members, compared with all members of its groups: rows a, b are links between roots, all of them where a task sees fewer than LINKS, else as many as join up
    what it sees; rows without a are a task's counts: n links that it saw, same of them within a root.
    """
    known: dict[tuple[int, int], list] = {}
    for i, g, d, raw, root in picked.select("id", "group", "dim", "raw", "root").toPandas().itertuples(index=False):
        known.setdefault((int(g), int(d)), []).append((int(i), int(root), bytes(raw)))
    shipped = members.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe = {k: (np.array([m[0] for m in x]), *np.unique([m[1] for m in x], return_inverse=True), np.frombuffer(b"".join(m[2] for m in x), np.float64).reshape(len(x), -1)) for k, x in shipped.value.items()}
        parent: dict[int, int] = {}
        seen = apart = 0

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(p, p)
            return x

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids, groups, dims, own = (part.column(c).to_numpy() for c in (0, 1, 2, 4))
                a, b = [], []
                for g, d in set(zip(groups.tolist(), dims.tolist())) & stripe.keys():
                    other, names, name, rows = stripe[g, d]
                    at = np.flatnonzero((groups == g) & (dims == d))
                    near = joined(part.column(3).take(pa.array(at)), np.float64) @ rows.T >= threshold
                    near &= ids[at][:, None] != other[None, :]
                    seen += int(near.sum())
                    near &= own[at][:, None] != names[name][None, :]
                    i, j = np.nonzero(near)
                    apart += len(i)
                    few = apart < LINKS
                    if few:
                        a += ids[at[i]].tolist()
                        b += other[j].tolist()
                    # one link for each two roots
                    mine, code = np.unique(own[at], return_inverse=True)
                    for x in np.unique(code[i] * len(names) + name[j], return_index=True)[1]:
                        u, v = find(int(mine[code[i[x]]])), find(int(names[name[j[x]]]))
                        if u != v:
                            parent[max(u, v)] = min(u, v)
                            if not few:
                                a.append(ids[at[i[x]]])
                                b.append(other[j[x]])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "n", "same"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, seen, seen - apart)], names=["a", "b", "n", "same"])

    out = table(members.select("id", "group", "dim", "raw", "root").mapInArrow(run, "a long, b long, n long, same long"), "met")
    shipped.unpersist()
    return out


def swept(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join up all roots of members, a table(), between which there is a link: all are compared, a stripe at a time."""
    n, dim = members.agg(F.count("*"), F.max("dim")).first()
    stripes = max(1, -(-n * 8 * (dim or 1) // STRIPE))
    out = None
    for k in range(stripes):
        found = against(members, members.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(stripes)) == k), threshold)
        out = found if out is None else out.unionByName(found)
    return out.where("a is not null").select("a", "b")


def beyond_lists(full: DataFrame, vertices: DataFrame, roots: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) between components that lists once saturated (v) may have had no place for; None where no two components of a group have such lists.

    A list drops an edge only while it has as many good ones as it may hold, so a link that both its ends have dropped is between two vertices whose lists were full of what may be links.
    """
    members = table(rooted(vertices.join(full.select(F.col("v").alias("id")), "id"), roots), "full")
    several = members.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("group")
    several = table(several, "several")
    if several.isEmpty():
        return None
    return swept(table(members.join(several, "group").repartition(members.sparkSession.sparkContext.defaultParallelism), "full"), threshold)


def audit(members: DataFrame, threshold: float, kept: dict[int, tuple[int, list]]) -> dict[int, tuple[int, int]]:
    """members (rooted(), a table()) -> for each size class of groups (they have as many hyperplanes): links that AUDIT vertices or so have, and how many of them lie within components.

    kept, empty at first, holds what the classes with fewer than LINKS links have: how many, and those that lay between components, which are all that later roots may change.
    """
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) * F.lit(2.0**-53)
    out = {}
    for planes, n in members.groupBy(planes_of(F.col("n")).alias("planes")).agg(F.count("*")).orderBy("planes").collect():
        if planes in kept:
            seen, apart = kept[planes]
            root = dict(members.where(F.col("id").isin([x for link in apart for x in link])).select("id", "root").collect()) if apart else {}
            out[planes] = seen, seen - sum(root[a] != root[b] for a, b in apart)
            continue
        part = members.where(planes_of(F.col("n")) == planes)
        found = against(part, part.where(place < min(1.0, AUDIT / n)), threshold)
        out[planes] = tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("same"), F.lit(0))).first())
        if out[planes][0] < LINKS:
            kept[planes] = out[planes][0], [(r.a, r.b) for r in found.where("a is not null").collect()]
    return out


def link_counts(vertices: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """id, linked: the copies of all vertices of its component whose cosine with it reaches the threshold, itself left out."""
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = vertices.select(F.col("id").alias("node"), "raw", "copies").join(roots, "node").join(sizes, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = table(member.groupBy("root", "blocks", "i").agg(F.collect_list(F.struct("node", "raw", "copies")).alias("m")), "cells")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = cells.select("root", "i", every.alias("j"), F.col("m").alias("x"))
    right = cells.select("root", F.col("i").alias("j"), every.alias("i"), F.col("m").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = [], []
            for x, y in zip(batch.column(0), batch.column(1)):
                a, b = x.values, y.values
                na, nb = a.field("node").to_numpy(), b.field("node").to_numpy()
                s = joined(a.field("raw"), np.float64) @ joined(b.field("raw"), np.float64).T
                near = (s >= threshold) & (na[:, None] != nb[None, :])
                ids.append(na)
                counts.append(near @ b.field("copies").to_numpy())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts).astype(np.int64))], names=["id", "n"])

    return left.join(right, ["root", "i", "j"]).select("x", "y").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("linked"))


def link(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", report: dict | None = None) -> DataFrame:
    """One row for each row: vec_id, n_links long, component_id long (the smallest id reachable), kept boolean.

    Rows are compared where labels are equal and not null, and vectors as long. Null, empty or zero vectors and such with null or non-finite components
    link with nothing. Repeated rows and equal vectors are linked. report, if given, gets what the last audit saw and found for each size class, the rounds, and whether a class was compared exactly. A null id stays null and is no component's id unless all its ids are null. An empty table gives an empty result.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x"), F.col(label).alias("label"))
    said = F.concat_ws(",", F.size("x").cast("string"), F.transform("x", lambda x: (x + F.lit(0).cast("float")).cast("string")))
    fine = usable(F.col("x")) & F.col("label").isNotNull()
    rows = table(rows.withColumn("fp", F.when(fine, F.concat_ws("|", F.col("label").cast("string"), F.md5(said), F.xxhash64(said).cast("string")))), "rows")
    distinct = rows.where("fp is not null").groupBy("fp").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("copies"))
    numbered = table(distinct.select("fp", "label", "copies", F.size("x").alias("dim"), F.col("x").cast("array<double>").alias("v")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    sizes = numbered.groupBy(F.col("label").alias("l"), F.col("dim").alias("d")).agg(F.count("*").alias("n"))
    vertices = as_bytes(numbered).join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d"))).drop("l", "d")
    vertices = table(vertices.withColumn("group", F.xxhash64(F.col("label").cast("string"), "dim")).drop("label"), "vertices")
    spark, lists, room, kept = df.sparkSession, None, None, {}
    for round_ in range(ROUNDS):
        found = first_lists(buckets(vertices, round_))
        lists = merged(found if lists is None else lists.unionByName(found), room)
        for _ in range(ITERATIONS):
            lists = refine(lists, vertices, room)
        full = table(saturated(lists, room, threshold), "saturated")
        while not (wider := full.where(F.col("cap") < MOST)).isEmpty():
            wider = wider.select("v", F.least(F.col("cap") * 2, F.lit(MOST)).alias("cap"))
            room = table(wider if room is None else room.join(wider, "v", "left_anti").unionByName(wider), "room")
            lists = refine(lists, vertices, room)
            full = table(saturated(lists, room, threshold), "saturated")
        links = table(confirmed(lists, vertices, threshold), "links") if round_ == 0 else table(confirmed(lists, vertices, threshold).unionByName(links).distinct(), "links")
        roots = table(components(links), "roots")
        ever = full.select("v") if room is None else full.select("v").unionByName(room.select("v")).distinct()
        more = beyond_lists(ever, vertices, roots, threshold)
        if more is not None:
            links = table(links.unionByName(more).distinct(), "links")
            roots = table(components(links), "roots")
        members = table(rooted(vertices, roots).repartition(spark.sparkContext.defaultParallelism), "rooted")
        seen = audit(members, threshold, kept)
        failed = [planes for planes, (n, same) in seen.items() if n >= LINKS and same < RECALL * n]
        logging.getLogger(__name__).info("audit of round %d: links seen and found by hyperplanes: %s", round_, seen)
        if failed and round_ == ROUNDS - 1:
            links = table(links.unionByName(swept(members.where(planes_of(F.col("n")).isin(failed)), threshold)).distinct(), "links")
            roots = table(components(links), "roots")
        if report is not None:
            report.update(audit=seen, rounds=round_ + 1, exact=bool(failed and round_ == ROUNDS - 1))
        if not failed and (round_ + 1 >= LEAST or all(n >= LINKS for n, _ in seen.values())):
            break
    counts = link_counts(vertices, roots, threshold)
    ids = numbered.select("fp", F.col("id").alias("node"), "copies").join(roots, "node", "left").join(counts.withColumnRenamed("id", "node"), "node", "left")
    ids = table(ids.select("fp", F.coalesce("root", "node").alias("root"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "ids")
    out = rows.where("fp is not null").select("vec_id", "fp").join(ids, "fp")
    first = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = out.join(first, "root").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    # unusable vectors take no part in the joins: they'd meet in one task
    return out.unionByName(rows.where("fp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.93."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x,
 coalesce(label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings),
l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.rid <> b.rid WHERE a.fine AND b.fine AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT rid AS node, rid AS other FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT r.node AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.other GROUP BY r.node),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
