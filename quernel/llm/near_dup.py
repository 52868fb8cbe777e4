"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles; equal sets are one vertex. Every vertex descends TREES independent trees: from the root FIRST minwise tokens
are chosen at once, then one more at each level (a second with the probability that keeps the expected number of common paths of a pair at
the threshold), by a hash of the path so far. Vertices that agree on the chosen tokens meet in a node. Nodes of up to LEAF vertices are compared
exhaustively by sketches; larger ones branch again. A node still larger at the last level is compared with pivots, a share of its vertices at a time:
a vertex that is not close to an earlier pivot becomes one, and the pivots of all shares are compared with one another. A node gives a spanning forest of the pairs whose sketches may reach the threshold, so a group of copies, however
large, gives a few edges a document; what these connect is a cluster, and all links lie within clusters.

Links are confirmed on full sets: first each vertex's best edge; then, in clusters that this leaves in several parts, all vertices of different
parts, in blocks of bounded size whose intersections are matrix products. Pairs are never rows there; only links that join two parts leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.common import components, small, table, text_batches

MINS, LANES = 64, 64
TREES, FIRST, DEPTH, LEAF = 24, 3, 5, 48
#: Lanes that agree from which a vertex belongs to a pivot and is no pivot itself.
CLOSE = 60
#: Vertices of a block, and columns of a matrix product.
BLOCK, COLUMNS = 256, 8192
#: Vertices of a share of a node that branches no more.
SHARE = 1024

_rng = np.random.default_rng(20240229)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
MUL, ADD = _odd(MINS), _odd(MINS)
WORD_MUL = _odd(64)
#: A letter's digit: its byte, A-Z as a-z, and one so that none is zero.
DIGIT = np.arange(1, 257, dtype=np.uint64)
DIGIT[65:91] = DIGIT[97:123]
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
#: Prime moduli and a base for each. Modulo a power of two, long regular words (Thue-Morse) would collide whatever the base.
FIELDS = [(2**31 - 1, 1_157_920_891), (2**31 - 19, 1_838_215_453)]
PIECE = 1 << 20
#: Digits times powers that can be summed before a remainder is needed.
SUMMED = 1 << 24


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in FIELDS]


def powers(n: int) -> list[list[np.ndarray]]:
    """For each field n or more powers of its base, and of the base's inverse."""
    for (modulus, base), found in zip(FIELDS, _powers):
        for k, x in enumerate((base, pow(base, -1, modulus))):
            while len(p := found[k]) < n:
                found[k] = np.concatenate((p, p * np.uint64(pow(x, len(p), modulus)) % np.uint64(modulus)))
    return _powers


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word; pieces end at white space, so that powers go no further than a piece or a longer word."""
    out, at = [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE:
            end = max(raw.rfind(c, at, at + PIECE) for c in b" \n\t\r\v\f") + 1
            if end <= at:  # a word longer than a piece
                end = min((k for c in b" \n\t\r\v\f" if (k := raw.find(c, at)) >= 0), default=len(raw) - 1) + 1
        b = np.frombuffer(raw, np.uint8, end - at, at)
        at = end
        edges = np.flatnonzero(np.diff(GAP[b].view(np.int8), prepend=1, append=1))
        if not len(edges):
            continue
        start, stop = edges[::2], edges[1::2]
        digits, found = DIGIT[b], mix((stop - start).astype(np.uint64))
        for (modulus, _), (up, down) in zip(FIELDS, powers(len(b))):
            p, terms = np.uint64(modulus), digits * up[: len(b)]
            total = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(terms if len(b) <= SUMMED else terms % p, out=total[1:])
            found = mix(found ^ (total[stop] - total[start]) % p * down[start] % p)
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; of the whole sequence where it has fewer words; none without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    w = word_hashes(raw) if raw else np.zeros(0, np.uint64)
    if not len(w):
        return np.zeros(0, np.uint64)
    n = min(k, len(w))
    h = sum((w[i : len(w) - n + 1 + i] * WORD_MUL[i] for i in range(n)), np.full(len(w) - n + 1, n, np.uint64))
    return np.unique(mix(h))


def fingerprint(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def minwise(s: np.ndarray) -> np.ndarray:
    best = np.full(MINS, ~np.uint64(0), np.uint64)
    for i in range(0, len(s), 2048):
        best = np.minimum(best, (s[i : i + 2048, None] * MUL + ADD).min(0))
    return (best >> np.uint64(32)).astype(np.uint32)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def signatures(df: DataFrame, text: str, k: int) -> DataFrame:
    """Each row's columns but text, with n_shingles long, fp binary (null for an empty set) and sig binary."""
    keys = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "n_shingles long", "fp binary", "sig binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            n, fp, sig = [], [], []
            for x in batch.column(at):
                s = shingles(x.as_py(), k)
                n.append(len(s))
                fp.append(fingerprint(s))
                sig.append(minwise(s).tobytes() if len(s) else None)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=[*keys, "n_shingles", "fp", "sig"])

    return text_batches(df).select(*keys, text).mapInArrow(run, schema)


def unpack(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def follow(path: np.ndarray, sig: np.ndarray, choice: int) -> np.ndarray:
    """The next node of each path: it hashes which minwise token it chooses, and that token."""
    chosen = mix(path + np.uint64(choice)) % np.uint64(MINS)
    token = sig[np.arange(len(sig)), chosen.astype(np.int64)].astype(np.uint64)
    return mix(path * np.uint64(3) + mix(chosen << np.uint64(32) | token))


def descend(vertices: DataFrame) -> DataFrame:
    """vertices (fp, sig) -> their first nodes: path long, fp, sketch binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                sig = unpack(part.column(1), np.uint32, MINS)
                sketch = pa.array([row.tobytes() for row in sig[:, :LANES].astype(np.uint8)], pa.binary())
                for tree in range(TREES):
                    path = np.full(len(sig), mix(np.array([tree + 1], np.uint64))[0], np.uint64)
                    for _ in range(FIRST):
                        path = follow(path, sig, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column(0), sketch], names=["path", "fp", "sketch"])

    return vertices.select("fp", "sig").mapInArrow(run, "path long, fp binary, sketch binary")


def branch(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (path, fp, sig) of nodes too large -> their nodes on the next level."""
    second = int((1 / threshold - 1) * 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path, sig = batch.column(0).to_numpy().view(np.uint64), unpack(batch.column(2), np.uint32, MINS)
            sketch = pa.array([row.tobytes() for row in sig[:, :LANES].astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(follow(path, sig, 0).view(np.int64)), batch.column(1), sketch], names=["path", "fp", "sketch"])
            more = np.flatnonzero(mix(path + np.uint64(11)) % np.uint64(1024) < second)
            if len(more):
                yield pa.RecordBatch.from_arrays([pa.array(follow(path[more], sig[more], 1).view(np.int64)), batch.column(1).take(pa.array(more)), sketch.take(pa.array(more))], names=["path", "fp", "sketch"])

    return rows.select("path", "fp", "sig").mapInArrow(run, "path long, fp binary, sketch binary")


def least_lanes(threshold: float) -> int:
    """Lanes that must agree: five deviations below what the threshold expects."""
    return max(1, int(LANES * threshold - 5 * (LANES * threshold * (1 - threshold)) ** 0.5))


def nodes_of(rows: DataFrame, keys: tuple[str, ...], work: Callable[[tuple, list[bytes], np.ndarray], Iterator[tuple]]) -> DataFrame:
    """rows (keys, fp, sketch) -> what work makes of each node: (path, a, b, lanes), or with b null (path, a, sketch) of a pivot. A task holds one node at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, ids, sketches = [], None, [], []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "a", "b", "lanes", "sketch"])

        def ended() -> None:
            if ids:
                out.extend(work(key, ids, np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, LANES)))

        for batch in batches:
            at = [batch.column(i).to_pylist() for i in range(len(keys))]
            for *found, fp, sketch in zip(*at, batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()):
                if (found := tuple(found)) != key:
                    ended()
                    key, ids, sketches = found, [], []
                    if len(out) >= 20_000:
                        yield flushed()
                ids.append(fp)
                sketches.append(sketch)
        ended()
        yield flushed()

    dealt = rows.select(*keys, "fp", "sketch").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(run, "path long, a binary, b binary, lanes int, sketch binary")


def compare(rows: DataFrame, least: int) -> DataFrame:
    """rows (path, fp, sketch) of small nodes: the strongest spanning forest of each node's close pairs."""

    def find(parent: list[int], x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def work(key: tuple, ids: list[bytes], x: np.ndarray) -> Iterator[tuple]:
        if len(ids) < 2:
            return
        same = (x[:, None, :] == x[None, :, :]).sum(2)
        i, j = np.nonzero(np.triu(same >= least, 1))
        parent = list(range(len(ids)))
        for lanes, i, j in sorted(zip(same[i, j].tolist(), i.tolist(), j.tolist()), reverse=True):
            if (u := find(parent, i)) != (v := find(parent, j)):
                parent[u] = v
                yield key[0], ids[i], ids[j], lanes, None

    return nodes_of(rows, ("path",), work).drop("sketch")


def forest(path: int, ids: list[bytes], x: np.ndarray, least: int, close: int) -> Iterator[tuple]:
    """Vertices in their order against pivots: each joins the strongest close pivot of every part that there is, and is a pivot unless close lanes agree with one.
    Edges, then the pivots."""
    pivots, part = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    n = 0
    for i in range(len(ids)):
        same = (x[pivots[:n]] == x[i]).sum(1)
        near = np.flatnonzero(same >= least)
        near = near[np.argsort(-same[near], kind="stable")]
        parts, first = np.unique(part[near], return_index=True)
        for j in near[np.sort(first)].tolist():
            yield path, ids[pivots[j]], ids[i], int(same[j]), None
        joined = int(parts[0]) if len(parts) else i
        if len(parts) > 1:
            part[:n][np.isin(part[:n], parts)] = joined
        if not len(near) or same[near[0]] < close:
            pivots[n], part[n] = i, joined
            n += 1
    for i in pivots[:n].tolist():
        yield path, ids[i], None, 0, x[i].tobytes()


def pivoted(rows: DataFrame, large: DataFrame, least: int) -> DataFrame:
    """rows (path, fp, sketch) of nodes that branch no more; large (path, n): their sizes. (path, a, b, lanes) as compare() gives them.

    A node is dealt to shares of about SHARE vertices, each of which finds its own pivots; these meet, share by share, in cells of their own.
    So no task holds more than two shares of a node, however many copies it has.
    """
    shares = lambda n: F.ceil(F.col(n) / SHARE).cast("int")
    salted = rows.join(small(large), "path").select("path", F.pmod(F.xxhash64("fp"), shares("n")).alias("salt"), "fp", "sketch")
    done = table(nodes_of(salted, ("path", "salt"), lambda key, ids, x: forest(key[0], ids, x, least, CLOSE)), "shares")
    edges = done.where("b is not null").drop("sketch")
    split = table(large.where(F.col("n") > SHARE).select("path"), "split")
    if split.isEmpty():
        return edges
    pivots = done.where("b is null").select("path", F.col("a").alias("fp"), "sketch").join(small(split), "path", "left_semi")
    left = table(pivots.groupBy("path").agg(F.count("*").alias("m")), "left")
    placed = pivots.join(small(left), "path").withColumn("blocks", shares("m")).withColumn("own", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("other", other).select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "sketch")
    met = table(nodes_of(cells, ("path", "i", "j"), lambda key, ids, x: forest(key[0], ids, x, least, LANES + 1)), "pivots")
    return edges.unionByName(met.where("b is not null").drop("sketch"))


def candidates(vertices: DataFrame, threshold: float) -> DataFrame:
    """vertices (fp, sig) as a table() -> distinct pairs a < b whose sketches may reach the threshold, with the lanes that agree: enough to connect all such pairs.

    Sizes of nodes are counted first, which Spark pre-aggregates; only the vertices of small nodes meet, and those of the others go on as they are.
    """
    rows, pairs, least = descend(vertices), None, least_lanes(threshold)
    for depth in range(FIRST, DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"))
        large = table(sizes.where(F.col("n") > LEAF), "large")
        found = table(compare(rows.join(small(large), "path", "left_anti"), least), "nodes")
        pairs = found if pairs is None else pairs.unionByName(found)
        if large.isEmpty():
            break
        if depth == DEPTH:
            pairs = pairs.unionByName(pivoted(rows, large, least))
            break
        rest = rows.select("path", "fp").join(small(large.select("path")), "path", "left_semi")
        rows = table(branch(rest.join(vertices.select("fp", "sig"), "fp"), threshold), "branches")
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lanes")
    return table(pairs.groupBy("a", "b").agg(F.max("lanes").alias("lanes")), "pairs")


def full_sets(df: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """fp, hashes binary: the full sets of the vertices in wanted (fp), made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                sets = [s for x in batch.column(0).slice(i, 128) if len(s := shingles(x.as_py(), k))]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "hashes"])

    made = text_batches(df).select(text).where(F.col(text).isNotNull()).mapInArrow(run, "fp binary, hashes binary")
    return table(made.join(small(wanted), "fp", "left_semi").groupBy("fp").agg(F.first("hashes").alias("hashes")), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard_at_least(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    joined = pairs.select("a", "b").join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b").join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def crossing(x: pa.StructArray, y: pa.StructArray, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between vertices of x and y (fp, root, hashes) that have different roots, one for each two roots."""
    sides = []
    for s in (x, y):
        sets = [np.frombuffer(h, np.uint64) for h in s.field("hashes").to_pylist()]
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(a) for a in sets]), np.array([len(a) for a in sets])))
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]))
    common = np.zeros((len(x), len(y)), np.float32)
    for k in range(0, len(both), COLUMNS):
        part, dense = both[k : k + COLUMNS], []
        for hashes, row, n in sides:
            at = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            hit = part[at] == hashes
            m = np.zeros((len(n), len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    union = sides[0][2][:, None] + sides[1][2][None, :] - common
    known = {r: i for i, r in enumerate(dict.fromkeys(x.field("root").to_pylist() + y.field("root").to_pylist()))}
    rx, ry = (np.array([known[r] for r in s.field("root").to_pylist()]) for s in (x, y))
    i, j = np.nonzero((100 * common.astype(np.int64) >= percent * union.astype(np.int64)) & (rx[:, None] != ry[None, :]))
    a, b, seen = x.field("fp"), y.field("fp"), set()
    for u, v in zip(i.tolist(), j.tolist()):
        key = (rx[u], ry[v]) if rx[u] < ry[v] else (ry[v], rx[u])
        if key not in seen:
            seen.add(key)
            yield a[u].as_py(), b[v].as_py()


def confirm_parts(clusters: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join parts (roots) of clusters; both (node, root). A large part has blocks of its own, which don't meet one another."""
    own = clusters.select(F.col("node").alias("fp"), F.col("root").alias("cluster")).join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = table(own, "members")
    several = own.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cluster")
    parts = own.join(several, "cluster").groupBy("cluster", "root").agg(F.count("*").alias("n")).withColumn("part", F.when(F.col("n") * 2 >= BLOCK, F.col("root")))
    rest = parts.where("part is null").groupBy("cluster").agg(F.sum("n").alias("rest"))
    dealt = parts.join(rest, "cluster", "left").withColumn("blocks", F.ceil(F.when(F.col("part").isNull(), F.col("rest")).otherwise(F.col("n")) / BLOCK).cast("int"))
    dealt = dealt.select(F.col("cluster").alias("c"), F.col("root").alias("r"), "part", "blocks")
    member = own.join(dealt, (F.col("cluster") == F.col("c")) & (F.col("root") == F.col("r"))).join(sets, "fp")
    bucket = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    blocks = table(member.groupBy("cluster", "part", bucket.alias("bucket")).agg(F.collect_list(F.struct("fp", "root", "hashes")).alias("items")).withColumn("id", F.monotonically_increasing_id()), "blocks")
    ids = blocks.select("cluster", "part", "id")
    meets = ids.select("cluster", F.col("part").alias("p"), F.col("id").alias("x")).join(ids.select("cluster", F.col("part").alias("q"), F.col("id").alias("y")), "cluster").where("x <= y AND NOT coalesce(p = q, false)").select("x", "y")
    side = lambda c, items: blocks.select(F.col("id").alias(c), F.col("items").alias(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for x, y in zip(batch.column(0), batch.column(1)) for link in crossing(x.values, y.values, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return meets.join(side("x", "xs"), "x").join(side("y", "ys"), "y").select("xs", "ys").mapInArrow(run, "a binary, b binary")


def group(df: DataFrame, text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """df (any columns) -> its columns but text, with n_shingles, fp and root: the fingerprint that stands for all sets reachable by links
    of 100 * intersection >= 100 * threshold * union, or null for an empty set, which is linked with nothing. Rows stay rows; an empty table stays empty."""
    percent = round(100 * threshold)
    base = table(signatures(df, text, k), "signatures")
    vertices = table(base.where("fp is not null").groupBy("fp").agg(F.first("sig").alias("sig")), "vertices")
    pairs = candidates(vertices, threshold)
    clusters = table(components(pairs), "clusters")
    sets = full_sets(df, text, k, clusters.select(F.col("node").alias("fp")))
    # each vertex's best edge
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("u"), "lanes").unionByName(pairs.select(F.col("b").alias("v"), F.col("a").alias("u"), "lanes"))
    best = both.groupBy("v").agg(F.max(F.struct("lanes", "u")).alias("m")).select(F.least("v", "m.u").alias("a"), F.greatest("v", "m.u").alias("b")).distinct()
    links = table(confirm(best, sets, percent), "links")
    roots = table(components(links), "roots")
    more = table(confirm_parts(clusters, roots, sets, percent), "links")
    if not more.isEmpty():
        roots = table(components(links.unionByName(more)), "roots")
    out = base.drop("sig").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return out.withColumn("root", F.coalesce("root", "fp"))


def keep_one(df: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without near-duplicates: of each component of links the row with the smallest id stays (null ids last, then by a hash of the row).

    Rows without words stay. Columns and their order stay; of identical rows one stays. An empty table stays empty.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    every = [F.to_json(F.struct(f"c{i}")) if t.startswith(("map", "variant")) else F.col(f"c{i}") for i, (_, t) in enumerate(plain.dtypes)]
    # where a row is null matters too, and xxhash64 skips nulls
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in plain.columns])
    marks = {"h1": F.xxhash64(nulls, *every), "h2": F.xxhash64(F.lit(5), *every[::-1], nulls)}
    at = {n: f"c{i}" for i, n in enumerate(names)}
    marked = plain.withColumns(marks)
    grouped = table(group(marked.select(F.col(at[doc_id]).alias("id"), "h1", "h2", F.col(at[text]).alias("text")), "text", k, threshold).where("fp is not null"), "groups")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "h1", "h2")
    firsts = grouped.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = table(grouped.join(firsts, "root").where((F.col("h1") != F.col("first.h1")) | (F.col("h2") != F.col("first.h2"))).select("h1", "h2").distinct(), "gone")
    twice = table(grouped.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2").join(gone, ["h1", "h2"], "left_anti"), "twice")
    left = marked.join(small(gone), ["h1", "h2"], "left_anti")
    once = left.join(small(twice), ["h1", "h2"], "left_anti").select(*plain.columns)
    same = left.join(small(twice), ["h1", "h2"], "left_semi")
    same = same.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in plain.columns]).select(*plain.columns)
    return once.unionByName(same).toDF(*names)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by two-word shingles at 80 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    grouped = table(group(docs, k=2), "groups")
    ids = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(ids, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS MATERIALIZED (SELECT rid, len(s) AS n, unnest(s) AS x FROM s),
l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rid AS node, rid AS other FROM s UNION SELECT r.node, m.v FROM r JOIN (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l) m ON m.u = r.other),
c AS (SELECT r.node AS rid, min(s.doc_id) AS component_id FROM r JOIN s ON s.rid = r.other GROUP BY r.node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN c USING (rid)
"""
