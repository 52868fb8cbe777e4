"""Repair of conversation structure: the cheapest edits that give each conversation the roles (s?(ua)+)?.

A dynamic program over turns and grammar state gives, from the last turn backwards, what the rest costs at least (cost to go); a walk forwards then takes, among
the edits that are tight with it, the ASCII-least: D (delete), I (insert), K (keep), R (rerole). What comes out is rebuilt as role:text lines and hashed.

No conversation has to fit a task. Turns without their texts (a digest stands for each) are ordered by a range partitioning in blocks of about BLOCK rows. A
block's part of a conversation (a segment) is a matrix of least costs from state to state, and matrices multiply (min, +): only conversations that go over blocks need
their products, which give each segment the costs to go at its end. Blocks are then walked once, segments of such conversations from every state that they may be entered in, and a
chain of exits picks the one that holds. Texts meet their edits in one shuffle by conversation, sorted, and stream through the hash, which
no two tasks can share as a digest is sequential; a task holds one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quernel.llm.common import small, table, text_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after s, after u, after a. NEXT is where the one role that may be put in (user, or assistant after a user) leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Where a role's initial leads from each state; None: not allowed.
STEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: What the rest costs when no turn is left: nothing at the start or after an answer, else what has to be put in.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
NOWHERE = (None,) * 4
FOLLOWS = ("su", "ua", "au")
#: Turns of a block.
BLOCK = 100_000
BLANK, TRUNCATED_TURN, FINE = "blank", "truncated", "fine"


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of df after seeded damage: conv, turn, role, text, copies (0 where the row is dropped, so that its conversation stays known).

    Nulls of role and text, and of conv and turn in the seed, are one space. crc32(conv:turn) % 20: 0 drops, 1 empties the text, 2 removes [.!?], 3 repeats, 4 makes the role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    new = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    return df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(said(role)).alias("role"),
        new.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def fault(text: Column) -> Column:
    """A turn's fault without regard to other turns. One look at a text's end, whatever its length."""
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED_TURN).otherwise(FINE)


def costs(initial: str, cut: bool, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a turn from each state, given those after it."""
    more, steps = TRUNCATED if cut else 0, STEP.get(initial, NOWHERE)
    base = [min(DELETE + after[s], REROLE + more + after[NEXT[s]], FAR if steps[s] is None else KEEP + more + after[steps[s]]) for s in range(4)]
    # turns put in before this one: two are enough, as a third would be back where the first began
    return tuple(min(base[s], INSERT + base[NEXT[s]], 2 * INSERT + base[NEXT[NEXT[s]]]) for s in range(4))


class Turn(NamedTuple):
    """A new turn, or (initial None) copies that have to go."""

    initial: str | None
    cut: bool
    gone: int


def back(turns: list[Turn], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go before each turn, and at the end. What copies cost is the same from any state and isn't in it."""
    out = [end]
    for t in reversed(turns):
        out.append(out[-1] if t.initial is None else costs(t.initial, t.cut, out[-1]))
    return out[::-1]


def walk(turns: list[Turn], after: list[tuple[int, ...]], state: int) -> tuple[int, str, list[tuple[int, list[str], str]]]:
    """The ASCII-least of the cheapest edits from a state, given the costs to go before each turn and at the end.

    Returns the state at the end, the edits' initials, and of each turn that stays its place, the roles put in before it and the role to write ("": its own).
    """
    audit, kept, put = [], [], []
    for i, turn in enumerate(turns):
        while turn.initial is not None:
            left, more, to = after[i][state], TRUNCATED if turn.cut else 0, STEP.get(turn.initial, NOWHERE)[state]
            if left == DELETE + after[i + 1][state]:
                audit.append("D")
            elif left == INSERT + after[i][NEXT[state]]:
                audit.append("I")
                put.append(ROLE[state])
                state = NEXT[state]
                continue
            elif to is not None and left == KEEP + more + after[i + 1][to]:
                audit.append("K")
                kept.append((i, put, ""))
                state, put = to, []
            else:
                audit.append("R")
                kept.append((i, put, ROLE[state]))
                state, put = NEXT[state], []
            break
        audit.append("D" * turn.gone)
    return state, "".join(audit), kept


def closing(state: int) -> list[str]:
    """Roles put in after the last turn."""
    out = []
    while END[state]:
        out.append(ROLE[state])
        state = NEXT[state]
    return out


def _fields(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_int, _long, _text, _bytes, _bool = pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.bool_()
#: A turn's row (kind 1), or what is known of a segment whose conversation goes over its block's ends (kind 0): costs to go at its end, whether it is the first or the last.
SKELETON = ["cid", "block", "seq", "kind", "turn", "role", "digest", "fault", "copies", "first", "togo", "opens", "closes"]
#: A segment as walked from the state entry (kind 0; put and written are its first and last initials), or an edit of a turn that stays (kind 1; place 1: after all turns).
WALKED = _fields(
    cid=_text, block=_long, entry=_int, only=_bool, kind=_int, state=_int, audit=_text, cost=_long, illegal=_long, place=_int, turn=_long, role=_text, digest=_bytes, put=_text, written=_text
)
MATRIX = _fields(cid=_text, block=_long, m=pa.list_(_long))
HASHED = _fields(cid=_text, repaired_sha256=_text)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """Rows in the order of block, cid, kind, seq -> cid, block and rows of each segment; no more than a block at once."""
    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["cid"], r["block"]) != key:
                if rows:
                    yield *key, rows
                key, rows = (r["cid"], r["block"]), []
            rows.append(r)
    if rows:
        yield *key, rows


def turns_of(rows: list[dict]) -> list[Turn]:
    """The turns of a segment's rows. The row of a new turn stands before that of its copies, of which it is one."""
    out, new = [], None
    for r in rows:
        key = (r["turn"], r["role"], r["digest"])
        if r["first"]:
            out.append(Turn(r["role"][:1], r["fault"] == TRUNCATED_TURN, 0))
        else:
            out.append(Turn(None, False, r["copies"] - (new == key)))
        new = key if r["first"] else None
    return out


def illegal(rows: list[dict]) -> int:
    """Neighbours in a segment, copies included, whose initials don't follow one another."""
    heads = [r["role"][:1] for r in rows if not r["first"]]
    return sum(r["copies"] - 1 for r in rows if not r["first"]) + sum(a + b not in FOLLOWS for a, b in zip(heads, heads[1:]))


def out_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def matrices(df: DataFrame) -> DataFrame:
    """cid, block, m: for each segment the least costs from state to state, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cid, block, rows in segments(batches):
            turns = turns_of(rows)
            to = [back(turns, tuple(0 if s == e else FAR for s in range(4)))[0] for e in range(4)]
            yield out_batch([(cid, block, [min(to[e][s], FAR) for s in range(4) for e in range(4)])], MATRIX)

    return df.mapInArrow(run, from_arrow_schema(MATRIX))


def ends(found: DataFrame) -> DataFrame:
    """Matrices of all segments of a conversation -> a row of kind 0 for each, with the costs to go at its end."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        togo, last, out = END, len(frame) - 1, []
        for i, (block, m) in enumerate(reversed(list(zip(frame.block, frame.m)))):
            out.append({"cid": frame.cid.iloc[0], "block": block, "seq": -1, "kind": 0, "togo": list(togo), "opens": i == last, "closes": i == 0})
            togo = tuple(min(int(m[4 * s + e]) + togo[e] for e in range(4)) for s in range(4))
        return pd.DataFrame(out)

    schema = "cid string, block long, seq long, kind int, togo array<long>, opens boolean, closes boolean"
    return found.groupBy("cid").applyInPandas(run, schema)


def walks(df: DataFrame) -> DataFrame:
    """Every segment walked: from the start where its conversation opens, else from each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for cid, block, rows in segments(batches):
            known = rows.pop(0) if rows[0]["kind"] == 0 else None
            only, closes = known is None, known is None or known["closes"]
            end = END if closes else tuple(known["togo"])
            turns, wrong = turns_of(rows), illegal(rows)
            after, gone = back(turns, end), sum(t.gone for t in turns)
            heads = [r["role"][:1] for r in rows if not r["first"]]
            for entry in (START,) if only or known["opens"] else range(4):
                state, audit, kept = walk(turns, after, entry)
                last = closing(state) if closes else []
                cost = after[0][entry] - (0 if closes else end[state]) + DELETE * gone
                out.append((cid, block, entry, only, 0, state, audit + "I" * len(last), cost, wrong, None, None, None, None, heads[0], heads[-1]))
                for i, put, written in kept:
                    r = rows[i]
                    out.append((cid, block, entry, only, 1, None, None, None, None, 0, r["turn"], r["role"], r["digest"], "".join(f"{x}:\n" for x in put), written))
                if last:
                    out.append((cid, block, entry, only, 1, None, None, None, None, 1, None, "", b"", "".join(f"{x}:\n" for x in last), None))
                if len(out) > 5000:
                    yield out_batch(out, WALKED)
                    out = []
        if out:
            yield out_batch(out, WALKED)

    return df.mapInArrow(run, from_arrow_schema(WALKED))


def chain(exits: DataFrame) -> DataFrame:
    """cid, block, entry, state of segments walked from several states -> cid, block, entry: the state that each is entered in."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        leads = {(b, e): s for b, e, s in zip(frame.block, frame.entry, frame.state)}
        state, out = START, []
        for block in sorted(set(frame.block)):
            out.append((frame.cid.iloc[0], block, state))
            state = leads[block, state]
        return pd.DataFrame(out, columns=["cid", "block", "entry"])

    return exits.groupBy("cid").applyInPandas(run, "cid string, block long, entry int")


def digests(said: DataFrame, edits: DataFrame) -> DataFrame:
    """cid, repaired_sha256: texts and their edits, in order, stream through a hash for each conversation."""
    order = ["place", "turn", "role", "digest", "kind"]
    texts = said.where("copies > 0").select("cid", F.lit(0).alias("place"), "turn", "role", _digest(), F.lit(1).alias("kind"), "text", F.lit("").alias("put"), F.lit("").alias("written"))
    changes = edits.select("cid", "place", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit("").alias("text"), "put", "written")
    both = texts.unionByName(changes).repartition("cid").sortWithinPartitions("cid", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, found, written, wanted, out = None, None, False, None, []

        def line(text: str) -> None:
            nonlocal written
            found.update(f"{chr(10) * written}{text}".encode())
            written = True

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != cid:
                    if cid is not None:
                        out.append((cid, found.hexdigest()))
                    cid, found, written, wanted = r[0], hashlib.sha256(), False, None
                _, place, turn, role, digest, kind, text, put, new = r
                if kind == 0:
                    for x in put.split("\n")[:-1]:
                        line(x)
                    wanted = (turn, role, digest, new or role) if place == 0 else None
                elif wanted is not None and wanted[:3] == (turn, role, digest):
                    line(f"{wanted[3]}:{text}")
                    wanted = None  # copies go
            if len(out) > 1000:
                yield out_batch(out, HASHED)
                out = []
        if cid is not None:
            out.append((cid, found.hexdigest()))
        if out:
            yield out_batch(out, HASHED)

    return text_batches(both.select("cid", *order, "text", "put", "written")).mapInArrow(run, from_arrow_schema(HASHED))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows: conv, turn, role, text (no null but in conv and turn), copies long (repetitions side by side; 0 for a row that only names its conversation) -> one row for each conv.

    conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256 (string). Turns go by turn, null first; those that tie by role, then by the sha256 of
    their text, repeated rows side by side. A null conv is a conversation like any other. No rows left: zeros, an empty audit, the hash of nothing. Equal turns are counted before they
    are moved, so a line said a million times is a row. Long texts are never cut. An empty table gives an empty one. Other columns take no part. Only the audit, which is one value, is gathered by conversation.
    """
    cid = F.when(F.col("conv").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))).alias("cid")
    said = rows.select(cid, "conv", F.col("turn").cast("long").alias("turn"), "role", "text", "copies")
    bare = said.select("cid", "conv", "turn", "role", _digest(), fault(F.col("text")).alias("fault"), "copies")
    order = ["cid", "turn", "role", "digest"]
    turns = table(bare.groupBy(*order, "conv", "fault").agg(F.sum("copies").alias("copies")), "turns")
    there = turns.where("copies > 0").select(*order, "fault", "copies", F.lit(False).alias("first"))
    # a turn is new where it is the first of its role and text
    firsts = there.where(F.col("fault") != BLANK).groupBy("cid", "role", "digest").agg(F.min(F.struct("turn", "fault")).alias("x"))
    both = there.unionByName(firsts.select("cid", "x.turn", "role", "digest", "x.fault", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("first")))
    n_blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-turns.count() // block))
    placed = both.repartitionByRange(n_blocks, *order).sortWithinPartitions(*order, F.col("first").desc())
    placed = table(placed.withColumn("seq", F.monotonically_increasing_id()).withColumn("block", F.shiftright("seq", 33)), "placed")

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(n_blocks, "block").sortWithinPartitions("block", "cid", "kind", "seq")

    skeleton = placed.withColumn("kind", F.lit(1))
    over = small(table(placed.groupBy("cid").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("cid"), "over"))
    known = table(ends(matrices(in_order(skeleton.join(over, "cid", "left_semi")))), "ends")
    walked = table(walks(in_order(skeleton.unionByName(known, allowMissingColumns=True).select(*SKELETON))), "walked")
    # at most two segments of a block are entered from outside
    entered = small(table(chain(walked.where("kind = 0 and not only").select("cid", "block", "entry", "state")), "entered"))
    right = walked.where("only").unionByName(walked.where("not only").join(entered, ["cid", "block", "entry"], "left_semi"))

    piece = F.struct("block", "audit", F.col("put").alias("head"), F.col("written").alias("tail"))
    pieces = right.where("kind = 0").groupBy("cid").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    joints = F.filter("p", lambda x, i: (i > 0) & ~F.concat(F.get("p", i - 1)["tail"], x["head"]).isin(*FOLLOWS))
    pieces = pieces.select("cid", "cost", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"), (F.col("illegal") + F.size(joints)).alias("illegal"))
    copies = lambda what: F.sum(F.when(what, F.col("copies")).otherwise(0))
    blank, new = F.col("fault") == BLANK, F.col("first")
    faults = placed.groupBy("cid").agg(copies(blank).alias("blank"), (copies(~blank) - F.count_if(new)).alias("duplicate"), F.count_if(new & (F.col("fault") == TRUNCATED_TURN)).alias("truncated"))
    spans = there.groupBy("cid", "turn").agg(F.count("*").alias("n")).groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = turns.groupBy("cid").agg(F.first("conv").alias("conv"))
    for part in (spans, faults, pieces, digests(said, right.where("kind = 1"))):
        out = out.join(part, "cid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    sha = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return out.select("conv", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), sha)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages and repairs every conversation."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("conv", "conv_id")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
ids AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)),
k AS (SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t, list_transform(string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
      FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id, tab),
d AS (SELECT cid, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM k),
e AS (SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS i FROM e),
r AS MATERIALIZED (SELECT cid, i, turn, role, text, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM f),
g AS (SELECT cid, i, c, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS m FROM r),
n AS MATERIALIZED (SELECT cid, count(*) AS n FROM r GROUP BY cid),
t AS MATERIALIZED (SELECT cid, n AS i, [0, 10, 5, 0] AS t FROM n UNION ALL
 SELECT cid, i, CASE WHEN must THEN [t[1] + 2, t[2] + 2, t[3] + 2, t[4] + 2] ELSE [least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2)] END
 FROM (SELECT t.cid, g.i, must, t, least(2 + t[1], 1 + m + t[3], CASE c WHEN 's' THEN m + t[2] WHEN 'u' THEN m + t[3] END) AS b0, least(2 + t[2], 1 + m + t[3], CASE c WHEN 'u' THEN m + t[3] END) AS b1,
  least(2 + t[3], 1 + m + t[4], CASE c WHEN 'a' THEN m + t[4] END) AS b2, least(2 + t[4], 1 + m + t[3], CASE c WHEN 'u' THEN m + t[3] END) AS b3 FROM t JOIN g ON g.cid = t.cid AND g.i = t.i - 1)),
a AS MATERIALIZED (SELECT t.cid, t.i, t.t AS cur, u.t AS nxt, g.c, g.must, g.m, r.role, r.text FROM t LEFT JOIN t u ON u.cid = t.cid AND u.i = t.i + 1 LEFT JOIN g ON g.cid = t.cid AND g.i = t.i LEFT JOIN r ON r.cid = t.cid AND r.i = t.i),
w AS (SELECT cid, 0::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS said, cur[1] > 0 OR nxt IS NOT NULL AS goes FROM a WHERE i = 0 UNION ALL
 SELECT x.cid, x.i, x.s, audit || edit, CASE edit WHEN 'D' THEN said WHEN 'I' THEN list_append(said, put || ':') WHEN 'K' THEN list_append(said, x.role || ':' || x.text) ELSE list_append(said, put || ':' || x.text) END, b.cur[x.s + 1] > 0 OR b.nxt IS NOT NULL
 FROM (SELECT cid, audit, said, role, text, put, edit, CASE WHEN edit = 'I' THEN i ELSE i + 1 END AS i, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE follows END AS s
  FROM (SELECT *, CASE WHEN nxt IS NULL THEN 'I' WHEN cur[s + 1] = 2 + nxt[s + 1] THEN 'D' WHEN cur[s + 1] = 5 + cur[follows + 1] THEN 'I' WHEN kept IS NOT NULL AND cur[s + 1] = m + nxt[kept + 1] THEN 'K' ELSE 'R' END AS edit
   FROM (SELECT w.cid, w.i, w.s, audit, said, cur, nxt, m, role, text, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS follows, CASE w.s WHEN 2 THEN 'assistant' ELSE 'user' END AS put,
     CASE WHEN c = 's' AND w.s = 0 THEN 1 WHEN c = 'u' AND w.s <> 2 THEN 2 WHEN c = 'a' AND w.s = 2 THEN 3 END AS kept FROM w JOIN a ON a.cid = w.cid AND a.i = w.i WHERE goes))) x JOIN a b ON b.cid = x.cid AND b.i = x.i),
z AS (SELECT cid, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM w WHERE NOT goes),
q AS (SELECT cid, c || lead(c) OVER (PARTITION BY cid ORDER BY i) AS pair FROM r),
l AS (SELECT cid, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY cid),
s AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM r GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(cur[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN s ON s.cid = ids.cid LEFT JOIN l ON l.cid = ids.cid LEFT JOIN z ON z.cid = ids.cid LEFT JOIN a ON a.cid = ids.cid AND a.i = 0
"""
