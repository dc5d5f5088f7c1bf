"""Prefix trie of rebuilt conversations.

A turn is 24 bytes: a 128-bit digest of role and text, and the text's code points. A conversation is the array of its turns;
arrays are range-sorted globally, equal ones by conv_id, so that every node of the trie is an interval of rows. A task sweeps
its rows with one stack: the common prefix with the row before tells which intervals end and which begin. Intervals that
touch neither end of a task's rows become nodes there. Of the others - the paths of the task's first and last row, whatever
lies below them counted already - the stacks are written down, and one pass over these, in order of tasks, stitches them.

The pass reads twice the depth of a conversation for each task, and the ids of conversations that end where two tasks meet:
a SHA-256 has to see the ids of its node one after the other. They come in pieces, and no node's ids are held together.

Defined cases: null roles and texts are empty; rows without conv_id belong to no conversation; turns of one number are
ordered by role, then by their digest, and repeated ones are turns of their own; a conversation may have no turn left, it is
a member of the root alone; further columns are ignored; an empty table has no nodes, not even a root. Texts of any length
are digested where they are read; one conversation's turns, 24 bytes each, are a row. Turns and nodes are known by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import sized_join, text_batches
from kinfold.session import materialize, scratch

#: Conversations that share their head, and one more than the most turns of it.
FAMILY, HEADS = 100, 6
#: Ids of a piece.
PIECE = 1 << 12
DONE, FIRST, LAST = 0, 1, 2
#: kind: a node, or an open interval of a task's first or last row; shut: it ended within the task; piece: 0, or the number of a piece of ids.
ROWS = "kind int, part int, depth long, piece int, node binary, parent binary, points long, shut boolean, n long, least long, children long, leaves long, saved long, ends string"
ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("depth", pa.int64()), ("piece", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("points", pa.int64()), ("shut", pa.bool_())]
    + [(c, pa.int64()) for c in ("n", "least", "children", "leaves", "saved")]
    + [("ends", pa.string())]
)
ROOT = bytes(16)
MOST = 2**63 - 1


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (24 bytes each) of every conversation, its head taken from the first of its family."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.concat(F.unhex(F.md5(named)), F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 16, "0")))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn.alias("unit"))
    # Of a turn its number, role and digest are shuffled, not its text.
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "unit"))).alias("turns"))
    own = materialize(own.select("conv_id", F.col("turns.unit").alias("turns")), "own")
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = materialize(own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head")), "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = sized_join(own.withColumn("family", family).withColumn("h", h), heads, "family", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class _Node:
    """An interval that is open: what is known of it and of all that ended below it."""

    __slots__ = ("children", "depth", "ends", "id", "leaves", "least", "n", "parent", "points", "raw", "saved", "sha", "shut", "some", "wide")

    def __init__(self, depth: int, node: bytes, parent: bytes | None, points: int, wide: bool):
        self.depth, self.id, self.parent, self.points = depth, node, parent, points
        self.n, self.least, self.children, self.leaves, self.saved = 0, MOST, 0, 0, 0
        #: wide: it may have begun before the rows at hand. raw: ids that another task may have to go on with.
        self.wide, self.shut, self.raw, self.ends = wide, False, [], None
        self.sha, self.some = hashlib.sha256(), False

    def take(self, ids: str) -> None:
        self.sha.update(("," if self.some else "").encode() + ids.encode())
        self.some = True

    def no_more_ends(self) -> None:
        """A row goes below this node: rows that end at it came before."""
        if not self.wide and self.raw is not None:
            self.ends, self.raw = self.sha.hexdigest(), None

    def finish(self, above: _Node | None) -> tuple:
        """The node's row; its sums go to the node above."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.points
        if above:
            above.n, above.least, above.children = above.n + self.n, min(above.least, self.least), above.children + 1
            above.leaves, above.saved = above.leaves + self.leaves, above.saved + self.saved
        return self.row(DONE, 0, self.ends or self.sha.hexdigest())

    def row(self, kind: int, part: int, ends: str | None) -> tuple:
        return kind, part, self.depth, 0, self.id, self.parent, self.points, self.shut, self.n, self.least, self.children, self.leaves, self.saved, ends

    def rows(self, kind: int, part: int) -> Iterator[tuple]:
        """What the stitching pass needs of an open interval."""
        yield self.row(kind, part, self.ends)
        ids = self.raw or []
        for i in range(0, len(ids), PIECE):
            yield kind, part, self.depth, 1 + i // PIECE, *[None] * 9, ",".join(map(str, ids[i : i + PIECE]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(ARROW), ARROW.types, strict=True)], schema=ARROW)


def _sweep(batches):
    part = TaskContext.get().partitionId()
    stack: list[_Node] = []
    path: list[bytes] = []
    out: list[tuple] = []

    def end(node: _Node) -> None:
        if node.wide:
            node.shut = True
            out.extend(node.rows(FIRST, part))
        else:
            node.no_more_ends()
            out.append(node.finish(stack[-1]))

    for batch in batches:
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            first = not stack
            if first:
                stack.append(_Node(0, ROOT, None, 0, True))
            k = 0
            for a, b in zip(path, turns, strict=False):
                if a != b:
                    break
                k += 1
            while len(stack) > k + 1:
                end(stack.pop())
            for turn in turns[k:]:
                above = stack[-1]
                above.no_more_ends()
                node = hashlib.md5(above.id + turn, usedforsecurity=False).digest()
                stack.append(_Node(len(stack), node, above.id, int.from_bytes(turn[16:]), first))
            path, top = turns, stack[-1]
            top.n, top.least = top.n + 1, min(top.least, conv)
            top.take(str(conv))
            top.raw.append(conv)
        yield _batch(out)
        out = []
    for node in stack:
        out.extend(node.rows(FIRST if node.wide else LAST, part))
    yield _batch(out)


def _stitch(batches):
    """Nodes of the open intervals, which come by task, first rows before last ones, from the root down."""
    stack: list[_Node] = []
    out: list[tuple] = []
    at, along, depth = None, False, 0

    def cut(size: int) -> None:
        while len(stack) > size:
            node = stack.pop()
            out.append(node.finish(stack[-1] if stack else None))

    def leave() -> None:
        """All rows of a task's first or last row have been seen."""
        if at and at[1] == FIRST:
            cut(depth + 1)
            while stack and stack[-1].shut:
                cut(len(stack) - 1)

    for batch in batches:
        for kind, part, depth_, piece, node, parent, points, shut, n, least, children, leaves, saved, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, kind) != at:
                leave()
                at, along = (part, kind), kind == FIRST
            depth = depth_
            if piece:
                stack[depth].take(ends)
                continue
            along = along and depth < len(stack) and stack[depth].id == node
            if not along:
                cut(depth)
                stack.append(_Node(depth, node, parent, points, True))
            own = stack[depth]
            own.n, own.least, own.children = own.n + n, min(own.least, least), own.children + children
            own.leaves, own.saved, own.shut = own.leaves + leaves, own.saved + saved, shut
            own.ends = ends or own.ends
        yield _batch(out)
        out = []
    leave()
    cut(0)
    yield _batch(out)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node; ``conversations``: conv_id, turn, role, text."""
    spark = conversations.sparkSession
    text_batches(spark)
    with scratch(spark):
        arrays = materialize(rebuilt(conversations), "arrays")
        ordered = arrays.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id").select("conv_id", "turns")
        swept = materialize(ordered.mapInArrow(_sweep, ROWS), "swept")
        stacks = swept.filter(F.col("kind") != DONE).repartition(1).sortWithinPartitions("part", "kind", "depth", "piece")
        stitched = materialize(stacks.mapInArrow(_stitch, ROWS), "stitched")
        nodes = swept.filter(F.col("kind") == DONE).unionByName(stitched)
        above = materialize(nodes.filter("children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id")), "above")
        named = sized_join(nodes, above, "parent", "left")
        out = named.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), "node", "parent")
        return materialize(out, "trie", outlive=True)


def digest(conversations: DataFrame) -> DataFrame:
    return trie(conversations.select("conv_id", "turn", "role", "text")).drop("node", "parent")


ORACLE_SQL = """
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null),
own as (select conv_id, list({'r': r, 't': t} order by turn nulls first, r, md5(strlen(r)::varchar || ':' || r || t)) s,
  xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 6 h from t group by conv_id),
r as (select o.conv_id c, list_concat(coalesce(b.s, [])[1:o.h], o.s[o.h + 1:]) s from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
m as (select c, len(s) n, d, s[1:d] p from (select c, s, unnest(range(0, len(s) + 1)) d from r)),
n as (select d, p, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(case when n = d then c::varchar end, ',' order by c), '')) ends from m group by d, p),
k as (select d - 1 d, p[1:d - 1] p, count(*) n_children from n where d > 0 group by 1, 2),
e as (select n.*, coalesce(n_children, 0) n_children, case when n.d = 0 then 0 else (n_convs - 1) * length(n.p[n.d].t) end own from n left join k using (d, p)),
a as (select ad d, p[1:ad] p, count(*) filter (n_children = 0) n_leaves, sum(own) saved from (select d, p, n_children, own, unnest(range(0, d + 1)) ad from e) group by 1, 2)
select e.conv_id::bigint conv_id, e.d::bigint depth, q.conv_id::bigint parent_conv_id, e.n_convs::bigint n_convs, e.n_children::bigint n_children, a.n_leaves::bigint n_leaves, a.saved::bigint saved_tokens, e.ends ends_sha256
from e join a using (d, p) left join e q on q.d = e.d - 1 and q.p = e.p[1:e.d - 1]
"""
