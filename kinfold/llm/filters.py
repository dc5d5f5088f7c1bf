"""Filter interaction audit: what every order of five filters removes, step by step, in every part of the corpus.

Each document has a mask of the filters that it fails. A table of 32 masks by 120 orders tells the step at which an order
removes it; ``mapInArrow`` looks masks up there and counts removals by part, order, step and label with ``np.bincount``.
A task gives one array for each part that it has seen, however many rows the part has; arrays are summed, first in salted
groups and then by part, and the report follows from the sums: an order's first step is what fails its filter at all, its
last step is what fails nothing else.

Equal texts meet by a 128-bit digest, so that only the digest and the mask of a row are shuffled, never its text.

Defined cases: a null text is empty, and equal to an empty one; a null source is the part of the empty string; a row fails
E if a row with its text and a smaller doc_id exists, so repeated rows of one id do not fail by each other, and rows without
id neither fail E nor make others fail; labels with several rows of an id count if any of them is 1, and a row without id has
none; further columns are ignored; an empty table gives no rows. Words of a text are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import sized_join, text_batches
from kinfold.llm.tokens import Tokens, Words, buffers, lists, pieces
from kinfold.session import materialize, scratch

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
#: Fewest words; least share of distinct words and most share of capitals, in hundredths; characters of markup and code.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: What is counted of the removals: all, documents of good quality, toxic ones.
KINDS = ("removed", "good_lost", "toxic_lost")
STEPS = len(FILTERS) + 1
CELLS = len(KINDS) * len(ORDERS) * STEPS
#: Parts whose arrays (17 kB each) a task holds at once, and groups in which arrays of a part are summed first.
PARTS_HELD, SALT = 256, 32
RULE = Words(fold=False)
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@cache
def first_failures() -> np.ndarray:
    """By mask and order: the step, from 0, whose filter is the first that fails; ``len(FILTERS)`` if none does."""
    masks = np.arange(1 << len(FILTERS))
    bits = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    fails = (masks[:, None, None] >> bits[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), len(FILTERS))


def text_masks(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that the texts of a binary column fail."""
    data, offsets = buffers(column)
    tokens = Tokens(RULE, column)
    by_hash = np.argsort(tokens.hash)
    order = by_hash[np.argsort(tokens.row[by_hash].astype(np.int32), kind="stable")]
    h, row = tokens.hash[order], tokens.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=tokens.rows)

    def count(inside: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(inside)])
        return total[offsets[1:]] - total[offsets[:-1]]

    points = count((data & 0xC0) != 0x80)
    capitals = count((data >= 65) & (data <= 90))
    marks = count(np.isin(data, np.frombuffer(MARKS, np.uint8)))
    fails = (tokens.count < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * tokens.count, 100 * capitals > MOST_CAPITALS * points, marks > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of every row of ``docs`` (doc_id, text, source)."""

    def judge(batches):
        for batch in pieces(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(text_masks(batch.column("text")), pa.int32())], ["doc_id", "part", "digest", "mask"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    judged = materialize(rows.mapInArrow(judge, "doc_id long, part string, digest binary, mask int"), "masks")
    firsts = materialize(judged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return sized_join(judged, firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def removals(marked: DataFrame, parts_held: int = PARTS_HELD) -> DataFrame:
    """part and cells: removals by kind, order and step of ``marked`` (part, mask, good, toxic), summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, salt = first_failures(), TaskContext.get().partitionId() % SALT
        held: dict[str, np.ndarray] = {}
        at = np.arange(len(ORDERS)) * STEPS
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            # Rows of one part, mask and label are looked up once.
            key = coded.indices.to_numpy().astype(np.int64) * 128 + batch.column("mask").to_numpy() * 4 + batch.column("good").to_numpy() * 2 + batch.column("toxic").to_numpy()
            key, n = np.unique(key, return_counts=True)
            part, mask, label = key >> 7, (key >> 2) & 31, key & 3
            cell = at + table[mask]
            for p in np.unique(part):
                mine = part == p
                weighed = [np.where(keep, n, 0)[mine] for keep in (True, label & 2 > 0, label & 1 > 0)]
                found = [np.bincount(cell[mine].ravel(), np.repeat(w, len(ORDERS)), len(ORDERS) * STEPS) for w in weighed]
                name = coded.dictionary[int(p)].as_py()
                held[name] = held.get(name, 0) + np.concatenate(found).astype(np.int64)
            if len(held) > parts_held:
                yield _arrays(held, salt)
                held = {}
        yield _arrays(held, salt)

    one = marked.mapInArrow(count, "part string, salt int, cells array<long>")
    two = one.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(_sums, one.schema)
    return two.withColumn("salt", F.lit(0)).repartition("part").sortWithinPartitions("part").mapInArrow(_sums, one.schema).drop("salt")


def _arrays(held: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
    cells = np.concatenate([*held.values(), np.zeros(0, np.int64)])
    return pa.record_batch([pa.array(list(held), pa.string()), pa.array(np.full(len(held), salt, np.int32)), lists(cells, np.arange(len(held) + 1) * CELLS)], ["part", "salt", "cells"])


def _sums(batches):
    """Sums of arrays with equal part and salt, which stand together."""
    at, total = None, None
    for batch in batches:
        for part, salt, cells in zip(batch.column("part").to_pylist(), batch.column("salt").to_pylist(), batch.column("cells"), strict=True):
            cells = cells.values.to_numpy()
            if (part, salt) == at:
                total = total + cells
                continue
            if at:
                yield _arrays({at[0]: total}, at[1])
            at, total = (part, salt), cells
    if at:
        yield _arrays({at[0]: total}, at[1])


def _report(batches):
    first = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    for batch in batches:
        for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells"), strict=True):
            removed, good, toxic = cells.values.to_numpy().reshape(len(KINDS), len(ORDERS), STEPS)
            here = removed[:, :-1]
            kept = removed[0].sum() - np.cumsum(here, 1)
            fails, alone, shapley = (np.zeros(len(FILTERS), np.int64) for _ in range(3))
            fails[first[:, 0]] = here[:, 0]
            alone[first[:, -1]] = here[:, -1]
            np.add.at(shapley, first, here)
            n = here.size
            columns = (kept, here, fails[first] - here, alone[first], good[:, :-1], toxic[:, :-1], shapley[first])
            yield pa.record_batch(
                [pa.array([part] * n, pa.string()), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist(), pa.string()), pa.array(np.tile(np.arange(1, STEPS, dtype=np.int32), len(ORDERS))), *(pa.array(c.ravel(), pa.int64()) for c in columns)],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )


def audit(docs: DataFrame, labels: DataFrame, parts_held: int = PARTS_HELD) -> DataFrame:
    """A row for each part, order and step; ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic."""
    spark = docs.sparkSession
    text_batches(spark)
    with scratch(spark):
        marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        marks = materialize(marks.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")).filter("good + toxic > 0"), "marks")
        marked = sized_join(masks(docs), marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        return materialize(removals(marked, parts_held).mapInArrow(_report, OUT), "audit", outlive=True)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))


ORACLE_SQL = """
with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t from documents),
f as (select t, min(doc_id) f from d group by t),
w as (select doc_id, part, t, f, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from d join f using (t)),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
  || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > f then 'E' else '' end fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from m group by part, fails),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x o from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r as (select part, fails, n, good, toxic, o, coalesce(list_min(list_filter(range(1, 6), lambda i: contains(fails, substr(o, i, 1)))), 6) hit from c, o),
s as (select part, o, step, substr(o, step, 1) letter, sum(case when hit > step then n else 0 end) kept, sum(case when hit = step then n else 0 end) removed,
  sum(case when hit < step and contains(fails, substr(o, step, 1)) then n else 0 end) redundant, sum(case when fails = substr(o, step, 1) then n else 0 end) unique_fails,
  sum(case when hit = step then good else 0 end) good_lost, sum(case when hit = step then toxic else 0 end) toxic_lost
  from r, (select unnest(range(1, 6)) step) group by part, o, step)
select part, o filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint shapley from s
"""
