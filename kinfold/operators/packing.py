"""Greedy packing of sorted rows into batches, in blocks of rows side by side.

Where a batch ends depends on where it starts, and so on all batches before it. But a batch has ``most_items`` rows at most,
so the first one that starts inside a block of rows starts at one of its first ``most_items`` rows. A block is therefore a
small table from each such entry to the entry of the next block. The tables of neighbouring blocks are composed in a tree,
entries are handed down that tree, and each block numbers its own rows. No task holds more than a block and the rows after
it that a batch may reach, however long a lane is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.ordering import running
from kinfold.session import materialize, ship

#: Rows of a block, and blocks (or groups of blocks) of a group.
BLOCK_ROWS, FAN = 50_000, 256

SUMMARY = "block long, first string, last string, whole boolean, exits array<int>, starts array<int>"
ENTRY = "block long, entry int, base long"


@dataclass
class Block:
    """Rows in order; those from ``own`` on belong to the next block."""

    lane: np.ndarray
    after: np.ndarray
    begins: np.ndarray
    own: int


def _block(rows: pd.DataFrame, most_items: int, most_bytes: int) -> Block:
    """``after``: for each row the first row behind a batch that starts there."""
    lane = rows.lane.to_numpy(object)
    begins = np.ones(len(rows), bool)
    begins[1:] = lane[1:] != lane[:-1]
    first = np.flatnonzero(begins)
    at = np.arange(len(rows))
    total = np.concatenate([[0], np.cumsum(rows["size"].to_numpy(np.int64))])
    fits = np.searchsorted(total, total[:-1] + most_bytes, side="right") - 1
    lane_end = np.append(first, len(rows))[np.searchsorted(first, at, side="right")]
    after = np.maximum(np.minimum(np.minimum(fits, at + most_items), lane_end), at + 1)
    return Block(lane, after, begins, int((~rows.ahead).sum()))


def _summary(block: Block, most_items: int) -> tuple[list[int], list[int], bool]:
    """For each entry: the entry of the next block, and how many batches of the last row's lane start; whether there is one lane only."""
    n = block.own
    last = int(np.flatnonzero(block.begins[:n])[-1])
    exits, starts = [0] * n, [0] * n
    for s, t in zip(range(n - 1, -1, -1), block.after[:n][::-1].tolist(), strict=True):
        exits[s] = t - n if t >= n else exits[t]
        starts[s] = (s >= last) + (starts[t] if t < n else 0)
    return exits[:most_items], starts[:most_items], last == 0


def _through(summaries: list, entry: np.ndarray, base: np.ndarray):
    """The entries and bases (batches of the open lane before it) of each summary, then those after the last."""
    before = None
    for s in summaries:
        if before is not None and s.first != before.last:
            base = np.zeros_like(base)
        yield entry, base
        # Behind the rows of the last block, which may be short, nothing starts.
        exits, starts = np.append(s.exits, 0), np.append(s.starts, 0)
        inside = np.minimum(entry, len(exits) - 1)
        entry, base = exits[inside], starts[inside] + (base if s.whole else 0)
        before = s
    yield entry, base


def _composed(group: pd.DataFrame) -> pd.DataFrame:
    parts = list(group.sort_values("block").itertuples())
    entries = np.arange(len(parts[0].exits))
    *_, (exits, starts) = _through(parts, entries, np.zeros_like(entries))
    whole = all(p.whole for p in parts) and len({x for p in parts for x in (p.first, p.last)}) == 1
    return pd.DataFrame({"block": [parts[0].parent], "first": [parts[0].first], "last": [parts[-1].last], "whole": [whole], "exits": [exits], "starts": [starts]})


def _handed_down(group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    parts = list(group.sort_values("block").itertuples())
    states = _through(parts, given.entry.to_numpy(), given.base.to_numpy())
    return pd.DataFrame([(p.block, e[0], b[0]) for p, (e, b) in zip(parts, states, strict=False)], columns=["block", "entry", "base"])


def _numbered(block: Block, entry: int, base: int) -> np.ndarray:
    """The batch of each own row, from 0 in every lane; ``base`` batches of the first row's lane started before."""
    begun = np.zeros(block.own, np.int64)
    s = entry
    while s < block.own:
        begun[s] = 1
        s = int(block.after[s])
    count = np.cumsum(begun)
    first = np.flatnonzero(block.begins[: block.own])
    lane = np.searchsorted(first, np.arange(block.own), side="right") - 1
    # Batches of earlier lanes do not count; of the first lane those before the block do.
    offset = count[first] - 1
    offset[0] = -base
    return count - offset[lane] - 1


def packed(items: DataFrame, most_items: int, most_bytes: int, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """id, size, lane, batch: by size and id, as many items as fit both bounds, batch after batch, from 0 in each lane.

    An item beyond ``most_bytes`` is a batch of its own. Null and negative sizes weigh nothing; no lane (null) is a lane. Rows
    of equal lane, size and id may change places.
    """
    if most_items < 1:
        raise ValueError("a batch holds an item at least")
    spark = items.sparkSession
    ship(spark)
    block_rows = max(block_rows, most_items)
    lane = F.coalesce(F.concat(F.lit("="), "lane"), F.lit("")).alias("lane")
    rows = items.select("id", F.col("size").alias("given"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"), lane)
    rows = running(rows, [F.col("lane"), F.col("size"), F.col("id")]).select("id", "given", "size", "lane", (F.col("row_no") - 1).alias("at"))
    block = F.floor(F.col("at") / block_rows)
    # The first rows of a block also follow the block before it.
    reach = F.when((block > 0) & (F.col("at") % block_rows < most_items), F.array(block, block - 1)).otherwise(F.array(block))
    rows = materialize(rows.select("*", F.explode(reach).alias("block")).withColumn("ahead", F.col("block") != block), "packing")
    top = rows.agg(F.max("block")).first()[0]
    if top is None:
        return spark.createDataFrame([], "id long, size long, lane string, batch int")

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        found = _block(group.sort_values("at"), most_items, most_bytes)
        exits, starts, whole = _summary(found, most_items)
        return pd.DataFrame({"block": [group.block.iloc[0]], "first": [found.lane[0]], "last": [found.lane[found.own - 1]], "whole": [whole], "exits": [exits], "starts": [starts]})

    def number(group: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        batch = _numbered(_block(group, most_items, most_bytes), int(given.entry.iloc[0]), int(given.base.iloc[0]))
        return group[~group.ahead][["id", "given", "lane"]].rename(columns={"given": "size"}).assign(batch=batch)

    levels = [materialize(rows.groupBy("block").applyInPandas(summed, SUMMARY), "packing")]
    while top >= fan:
        top //= fan
        parts = levels[-1].withColumn("parent", F.floor(F.col("block") / fan))
        levels.append(materialize(parts.groupBy("parent").applyInPandas(_composed, SUMMARY), "packing"))
    entries = spark.createDataFrame([(0, 0, 0)], ENTRY)
    for level in reversed(levels):
        parts = level.withColumn("parent", F.floor(F.col("block") / fan))
        entries = materialize(parts.groupBy("parent").cogroup(entries.groupBy("block")).applyInPandas(_handed_down, ENTRY), "packing")
    out = rows.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(number, "id long, size long, lane string, batch int")
    return out.withColumn("lane", F.when(F.col("lane") != "", F.expr("substring(lane, 2)")))
