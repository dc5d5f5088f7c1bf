"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The mix is a sequence of slots of ``BLOCK`` words. Slot j has the van der Corput point of j; the cumulative target
shares map it to a source; its rank among the slots of that source is the number of the source's block that fills it.
Blocks are cut from the source's documents in an order shuffled by a hash of the id, read as often as the target asks.
The schedule decides how many blocks a source gives: as the points are spread evenly, a few blocks more or less than its
target (the discrepancy of a stretch of the sequence grows with the logarithm of its length). Only where a source runs out
of words (all its documents read ``REPEATS`` times) does a slot stay unfilled.

Running sums never gather a source in one task: ids fall into ranges of their hash, sums of ranges are summed first.

Defined cases: null texts have size 0; a null source is a source of its own, last; sources without words have target 0;
repeated rows are rows of their own; null ids are shuffled like others; further columns, of any name, are ignored; empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.common import WORD
from kinfold.session import materialize

BLOCK = 128
#: The most often that a document is read.
REPEATS = 3
WEIGHTS = 3
#: Ranges of the shuffled order within a source, by hexadecimal digits of the hash; slots of one range of ranks.
HEX_DIGITS = 3
SLOT_RANGE = 1 << 16
#: Sources up to which their targets are broadcast.
MOST_BROADCAST = 100_000
#: Bits of the van der Corput points.
BITS = 44


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the key of the shuffled order."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), key.alias("key"))


def targets(sized: DataFrame) -> DataFrame:
    """One row a source: source, source_size, weight, target.

    Sources stand in the order of size over weight, which is the order in which the rising level reaches their limits;
    the level is the largest that any prefix of limited sources leaves to the others.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    level = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sums.withColumn("weight", (F.row_number().over(order) - 1) % WEIGHTS + 1)
    limit = F.col("source_size") * REPEATS
    before = F.coalesce(F.sum(limit).over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(level.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(every)
    leveled = ranked.withColumn("level", (total - before).cast("double") / after.cast("double"))
    height = F.max("level").over(every)
    return leveled.withColumn("height", height).select("source", "source_size", "weight", F.least(limit.cast("double"), F.col("weight") * F.col("height")).alias("target"))


def _positions(sized: DataFrame) -> DataFrame:
    """Adds ``first``, the words of the source before the document in the shuffled order."""
    ranged = sized.withColumn("range", F.substring("key", 1, HEX_DIGITS))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return local.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).select("doc_id", "source", "size", (F.col("base") + F.col("local")).alias("first"))


def point(slot: Column) -> Column:
    """The van der Corput point of a slot: its bits behind the point, the lowest first."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)


def schedule(goals: DataFrame, total: int, few: bool = True) -> DataFrame:
    """source, slot, rank: the slots of the mix."""
    slots = max(1, -(-total // BLOCK)) if total else 0
    every = W.orderBy("source_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    shares = goals.withColumn("source_order", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    shares = shares.withColumn("upper", F.sum("target").over(every)).withColumn("lower", F.col("upper") - F.col("target"))
    shares = shares.select("source", "lower", "upper", F.max("upper").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("all"))
    # A source's interval is matched over cells of a grid, an equi-join; a cell holds the ends of few intervals.
    cells = 1024
    grid = shares.filter(F.col("upper") > F.col("lower")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") / F.col("all") * cells).cast("int"), F.least(F.floor(F.col("upper") / F.col("all") * cells), F.lit(cells - 1)).cast("int"))))
    drawn = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    at = F.col("point") * F.col("all")
    drawn = drawn.join(F.broadcast(grid) if few else grid, "cell").filter((at >= F.col("lower")) & (at < F.col("upper"))).select("source", "slot", F.floor(F.col("slot") / SLOT_RANGE).alias("range"))
    counts = drawn.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(W.partitionBy("source", "range").orderBy("slot")) - 1
    ranked = drawn.withColumn("local", local).join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return ranked.select("source", "slot", (F.col("base") + F.col("local")).alias("rank"))


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces (source, slot, rank, doc_id, words), and each row of ``docs`` with doc_id, size, source_size, target, taken, n_slots, first_slot."""
    sized = materialize(sizes(docs), "sizes")
    goals = materialize(targets(sized), "targets")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    few = goals.count() <= MOST_BROADCAST
    plan = materialize(schedule(goals, total, few), "plan")
    given = plan.groupBy(F.col("source").alias("g")).agg((F.count("*") * BLOCK).alias("given"))
    # A source gives the blocks that the schedule asks for, as far as its documents go.
    goal = goals.join(given, F.col("source").eqNullSafe(F.col("g")), "left").select(F.col("source").alias("s"), "source_size", "target", F.least(F.coalesce("given", F.lit(0)), F.col("source_size") * REPEATS).alias("words"))
    goal = F.broadcast(goal) if few else goal
    placed = _positions(sized).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("row_no", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    # A document stands in the unrolled stream of its source once in every round.
    rounds = F.sequence(F.lit(0), F.floor((F.col("words") - 1 - F.col("first")) / F.col("source_size")).cast("int"))
    spread = placed.filter((F.col("size") > 0) & (F.col("first") < F.col("words"))).withColumn("round", F.explode(rounds)).withColumn("from", F.col("first") + F.col("round") * F.col("source_size"))
    spread = spread.withColumn("to", F.least(F.col("from") + F.col("size"), "words"))
    spread = spread.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor((F.col("to") - 1) / BLOCK))))
    words = F.least(F.col("to"), (F.col("rank") + 1) * BLOCK) - F.greatest(F.col("from"), F.col("rank") * BLOCK)
    spread = spread.select("source", "rank", "row_no", "doc_id", words.alias("words"))
    plan = plan.select(F.col("source").alias("p_source"), F.col("rank").alias("p_rank"), "slot")
    pieces = spread.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("rank") == F.col("p_rank"))).select("source", "slot", "rank", "row_no", "doc_id", "words")
    taken = pieces.groupBy("row_no").agg(F.sum("words").alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"))
    out = placed.join(taken, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "first_slot")
    return pieces.drop("row_no"), out


ORACLE_SQL = """
with d as (select row_number() over () rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, md5(coalesce(doc_id::varchar, '')) k from documents),
s as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 weight from d group by source),
l as (select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double / (sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following))::double lev from s),
t as (select source s, source_size, least((source_size * 3)::double, weight * max(lev) over ()) target from l),
iv as (select s, target, sum(target) over (order by s nulls last rows unbounded preceding) up from t),
sl as (select j slot, list_sum(list_transform(range(44), lambda b: ((j >> b) & 1)::double / (1::bigint << (b + 1)))) * (select max(up) from iv) p from (select unnest(range((select (sum(size) + 127) // 128 from d)::bigint)) j)),
pl as (select s, slot, row_number() over (partition by s order by slot) - 1 rk from sl join iv on p >= up - target and p < up),
g as (select s, count(*) * 128 given from pl group by s),
p as (select d.*, source_size, target, least(coalesce(given, 0), 3 * source_size) q, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint f from d join t on d.source is not distinct from t.s left join g on g.s is not distinct from t.s),
r as (select rid, source, f + c * source_size a, least(f + c * source_size + size, q) b from p, (select unnest(range(3)) c) where size > 0 and f + c * source_size < q),
k as (select rid, source, a, b, unnest(range(a // 128, (b - 1) // 128 + 1)) rk from r),
w as (select rid, sum(least(b, (k.rk + 1) * 128) - greatest(a, k.rk * 128))::bigint taken, count(*) n_slots, min(slot) first_slot from k join pl on pl.s is not distinct from k.source and pl.rk = k.rk group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken, coalesce(n_slots, 0)::bigint n_slots, first_slot from p left join w using (rid)
"""
