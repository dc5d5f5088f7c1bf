"""N-gram Jaccard self-join by a token-group matrix.

1. Every text becomes its set of shingle hashes. Texts with equal sets are one class, known by a hash of the set.
2. Classes are partitioned into groups of similar ones: the hash space is cut into parts, and of the classes that share
   the least shingle of a part the most central one leads (its least shingles are the most common). A class belongs to the
   leader that it shares most parts with, ``ALIKE`` at least, and is compared with it; verified links make the first roots.
3. The matrix. All sets stand in one order of tokens, and two sets that reach the threshold share ``SHARED`` tokens of
   their prefixes. The cells of the matrix are the prefix tokens that a group holds; tokens that no other root holds bound
   what a class can share with sets that are not larger, and most classes end here. A query and a group meet where they
   share enough cells under different roots and the larger one's bound allows 3/7 of both sizes. There the group's members lie in a task as the union of all
   their tokens, a chunk at a time: a query of n tokens opens the chunk if the union holds ceil(0.75 n) of them, the least
   that any partner must share, and only then members are counted, all shingles of both. Of two groups the larger one is
   stored and the smaller one asks; within a group those ask that the leader's root does not hold. A chunk tells a link
   only if its own links do not connect the two already, so that no group emits its pairs.
4. Components of all links give the classes of near copies.

Frequent tokens stand last in the order, so that prefixes hold rare ones; any order gives the same links, hence the
frequent ones may be taken from a sample of texts. They are broadcast, ``MOST_FREQUENT`` at most.

A shingle and a class are known by 64 bits; two different ones of n are taken for one with probability n^2 / 2^65.

Defined cases: null and empty texts have no shingles and link with nothing; a text of fewer than five words is one
shingle; repeated rows and exact copies share a class; a null id takes the component_id of its links, null if it is
alone; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import sized_join, text_batches
from kinfold.llm.components import components
from kinfold.llm.tokens import Tokens, U, Words, lists, mix, pieces, shingle_sets
from kinfold.session import materialize, scratch

WIDTH = 5
#: Intersection over union from which two documents link, in hundredths.
THRESHOLD = 75
#: Tokens that the prefixes of two linked sets share at least (all of a smaller overlap).
SHARED = 3
#: One text in so many tells which tokens are frequent, from so many sampled texts on.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 4, 500_000
#: Parts of the hash space with a least shingle each, as a power of two; parts by which a class follows a leader.
PARTS_BITS, ALIKE = 4, 4
#: Shingles of a group's members that lie in a task at once.
CHUNK = 1 << 20
#: Tokens of several groups that are broadcast, 8 bytes each; more of them are joined.
MOST_CELLS = 2_000_000
#: Pairs with texts that are broadcast.
MOST_ROLES = 300_000
RULE = Words()
#: Stands for a null id in joins.
NO_ID = -(2**63) + 11


def _needed(n: np.ndarray) -> np.ndarray:
    """The least overlap with which a set of n tokens can reach the threshold."""
    return -(-THRESHOLD * n // 100)


def _set_hash(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(value ^ U(0x5851F42D4C957F2D)), dtype=U)])
    n = (cut[1:] - cut[:-1]).astype(U)
    return mix((total[cut[1:]] - total[cut[:-1]]) ^ mix(n))


def _held(sorted_: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of ``value`` are in ``sorted_``."""
    if not len(sorted_):
        return np.zeros(len(value), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, value), len(sorted_) - 1)] == value


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def frequent_tokens(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Tokens of several sampled texts, the most frequent of them up to MOST_FREQUENT."""

    def cut(batches):
        for batch in pieces(batches, "text"):
            yield pa.record_batch([pa.array(shingle_sets(Tokens(RULE, batch.column("text")), width)[0].view(np.int64))], ["token"])

    sampled = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary").alias("text")).distinct()
    counts = materialize(sampled.mapInArrow(cut, "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT), "frequent")
    least, total = None, 0
    # One row for each count, the highest first.
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        total += r.k
        if total > MOST_FREQUENT:
            break
        least = r.n
    if least is None:
        return np.zeros(0, U)
    return np.sort(counts.filter(F.col("n") >= least).select("token").toArrow()["token"].to_numpy().view(U))


def signatures(docs: DataFrame, frequent: np.ndarray, width: int = WIDTH) -> DataFrame:
    """doc_id, id (null: NO_ID), text_hash, n, cid (null without shingles), least shingles by part, and the prefix.

    The prefix is the first n - needed + SHARED tokens of the set, frequent ones last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches):
        late = shared.value
        for batch in pieces(batches, "text"):
            value, cut = shingle_sets(Tokens(RULE, batch.column("text")), width)
            n = np.diff(cut)
            owner = np.repeat(np.arange(len(n)), n)
            part = (value >> U(64 - PARTS_BITS)).astype(np.int64) + owner * (1 << PARTS_BITS)
            least = np.ones(len(value), bool)
            least[1:] = part[1:] != part[:-1]
            cid = _set_hash(value, cut)
            split = lambda value, keep: lists(value[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(n)))]))
            ranked = value[np.argsort(owner * 2 + _held(late, value), kind="stable")]
            first = np.arange(len(value)) - cut[owner] < (n - _needed(n) + SHARED)[owner]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(n.astype(np.int32)), pa.array(cid.view(np.int64), mask=n == 0), split(value, least), split(ranked, first)], ["doc_id", "text_hash", "n", "cid", "least", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n int, cid long, least array<long>, prefix array<long>").withColumn("id", _id())


def opened(queries: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """a, b: links of queries with members of their groups, as many as connect the roots that they connect.

    queries: grp, cid, root; members: grp, cid, root, n of the same groups. A group's members are cut into chunks of about
    CHUNK shingles, and a query meets every chunk.
    """
    parts = members.groupBy("grp").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("parts"))
    stored = members.join(parts, "grp").select("grp", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "cid", "root")
    asked = queries.join(parts, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "cid", "root")
    roles = materialize(stored.unionByName(asked).join(classes.select("cid", "id"), "cid"), "roles")
    texts = sized_join(docs.select(_id().alias("id"), F.col("text").cast("binary").alias("text")), roles, "id", most=MOST_ROLES)
    ordered = texts.select("grp", "part", "role", "cid", "root", "text").repartition("grp", "part").sortWithinPartitions("grp", "part", "role", "cid")

    def compare(batches):
        at, sets, union = None, {}, None
        for batch in pieces(batches, "text"):
            value, cut = shingle_sets(Tokens(RULE, batch.column("text")), width)
            cid = _set_hash(value, cut).view(np.int64)
            grp, part, role, want, root = (batch.column(c).to_numpy() for c in ("grp", "part", "role", "cid", "root"))
            hits = []
            # Rows of one id with different texts: only that of the class counts.
            for i in np.flatnonzero(cid == want):
                if (grp[i], part[i]) != at:
                    at, sets, union = (grp[i], part[i]), {}, None
                mine = value[cut[i] : cut[i + 1]]
                if role[i] == 0:
                    sets[int(want[i])] = (int(root[i]), mine.copy())
                    continue
                if union is None:
                    union = _Union(sets)
                hits += [(int(want[i]), m) for m in union.partners(mine, int(root[i]))]
            yield pa.record_batch([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], ["a", "b"])

    return ordered.mapInArrow(compare, "a long, b long")


class _Union:
    """The token union of a chunk of members, with the members of each token."""

    def __init__(self, sets: dict[int, tuple[int, np.ndarray]]):
        self.ids = np.array(list(sets), np.int64)
        self.root = np.array([r for r, _ in sets.values()], np.int64)
        self.size = np.array([len(x) for _, x in sets.values()], np.int64)
        tokens = np.concatenate([x for _, x in sets.values()]) if sets else np.zeros(0, U)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(self.ids)), self.size)[order]
        self.token, first = np.unique(tokens[order], return_index=True)
        self.cut = np.append(first, len(tokens))
        self.joined: dict[int, int] = {}

    def find(self, root: int) -> int:
        while (up := self.joined.get(root, root)) != root:
            self.joined[root] = self.joined.get(up, up)
            root = up
        return root

    def partners(self, mine: np.ndarray, root: int) -> list[int]:
        """Members that reach the threshold and that no link told before connects with ``root``."""
        if not len(self.token):
            return []
        at = np.minimum(np.searchsorted(self.token, mine), len(self.token) - 1)
        at = at[self.token[at] == mine]
        if len(at) < _needed(len(mine)):
            return []
        n = self.cut[at + 1] - self.cut[at]
        new = np.cumsum(n) - n
        same = np.bincount(self.owner[np.repeat(self.cut[at] - new, n) + np.arange(n.sum())], minlength=len(self.ids))
        out = []
        for k in np.flatnonzero((100 * same >= THRESHOLD * (len(mine) + self.size - same)) & (self.root != root)):
            x, y = self.find(root), self.find(int(self.root[k]))
            if x != y:
                self.joined[x] = y
                out.append(int(self.ids[k]))
        return out


def groups(classes: DataFrame) -> DataFrame:
    """cid, grp: the leader that each class belongs to; a class without one leads itself."""
    tokens = classes.select("cid", F.size("least").alias("parts"), F.explode("least").alias("token"))
    sizes = tokens.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    central = tokens.join(sizes, "token").groupBy("cid", "parts").agg(F.sum("k").alias("centre"), F.collect_list("token").alias("shared"))
    spread = materialize(central, "central").select("cid", "parts", "centre", F.explode("shared").alias("token"))
    lead = spread.groupBy("token").agg(F.max(F.struct("centre", "cid")).alias("lead")).select("token", F.col("lead.cid").alias("lead"))
    led = spread.join(lead, "token").groupBy("cid", "lead", "parts").agg(F.count("*").alias("alike")).filter(F.col("alike") >= F.least(F.lit(ALIKE), "parts"))
    best = led.groupBy("cid").agg(F.max(F.struct("alike", "lead")).alias("best")).select("cid", F.col("best.lead").alias("lead"))
    return classes.select("cid", "n").join(best, "cid", "left").select("cid", "n", F.coalesce("lead", "cid").alias("grp"))


def star_links(placed: DataFrame, classes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Verified links (a, b) of classes to their leaders; ``placed``: cid, grp, n."""
    led = placed.filter("cid <> grp").select("grp", "cid", F.col("cid").alias("root"))
    leaders = led.select(F.col("grp").alias("cid")).distinct().join(placed.select("cid", "n"), "cid")
    return opened(led, leaders.select(F.col("cid").alias("grp"), "cid", F.col("cid").alias("root"), "n"), classes, docs, width)


def cells(rows: DataFrame) -> DataFrame:
    """cid, grp, root, n, bound, tokens: the prefix tokens that other roots hold too; ``rows``: cid, grp, root, n, prefix.

    bound: n less the prefix tokens that no other root's prefix holds, the most that a partner of n tokens or fewer can share:
    what such a partner holds behind its own prefix is no more than what stands behind this one. Of any partner at least
    SHARED tokens are in both prefixes; classes that hold fewer are left out.
    """
    posted = rows.select("root", F.explode("prefix").alias("token"))
    several = materialize(posted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token"), "several")
    if several.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        found = rows.select("cid", F.explode("prefix").alias("token")).join(several, "token").groupBy("cid").agg(F.collect_list("token").alias("tokens"))
        held_rows = rows.join(found, "cid")
    else:
        shared = rows.sparkSession.sparkContext.broadcast(np.sort(several.toArrow()["token"].to_numpy()))

        @F.arrow_udf("array<long>")
        def held(prefix: pa.Array) -> pa.Array:
            value = prefix.flatten().to_numpy()
            keep = _held(shared.value, value)
            count = np.concatenate([[0], np.cumsum(keep)])
            return lists(value[keep], count[np.concatenate([[0], np.cumsum(prefix.value_lengths().to_numpy())])])

        held_rows = rows.withColumn("tokens", held("prefix"))
    bound = F.col("n") - F.size("prefix") + F.size("tokens")
    fits = (100 * F.col("bound") >= THRESHOLD * F.col("n")) & (F.size("tokens") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * THRESHOLD / 100)))
    return held_rows.select("cid", "grp", "root", "n", bound.alias("bound"), "tokens").filter(fits)


def matrix_links(rows: DataFrame, mains: DataFrame, classes: DataFrame, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between roots; ``rows``: cid, grp, root, n, prefix; ``mains``: grp, main, the leader's root."""
    held = materialize(cells(rows), "cells")
    sizes = held.groupBy("grp").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("bound").alias("most"))
    sizes = materialize(sizes.join(mains, "grp"), "sizes")
    posted = held.select("cid", "grp", "root", "n", "bound", F.explode("tokens").alias("token"))
    # Two sets of n and m tokens link if they share 3/7 (n + m). A bound holds against partners that are not larger; against
    # larger ones theirs holds. The smallest and the largest holder of a token tell who may link at all.
    enough = lambda bound, n: (100 + THRESHOLD) * bound >= THRESHOLD * n
    holders = posted.groupBy("token").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.min("n").alias("smallest"), F.max("n").alias("largest")).filter("first <> last").select("token", "smallest", "largest")
    may = enough(F.col("bound"), F.col("n") + F.col("smallest")) | (F.col("largest") > F.col("n"))
    posted = materialize(posted.join(holders, "token").filter(may).select("token", "cid", "grp", "root", "n", "bound"), "matrix")
    asked = posted.join(sizes.select("grp", "members", "main"), "grp")
    union = posted.groupBy("token", "grp").agg(F.min("root").alias("first"), F.max("root").alias("last")).join(sizes, "grp").select("token", F.col("grp").alias("other"), F.col("members").alias("others"), "first", "last", "low", "high", "most")
    asks = F.when(F.col("grp") == F.col("other"), F.col("root") != F.col("main")).otherwise((F.col("members") < F.col("others")) | ((F.col("members") == F.col("others")) & (F.col("grp") < F.col("other"))))
    n, low, high = F.col("n"), F.col("low"), F.col("high")
    smaller = (low <= n) & (THRESHOLD * n <= 100 * high) & enough(F.least("bound", "high"), n + low)
    larger = (high > n) & (THRESHOLD * low <= 100 * n) & enough(F.least("most", "n"), n + F.greatest(low, n))
    near = smaller | larger
    meet = asked.join(union, "token").filter(asks & near & ((F.col("first") != F.col("root")) | (F.col("last") != F.col("root"))))
    needed = F.least(F.lit(SHARED), F.ceil(F.col("n") * THRESHOLD / 100))
    queries = meet.groupBy("cid", "root", "n", "other").agg(F.count("*").alias("overlap")).filter(F.col("overlap") >= needed)
    queries = materialize(queries.select(F.col("other").alias("grp"), "cid", "root"), "queries")
    members = held.select("grp", "cid", "root", "n").join(queries.select("grp").distinct(), "grp", "left_semi")
    return opened(queries, members, classes, docs, width)


def near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id."""
    return rooted_copies(docs, width).drop("root", "text_hash")


def rooted_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``near_copies`` with the root of their component, null without shingles, and a hash of the text."""
    spark = docs.sparkSession
    text_batches(spark)
    with scratch(spark):
        signed = materialize(signatures(docs, frequent_tokens(docs, width), width), "signatures")
        classes = signed.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least_id"), F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("least").alias("least"), F.any_value("prefix").alias("prefix"))
        classes = materialize(classes, "classes")
        signed = materialize(signed.drop("least", "prefix"), "rows")
        with scratch(spark):
            placed = materialize(groups(classes), "placed", outlive=True)
        with scratch(spark):
            links = materialize(star_links(placed, classes, docs, width), "stars", outlive=True)
        rooted = components(links)
        of = lambda c, name: rooted.select(F.col("node").alias(c), F.col("root").alias(name))
        rows = placed.join(of("cid", "found"), "cid", "left").withColumn("root", F.coalesce("found", "cid")).drop("found")
        rows = materialize(rows.join(classes.select("cid", "least_id", "prefix"), "cid"), "groups")
        mains = placed.select("grp").distinct().join(of("grp", "found"), "grp", "left").select("grp", F.coalesce("found", "grp").alias("main"))
        with scratch(spark):
            more = materialize(matrix_links(rows, mains, classes, docs, width), "matrix", outlive=True)
        # Components of the roots, by the links between them.
        root = lambda c: rows.select(F.col("cid").alias(c), F.col("root").alias(f"{c}_root"))
        joined = components(more.join(root("a"), "a").join(root("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        rooted = rows.select("cid", "least_id", F.col("root").alias("node")).join(joined, "node", "left").select("cid", "least_id", F.coalesce("root", "node").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = rooted.join(least, "root").select("cid", "component_id", "root")
        out = signed.join(named, "cid", "left").select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.col("cid").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")
        return materialize(out, "copies", outlive=True)


def digest(docs: DataFrame) -> DataFrame:
    return near_copies(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: that with the least id (null last), then the least hash of the text; of equal ones, any one.

    Texts without shingles are components of their own; of equal rows with an id one stays, and all rows without id.
    """
    found = rooted_copies(docs.select("doc_id", "text"))
    key = ["kept_id", "kept_hash"]
    linked = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash", F.lit(False).alias("blank"))
    alone = found.filter("root is null").select("doc_id", "text_hash", F.lit(True).alias("blank")).distinct()
    times = found.groupBy(_id().alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg((F.count("*") > 1).alias("repeated"))
    kept = linked.unionByName(alone).select(_id().alias("kept_id"), F.col("text_hash").alias("kept_hash"), "blank").join(times, key)
    kept = materialize(kept.select(*key, (F.col("repeated") & ~(F.col("blank") & (F.col("kept_id") == NO_ID))).alias("many")), "kept")
    keyed = docs.select(F.struct("*").alias("row"), _id().alias("kept_id"), F.xxhash64("text").alias("kept_hash"))
    joined = sized_join(keyed, kept, key)
    once = joined.filter("many").groupBy(*key).agg(F.any_value("row").alias("row"))
    return joined.filter("not many").select("row.*").unionByName(once.select("row.*"))


ORACLE_SQL = """
with recursive d as (select row_number() over () rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select rid, doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
e as (select rid, hash(g.x) t from (select rid, unnest(g) x from s) g),
n as (select rid, doc_id, len(g) n, g from s),
c as (select a.rid a, b.rid b, count(*) o from e a join e b on a.t = b.t and a.rid < b.rid group by 1, 2),
l as (select a, b from c join n x on x.rid = a join n y on y.rid = b where 100 * o >= 75 * (x.n + y.n - o)),
l2 as (select a, b from l union all select b, a from l),
r as (select rid a, rid b from s union select r.a, l2.b from r join l2 on r.b = l2.a)
select x.doc_id, x.n::bigint n_shingles, min(y.doc_id) component_id from r join n x on x.rid = r.a join n y on y.rid = r.b group by x.rid, x.doc_id, x.n
"""
