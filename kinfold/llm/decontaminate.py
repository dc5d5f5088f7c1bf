"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of every text.

Windows are ``width`` consecutive words of an item, or all its words where it has fewer. A hit by hash is verified
against the window's words. The window set is broadcast only up to ``MOST_WINDOWS``; a larger one becomes a bitmap that
grows with it, two bits of ``BITS_EACH`` a window, up to ``MOST_BITS``; some one in seventy other windows passes it. What passes
travels as hashes (64 bits and an MD5 of the words) to a shuffled join. Beyond MOST_BITS the bitmap lets more through, the
join stays right. Both ways give the same rows.

Defined cases: null or empty texts and items have no words and no windows; a text without words is never contaminated
and its items_sha256 is that of the empty string; items with equal ids count once; an item with a null id marks words
but is not listed; repeated rows are each judged alone; further columns are ignored; no benchmark rows, no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import text_batches
from kinfold.llm.tokens import Tokens, U, Words, pieces, windows_of
from kinfold.session import materialize

WIDTH = 13
#: A share of hit words from which a document is contaminated.
SHARE = 0.05
#: Windows that are broadcast; with their words and the table some 500 bytes each in a process.
MOST_WINDOWS = 200_000
#: Bits of the bitmap for each window of a larger set, and the most it has (128 MB in a process).
BITS_EACH, MOST_BITS = 16, 1 << 30
#: Bytes of the parts in which it is put together.
BITMAP_PART = 1 << 16
RULE = Words(space=False)


def _words(tokens: Tokens, first: int, length: int) -> bytes:
    return b" ".join(tokens.data[tokens.begin[i] : tokens.end[i]].tobytes().lower() for i in range(first, first + length))


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, length, hash, words of every distinct window of the items."""

    def cut(batches):
        for batch in pieces(batches, "text"):
            tokens, ids = Tokens(RULE, batch.column("text")), batch.column("item_id").to_pylist()
            rows = []
            for length in np.unique(np.minimum(tokens.count, width)):
                if length:
                    for at, h in zip(*windows_of(tokens, int(length)), strict=True):
                        if min(tokens.count[tokens.row[at]], width) == length:
                            rows.append((ids[tokens.row[at]], int(length), int(h.view(np.int64)), _words(tokens, int(at), int(length))))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["item_id", "length", "hash", "words"])

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item_id long, length int, hash long, words binary").distinct()


def _marked(tokens: Tokens, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hit words of each row, for windows by first word and length."""
    edge = np.zeros(len(tokens.hash) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.bincount(tokens.row[np.cumsum(edge[:-1]) > 0], minlength=tokens.rows)


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, and n_words, n_hit, n_items, items, items_sha256, contaminated of its ``text``."""
    spark = docs.sparkSession
    text_batches(spark)
    windows = materialize(benchmark_windows(benchmark, width), "windows")
    known = windows.count()
    hits = _by_set(docs, windows) if known <= most_windows else _by_join(docs, windows, known)
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(round(1 / SHARE)) * F.col("n_hit") >= F.col("n_words")))


def _by_set(docs: DataFrame, windows: DataFrame) -> DataFrame:
    table: dict[int, dict[int, list[tuple[bytes, int | None]]]] = {}
    for r in windows.toLocalIterator():
        table.setdefault(r.length, {}).setdefault(r.hash, []).append((bytes(r.words), r.item_id))
    keys = {length: np.sort(np.fromiter(t, np.int64, len(t)).view(U)) for length, t in table.items()}
    shared = docs.sparkSession.sparkContext.broadcast((table, keys))

    @F.arrow_udf("n_words long, n_hit long, n_items long, items array<long>, items_sha256 string")
    def scan(text: pa.Array) -> pa.Array:
        table, keys = shared.value
        out = []
        for batch in pieces([pa.record_batch([text], ["text"])], "text"):
            tokens = Tokens(RULE, batch.column("text"))
            found, lengths, items = [], [], [set() for _ in range(tokens.rows)]
            for length, known in keys.items():
                at, h = windows_of(tokens, length)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                for k in np.flatnonzero(known[place] == h):
                    first = int(at[k])
                    words = _words(tokens, first, length)
                    same = [item for w, item in table[length][int(h[k].view(np.int64))] if w == words]
                    if same:
                        found.append(first)
                        lengths.append(length)
                        items[tokens.row[first]].update(x for x in same if x is not None)
            hit = _marked(tokens, np.array(found, np.int64), np.array(lengths, np.int64))
            out += [{"n_words": int(n), "n_hit": int(h), "n_items": len(i), "items": sorted(i), "items_sha256": _digest(i)} for n, h, i in zip(tokens.count, hit, items, strict=True)]
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64())), ("items_sha256", pa.string())]))

    scanned = docs.select(F.struct("*").alias("row"), scan(F.col("text").cast("binary")).alias("_hits"))
    return scanned.select("row", "_hits.*")


def _bitmap_bits(windows: int) -> int:
    """The power of two that holds BITS_EACH bits a window, of 64 KB at least and MOST_BITS at most."""
    return min(MOST_BITS, max(BITMAP_PART * 8, 1 << max(0, BITS_EACH * windows - 1).bit_length()))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash: by its leading and by its last places."""
    n = bits.bit_length() - 1
    return (hashes >> U(64 - n)).astype(np.int64), (hashes & U(bits - 1)).astype(np.int64)


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each hash, set in tasks and put together in parts of fixed size; a task holds one bitmap."""

    def mark(batches):
        packed = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column("hash").to_numpy().view(U), bits):
                np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for i, own in enumerate(packed.reshape(-1, BITMAP_PART)):
            if own.any():
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])

    def merge(batches):
        at, bits = None, None
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("bits"), strict=True):
                own = np.frombuffer(own.as_buffer(), np.uint8)
                if part == at:
                    bits = bits | own
                    continue
                if at is not None:
                    yield pa.record_batch([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])
                at, bits = part, own
        if at is not None:
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    parts = windows.select("hash").mapInArrow(mark, "part int, bits binary").repartition("part").sortWithinPartitions("part")
    out = np.zeros((bits // 8 // BITMAP_PART, BITMAP_PART), np.uint8)
    for r in parts.mapInArrow(merge, "part int, bits binary").toLocalIterator():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _by_join(docs: DataFrame, windows: DataFrame, known: int) -> DataFrame:
    """The way for ``known`` windows, more than are broadcast: candidates by a bitmap, checked by a join on the hash and the MD5 of the words."""
    spark = docs.sparkSession
    lengths = [r.length for r in windows.select("length").distinct().collect()]
    bits = _bitmap_bits(known)
    shared = spark.sparkContext.broadcast((_bitmap(windows, bits), lengths))
    kind = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("hash", pa.int64()), ("sum", pa.binary())])

    @F.arrow_udf("n_words long, found array<struct<at:int,length:int,hash:long,sum:binary>>")
    def scan(text: pa.Array) -> pa.Array:
        packed, lengths = shared.value
        out = []
        for batch in pieces([pa.record_batch([text], ["text"])], "text"):
            tokens = Tokens(RULE, batch.column("text"))
            start = np.cumsum(tokens.count) - tokens.count
            rows: list[list[dict]] = [[] for _ in range(tokens.rows)]
            for length in lengths:
                at, h = windows_of(tokens, length)
                first, second = ((packed[bit >> 3] >> (7 - (bit & 7))) & 1 for bit in _places(h, bits))
                for k in np.flatnonzero(first & second):
                    row = tokens.row[at[k]]
                    rows[row].append({"at": int(at[k] - start[row]), "length": length, "hash": int(h[k].view(np.int64)), "sum": hashlib.md5(_words(tokens, int(at[k]), length)).digest()})
            out += [{"n_words": int(n), "found": r} for n, r in zip(tokens.count, rows, strict=True)]
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("found", pa.list_(kind))]))

    scanned = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"), scan(F.col("text").cast("binary")).alias("s")).select("rid", "row", "s.*"), "candidates")
    found = scanned.select("rid", F.explode("found").alias("f")).select("rid", "f.*").join(windows.select("item_id", "length", "hash", F.unhex(F.md5("words")).alias("sum")), ["length", "hash", "sum"])
    hits = found.groupBy("rid").agg(F.collect_set("item_id").alias("items"), F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + length - 1)"))))).cast("long").alias("n_hit"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return (
        scanned.join(hits, "rid", "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<long>")))
        .select("row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    )


def digest(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark, width)
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows; the rest is left as it is."""
    return decontaminate(docs, benchmark).filter(~F.col("contaminated")).select("row.*")


ORACLE_SQL = """
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') win from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n)),
hits as (select rid, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.win = bw.win),
pos as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hits) group by rid),
it as (select rid, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct rid, item_id from hits) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (rid) left join it using (rid)
"""
