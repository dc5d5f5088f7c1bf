"""Line dedup by pairwise alignment.

Written line ends cut passages in different places, so a text is flowed anew into lines that begin where the words say so:
of every ``MIN_WORDS - KEY_WORDS + 1`` places in a row the one whose next ``KEY_WORDS`` words have the least hash begins a
line, and these words are its key. Whatever stands around it, a passage of MIN_WORDS words begins a line at the same word
in all its documents. Keys that two documents or more share are rare and lead the later documents to the first that holds
them, so that a passage of many documents makes one pair for each of them and none between them.

The lines of a pair are aligned by patience diff: those whose key stands once in either document, in their longest common
order (where none does, one after the other with the place that holds most around it), each grown word by word to both sides. Aligned blocks of MIN_WORDS words or
more leave the later document. Alignment repeats on the lines that are left, until none is, so that moved and repeated
blocks go too. Where a block stays below MIN_WORDS words, the documents of its key meet once more by all windows of
MIN_WORDS words around it. Then no later document keeps MIN_WORDS words in a row that an earlier one holds, and every word
that goes stands in such a row.

Documents come in the order of their ids. Words are runs of anything but blanks, known by 64 bits; case counts.

Defined cases: null and empty texts share nothing and stay as they are; rows with equal id and text are one document and
lose the same words; equal ids with different texts are documents in the order of a hash of the text; null ids come last;
repeats inside one document stay; further columns, of any name, are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import BROADCAST_ROWS, shuffled, sized_join, small, text_batches
from kinfold.llm.tokens import Tokens, U, Words, lists, mix, pieces, windows_of
from kinfold.session import materialize, scratch

MIN_WORDS, KEY_WORDS = 50, 12
#: Later documents that are aligned with one document in one task; parts of the join of keys.
PARTNERS, SALTS = 512, 16
#: Most keys of several rows that are broadcast, 8 bytes each.
BROADCAST_KEYS = 1 << 20
RULE = Words(fold=False)
LAST_ID = 2**63 - 1


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over every ``width`` values in a row."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def line_starts(tokens: Tokens, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Word and key of the beginning of every line of a batch."""
    at, key = windows_of(tokens, KEY_WORDS)
    width = max(1, min_words - KEY_WORDS + 1)
    if len(key) < width:
        return at[:0], key[:0]
    least = _sliding(key, width, np.minimum)
    row = tokens.row[at]
    least[row[: len(least)] != row[width - 1 :]] = 0
    none = np.zeros(width - 1, U)
    chosen = key == _sliding(np.concatenate([none, least, none]), width, np.maximum)
    return at[chosen], key[chosen]


def _longest_order(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading values are equal."""
    n, step, done = min(len(x), len(y)), 64, 0
    while done < n:
        differ = np.flatnonzero(x[done : min(n, done + step)] != y[done : min(n, done + step)])
        if len(differ):
            return done + int(differ[0])
        done, step = min(n, done + step), step * 2
    return n


class Lines:
    """The words of a document and where its lines begin."""

    def __init__(self, words: np.ndarray, at: np.ndarray, key: np.ndarray, least: int = MIN_WORDS):
        self.words, self.at, self.key, self.least = words, at, key, least
        self.known: dict[int, list[int]] = {}

    def around(self, p: int) -> tuple[int, bytes]:
        """What decides whether a block of ``least`` words that holds word p can be aligned."""
        low = max(0, p - self.least)
        return p - low, self.words[low : p + self.least].tobytes()

    @cached_property
    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys in order, and where their lines begin."""
        order = np.argsort(self.key, kind="stable")
        return self.key[order], self.at[order]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of ``keys`` begin a line."""
        own, _ = self.order
        if not len(own):
            return np.zeros(len(keys), bool)
        return own[np.minimum(np.searchsorted(own, keys), len(own) - 1)] == keys

    def places(self, h: int) -> list[int]:
        """Where lines of key h begin; of those that stand among the same words, the first."""
        if h not in self.known:
            own, at = self.order
            low, high = (np.searchsorted(own, own.dtype.type(h), side) for side in ("left", "right"))
            v = at[low:high].tolist()
            self.known[h] = list({self.around(p): p for p in reversed(v)}.values())[::-1] if len(v) > 1 else v
        return self.known[h]

    @cached_property
    def windows(self) -> np.ndarray:
        """A hash of every ``least`` words in a row."""
        return _sliding(self.words.view(U), self.least, lambda x, y: mix(x) + y) if len(self.words) >= self.least else np.zeros(0, U)

    @cached_property
    def ordered_windows(self) -> np.ndarray:
        return np.unique(self.windows)

    def shared(self, theirs: Lines) -> np.ndarray:
        """Which words stand in a row of ``least`` words that ``theirs`` holds; equal hashes may add some."""
        edge = np.zeros(len(self.words) + 1, np.int64)
        if len(theirs.windows):
            own, held = self.windows, theirs.ordered_windows
            at = np.flatnonzero(held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own)
            edge[at] += 1
            edge[at + self.least] -= 1
        return np.cumsum(edge[:-1]) > 0


def _best_place(mine: Lines, p: int, theirs: Lines, places: list[int]) -> int | None:
    """The place that the longest block around word p is aligned with; none if all are too short."""
    n, at = mine.least, np.array(places)
    total = np.zeros(len(at), np.int64)
    for step, first in ((1, 0), (-1, -1)):
        own, their = p + first + step * np.arange(n), at[:, None] + first + step * np.arange(n)
        fine = (own >= 0) & (own < len(mine.words)) & (their >= 0) & (their < len(theirs.words))
        same = fine & (mine.words[own % len(mine.words)] == theirs.words[their % len(theirs.words)])
        total += np.where(same.all(1), n, same.argmin(1))
    k = int(np.argmax(total))
    return places[k] if total[k] >= n else None


def aligned_blocks(mine: Lines, theirs: Lines) -> tuple[list[tuple[int, int]], list[int]]:
    """First word and end of the blocks of ``mine`` that alignment with ``theirs`` takes out, and the keys of too short ones."""
    gone = np.zeros(len(mine.words), bool)
    blocks, short = [], set()

    def grown(p: int, q: int) -> bool:
        """Takes out the block around a pair of equal words, if it is long enough."""
        a = p - _reach(mine.words[:p][::-1], theirs.words[:q][::-1])
        b = p + _reach(mine.words[p:], theirs.words[q:])
        if b - a >= mine.least:
            gone[a:b] = True
            blocks.append((a, b))
        return b - a >= mine.least

    left = np.flatnonzero(theirs.holds(mine.key))
    live = dict(zip(mine.at[left].tolist(), mine.key[left].tolist(), strict=True))
    while live:
        times = Counter(live.values())
        once = [(p, theirs.places(h)[0]) for p, h in live.items() if times[h] == 1 and len(theirs.places(h)) == 1]
        for k in _longest_order([q for _, q in once]):
            p, q = once[k]
            if not gone[p] and not grown(p, q):
                short.add(live.pop(p))
        if not once:
            # What is grown covers most of the lines behind it, and what shares no window has no place: few places are compared.
            shared = mine.shared(theirs)
            for p, h in live.items():
                if gone[p]:
                    continue
                place = _best_place(mine, p, theirs, theirs.places(h)) if shared[p] else None
                if place is None:
                    short.add(h)
                else:
                    grown(p, place)
            break
        live = {p: h for p, h in live.items() if not gone[p]}
    return blocks, sorted(short)


def _key(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def key_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_hash and the distinct line keys of each document."""

    def cut(batches):
        for batch in pieces(batches, "text"):
            tokens = Tokens(RULE, batch.column("text"))
            at, key = line_starts(tokens, min_words)
            order = np.lexsort((key, tokens.row[at]))
            row, key = tokens.row[at][order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=tokens.rows))])
            yield pa.record_batch([batch.column("id"), batch.column("text_hash"), lists(key[new], offsets)], ["id", "text_hash", "keys"])

    return _key(docs).mapInArrow(cut, "id long, text_hash long, keys array<long>").filter(F.size("keys") > 0)


def _pairs(table: DataFrame) -> DataFrame:
    """id, text_hash of a later document and first_id, first_hash of the first one that holds one of its keys."""
    held = table.select("id", "text_hash", F.explode("keys").alias("key"))
    # Most keys stand in one document. Plain counts tell them, so that documents are compared for the others only.
    often = materialize(held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "often")
    # A key of very many documents is met in several parts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).cast("int")
    few = small(often, BROADCAST_KEYS)
    shared = held.join(F.broadcast(often), "key") if few else held.withColumn("salt", salt).join(shuffled(often.withColumn("salt", salts)), ["key", "salt"])
    shared = materialize(shared.select("key", "id", "text_hash"), "shared", files=not few).select("key", F.struct("id", "text_hash").alias("doc"))
    first = shared.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last").select("key", "first")
    first = materialize(first, "first")
    if small(first, min(BROADCAST_KEYS, BROADCAST_ROWS)):
        held = shared.join(F.broadcast(first), "key")
    else:
        # Spark takes the table for as large as its files; exploded, it is SALTS times that.
        salted = shared.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        held = salted.join(shuffled(first.withColumn("salt", salts)), ["key", "salt"])
    return held.filter("doc <> first").select("doc.*", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash")).distinct()


def _aligned(met: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """id, text_hash, blocks and short (keys of too short blocks) for the pairs ``met``, a materialised table."""
    parts = met.groupBy("first_id", "first_hash").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    later = met.join(parts, ["first_id", "first_hash"]).select("id", "text_hash", "first_id", "first_hash", F.pmod(F.xxhash64("id", "text_hash"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    firsts = parts.select(F.col("first_id").alias("id"), F.col("first_hash").alias("text_hash"), "first_id", "first_hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    roles = materialize(later.unionByName(firsts), "roles")
    texts = sized_join(_key(docs), roles, ["id", "text_hash"])
    by = ["first_id", "first_hash", "part"]
    ordered = texts.repartition(*by).sortWithinPartitions(*by, "role", "id", "text_hash")

    def align(batches):
        at, theirs, last = None, None, None
        for batch in pieces(batches, "text"):
            tokens = Tokens(RULE, batch.column("text"))
            begin, key = line_starts(tokens, min_words)
            cut = np.concatenate([[0], np.cumsum(tokens.count)])
            of = np.searchsorted(begin, cut)
            group, role, doc = (list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True)) for columns in (by, ["role"], ["id", "text_hash"]))
            out = []
            for i in range(tokens.rows):
                # A repeated row is aligned once.
                if (group[i], doc[i]) == last:
                    continue
                last = group[i], doc[i]
                lines = Lines(tokens.hash[cut[i] : cut[i + 1]].copy(), begin[of[i] : of[i + 1]] - cut[i], key[of[i] : of[i + 1]], min_words)
                if role[i][0] == 0:
                    at, theirs = group[i], lines
                elif at == group[i]:
                    blocks, short = aligned_blocks(lines, theirs)
                    out.append((*doc[i], [{"a": a, "b": b} for a, b in blocks], np.array(short, U).view(np.int64).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["id", "text_hash", "blocks", "short"])

    aligned = ordered.mapInArrow(align, "id long, text_hash long, blocks array<struct<a:int,b:int>>, short array<long>")
    # Little is left of the texts: a few files instead of one for each task that read them.
    return materialize(aligned.repartition("id", "text_hash"), "aligned")


def _windows(asked: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """id, text_hash, keys: hashes of the windows of ``min_words`` words around the keys that ``asked`` names for each document."""

    def cut(batches):
        for batch in pieces(batches, "text"):
            tokens = Tokens(RULE, batch.column("text"))
            begin, key = line_starts(tokens, min_words)
            at, window = windows_of(tokens, min_words)
            keys = batch.column("keys")
            row, asked = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy()), keys.flatten().to_numpy().view(U)
            # Beginnings of asked keys, by row and key.
            pair = lambda r, k: np.rec.fromarrays([r.astype(np.int64), k])
            wanted = np.isin(pair(tokens.row[begin], key), pair(row, asked)) if len(begin) and len(asked) else np.zeros(len(begin), bool)
            around = np.zeros(len(tokens.hash) + 1, np.int64)
            low = np.maximum(begin[wanted] - (min_words - KEY_WORDS), 0)
            np.add.at(around, low, 1)
            np.add.at(around, begin[wanted] + 1, -1)
            near = np.cumsum(around)[at] > 0
            at, window = at[near], window[near]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(tokens.row[at], minlength=tokens.rows))])
            yield pa.record_batch([batch.column("id"), batch.column("text_hash"), lists(window, offsets)], ["id", "text_hash", "keys"])

    few = small(asked)
    texts = _key(docs).join(F.broadcast(asked) if few else asked, ["id", "text_hash"])
    windows = texts.mapInArrow(cut, "id long, text_hash long, keys array<long>").select("id", "text_hash", F.array_distinct("keys").alias("keys"))
    return materialize(windows, "windows", files=not few)


def repeated_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_hash, blocks (first word, end) of the documents that lose words."""
    table = materialize(key_table(docs, min_words), "keys", files=False)
    met = materialize(_pairs(table), "pairs")
    found = _aligned(met, docs, min_words)
    # The first document that holds a key may hold too little around it where another holds enough. Such keys are asked
    # for once more, by all whole windows around them.
    short = found.select(F.explode("short").alias("key")).distinct()
    asked = table.select("id", "text_hash", F.explode("keys").alias("key")).join(short, "key").groupBy("id", "text_hash").agg(F.collect_list("key").alias("keys"))
    windows = _windows(materialize(asked, "asked"), docs, min_words)
    # Pairs that have been aligned share no window any more.
    more = materialize(_pairs(windows).join(met, met.columns, "left_anti"), "pairs")
    found = found.select("id", "text_hash", "blocks").unionByName(_aligned(more, docs, min_words).select("id", "text_hash", "blocks"))
    return found.filter(F.size("blocks") > 0).groupBy("id", "text_hash").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))


def without_blocks(text: pa.Array, blocks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without the words of ``blocks``, and how many words and blocks went. Blanks beside a block go with it, but one line end stays."""
    out, words, count = [], [], []
    for row in range(len(text)):
        tokens = Tokens(RULE, text[row : row + 1])
        flat = blocks[row].values
        edge = np.zeros(len(tokens.hash) + 1, np.int64)
        np.add.at(edge, flat.field(0).to_numpy(), 1)
        np.add.at(edge, flat.field(1).to_numpy(), -1)
        gone = np.cumsum(edge[:-1]) > 0
        step = np.diff(np.concatenate([[0], gone, [0]]))
        a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        data, n = tokens.data, len(tokens.hash)
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        begin, end = np.append(tokens.begin, len(data)), np.concatenate([[0], tokens.end])
        # Whether the block begins a line; end[k] is the end of the word before k.
        opens = (a == 0) | (newline[begin[a]] > newline[end[a]])
        closes = (b < n) & (newline[begin[b]] > newline[end[b]])
        inner = ~opens & (closes | (b == n))
        low, high = np.where(inner, end[a], begin[a]), np.where(inner & (b < n), end[b], begin[b])
        mark = np.zeros(len(data) + 1, np.int64)
        np.add.at(mark, low, 1)
        np.add.at(mark, high, -1)
        out.append(data[np.cumsum(mark[:-1]) == 0].tobytes())
        words.append(int(gone.sum()))
        count.append(len(a))
    return pa.array(out, pa.binary()), np.array(words, np.int64), np.array(count, np.int64)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` in struct ``row``, and new_text, dropped_words, dropped_blocks."""
    spark = docs.sparkSession
    text_batches(spark)
    with scratch(spark):
        drops = materialize(repeated_blocks(docs.select("doc_id", "text"), min_words), "drops", outlive=True)

    @F.arrow_udf("text binary, words long, blocks long")
    def cut(text: pa.Array, blocks: pa.Array) -> pa.Array:
        some = np.flatnonzero(blocks.is_valid().to_numpy(zero_copy_only=False))
        new, words, count = without_blocks(text.take(pa.array(some)), blocks.take(pa.array(some)))
        at = np.full(len(text), -1)
        at[some] = np.arange(len(some))
        at = pa.array(at, mask=at < 0)
        return pa.StructArray.from_arrays([new.take(at), pa.array(words).take(at), pa.array(count).take(at)], ["text", "words", "blocks"])

    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("text_hash"))
    joined = sized_join(keyed, drops, ["id", "text_hash"], "left")
    # Only texts that lose words go to Python.
    done = joined.select("row", cut(F.when(F.col("blocks").isNotNull(), F.col("row.text")).cast("binary"), "blocks").alias("new"))
    return done.select("row", F.coalesce(F.col("new.text").cast("string"), "row.text").alias("new_text"), F.coalesce("new.words", F.lit(0)).cast("long").alias("dropped_words"), F.coalesce("new.blocks", F.lit(0)).cast("long").alias("dropped_blocks"))


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("row.doc_id", F.col("new_text").alias("text"), "dropped_words", "dropped_blocks")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text, without the rows of which nothing is left; n_chars follows the text."""
    changed = F.col("dropped_words") > 0
    done = line_dedup(docs).filter(~changed | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    kept: dict[str, Column] = {"text": F.col("new_text")}
    columns = [kept.get(c, F.when(changed, F.length("new_text").cast(t)).otherwise(F.col("row")[c]) if c == "n_chars" else F.col("row")[c]).alias(c) for c, t in docs.dtypes]
    return done.select(*columns)
