"""Language-model scoring with Brown classes.

P(word | before) = P(class of word | class of before) * P(word | its class). Counts of words and of pairs of neighbours
cover all training texts; every word seen ``MIN_COUNT`` times or more is assigned to one of ``CLASSES`` classes by the
exchange algorithm. The texts are written once as numbers of words. First the ``HEADS`` most frequent words move one after
the other, as often as it pays. Then, in turns, a pass counts the classes beside each word of a drawn part of all words;
these take their best classes under the broadcast class counts (all words without a class the first time), and the turn
counts only if the likelihood rises, else the part becomes smaller. It ends when a turn, carried on to all words, gains less
than ``TOLERANCE`` nats a token. Words beyond the ``BROADCAST`` most frequent ones take their best class once, at the end.
Rarer words have a class by their form (length, letters beyond ASCII, signs), which stands for unseen words, and the end of
a text is a class of its own, which also stands before each text.

The scores need the count and the class of every token. Those of the ``BROADCAST`` most frequent words are broadcast; the
other words of a text meet theirs in a shuffled join.

A word is known by 64 bits. Training texts are those whose crc32 of the id modulo 7 is not 2.

Defined cases: null and empty texts have one token, the end; without training texts the model is uniform over one word;
repeated rows are counted and scored each; null ids count as the empty text for crc32; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import crc_mod, text_batches
from kinfold.llm.tokens import Tokens, U, Words, buffers, lists, mix, pieces
from kinfold.session import materialize, scratch

FOLDS, HELD_OUT = 7, 2
HEADS, CLASSES = 512, 64
#: Training occurrences from which a word has a class of the exchange; the gain a token (nats) below which it ends.
MIN_COUNT, TOLERANCE = 2, 0.01
#: Cells of context that are weighed at once; words whose contexts lie in a task at once.
CELLS, BUCKET = 1 << 13, 4096
#: Words whose counts are broadcast: 16 bytes each.
BROADCAST = 1 << 20
#: Forms of words below MIN_COUNT.
LENGTHS, FORMS = 9, 36
#: Weight of the class distribution in transitions, in tokens.
SMOOTHING = 1.0
#: Distinct words that a task gathers before it passes its counts on.
FLUSH = 1 << 21
#: Contexts that a task gathers before it passes their counts on: equal ones travel as one.
CONTEXTS = 1 << 22
RULE = Words()


def forms(tokens: Tokens) -> np.ndarray:
    """A class by form for each word: length, letters beyond ASCII, signs."""
    d = tokens.data
    within = lambda flag: (c := np.concatenate([[0], np.cumsum(flag)]))[tokens.end] - c[tokens.begin]
    wide = within(d >= 128) > 0
    signs = within(~((d >= 128) | ((d >= 48) & (d <= 57)) | ((d >= 65) & (d <= 90)) | ((d >= 97) & (d <= 122)))) > 0
    return (np.minimum((tokens.end - tokens.begin) // 2, LENGTHS - 1) * 4 + wide * 2 + signs).astype(np.int16)


def forms_of(word: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The forms of the sorted distinct words of ``held`` (words, forms). A word has one form, wherever it stands."""
    high = word >> U(6)
    if len(word) and not (high[1:] == high[:-1]).any():
        # Forms take the place of six bits that no two words need: sorting values is much faster than sorting places.
        return (np.unique(np.concatenate([h & ~U(63) | f.astype(U) for h, f in held])) & U(63)).astype(np.int16)
    out = np.zeros(len(word), np.int16)
    for h, f in held:
        out[np.searchsorted(word, h)] = f
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """word, form, n over all of ``texts`` (text binary)."""

    def count(batches):
        word, form, n = np.zeros(0, U), np.zeros(0, np.int16), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def fold():
            nonlocal word, form, n
            every = np.concatenate([np.zeros(0, U), *(h for h, _ in held)])
            new, count = np.unique(every, return_counts=True)
            form_ = forms_of(new, held)
            held.clear()
            merged = np.union1d(word, new)
            old, at = np.searchsorted(merged, word), np.searchsorted(merged, new)
            forms_, total = np.zeros(len(merged), np.int16), np.zeros(len(merged), np.int64)
            forms_[old], forms_[at] = form, form_
            total[old] += n
            total[at] += count
            word, form, n = merged, forms_, total

        def out():
            return pa.record_batch([pa.array(word.view(np.int64)), pa.array(form), pa.array(n)], ["word", "form", "n"])

        for batch in pieces(batches, "text"):
            tokens = Tokens(RULE, batch.column("text"))
            held.append((tokens.hash, forms(tokens)))
            size += len(tokens.hash)
            if size > FLUSH:
                fold()
                size = 0
                if len(word) > FLUSH:
                    yield out()
                    word, form, n = np.zeros(0, U), np.zeros(0, np.int16), np.zeros(0, np.int64)
        fold()
        yield out()

    return texts.mapInArrow(count, "word long, form short, n long").groupBy("word").agg(F.min("form").alias("form"), F.sum("n").alias("n"))


class Model:
    """What scoring needs: sorted frequent words with counts and classes, transitions, emission sizes."""

    def index(self) -> None:
        """Notes where the words with each beginning start: hashes spread evenly, so a lookup reads about one word from there."""
        bits = max(1, len(self.word).bit_length())
        self.shift = U(64 - bits)
        self.first = np.minimum(np.searchsorted(self.word, np.arange(1 << bits, dtype=U) << self.shift), max(0, len(self.word) - 1)).astype(np.int32)

    def places(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """For each word: its place among the broadcast ones, whether it is one of them."""
        if not len(self.word):
            return np.zeros(len(tokens.hash), np.int64), np.zeros(len(tokens.hash), bool)
        at = self.first[tokens.hash >> self.shift].astype(np.int64)
        last, left = len(self.word) - 1, np.arange(len(at))
        while len(left := left[(self.word[at[left]] < tokens.hash[left]) & (at[left] < last)]):
            at[left] += 1
        return at, self.word[at] == tokens.hash

    def labels(self, tokens: Tokens, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its class (by form if not broadcast), its count (0 if not broadcast), whether it is broadcast."""
        at, found = self.places(tokens)
        label, n = CLASSES + 1 + form.astype(np.int64), np.zeros(len(at), np.int64)
        label[found], n[found] = self.label[at[found]], self.n[at[found]]
        return label, n, found

    def path(self, label: np.ndarray, count: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row, the logarithms of its class transitions without those of the words' class sizes, but for ``open_`` words.

        Also what is needed to add these once their classes are known: each run of open words between its neighbours, as
        labels (those of open words as ``~label``), where each row's labels end, and the places of the open words among them.
        """
        rows = len(count)
        after, free = np.insert(label, cut := np.cumsum(count), CLASSES), np.insert(open_, cut, False)
        before, last = np.concatenate([[CLASSES], after[:-1]]), np.concatenate([[False], free[:-1]])
        row, own = np.repeat(np.arange(rows), count + 1), np.repeat(np.arange(rows), count)
        path = np.bincount(row, np.where(free | last, 0.0, self.transition[before, after]), rows) - np.bincount(own, np.where(open_, 0.0, self.spread[label]), rows)
        # A text ends with its end: something stands behind each word.
        at = np.flatnonzero(free)
        first, final = ~last[at], ~free[at + 1]
        size = 1 + first + final
        start = np.cumsum(size) - size
        runs = np.zeros(size.sum(), np.int16)
        runs[start[first]] = before[at[first]]
        runs[start + first] = ~after[at].astype(np.int16)
        runs[(start + size - 1)[final]] = after[at[final] + 1]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[at], size, rows).astype(np.int64))])
        return path, runs, ends, start + first - ends[row[at]]


TOTAL = CLASSES + 1 + FORMS


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(classes: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, from their bigram counts."""
    return float(_xlogx(classes).sum() - _xlogx(classes.sum(0)).sum() - _xlogx(classes.sum(1)).sum())


def best_class(own: int, after: np.ndarray, before: np.ndarray, itself: float, classes: np.ndarray) -> tuple[int, float]:
    """The class with the highest likelihood for a word of class ``own``, and the gain over staying.

    after, before: counts of the classes behind and before the word, without the word itself.
    """
    n = classes.copy()
    n[own] -= after
    n[:, own] -= before
    n[own, own] -= itself
    rows, columns = classes.sum(1), classes.sum(0)
    rows[own] -= after.sum() + itself
    columns[own] -= before.sum() + itself
    k = np.arange(CLASSES)
    gain = (_xlogx(n[:CLASSES] + after) - _xlogx(n[:CLASSES])).sum(1) + (_xlogx(n[:, :CLASSES] + before[:, None]) - _xlogx(n[:, :CLASSES])).sum(0)
    both = n[k, k]
    gain += _xlogx(both + after[k] + before[k] + itself) - _xlogx(both + after[k]) - _xlogx(both + before[k]) + _xlogx(both)
    gain -= _xlogx(rows[k] + after.sum() + itself) - _xlogx(rows[k]) + _xlogx(columns[k] + before.sum() + itself) - _xlogx(columns[k])
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[own])


def settle(pairs: np.ndarray, of: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Moves heads one after the other until a sweep gains less than ``least``; their classes, and the class counts.

    pairs: counts of neighbours, of heads first and of the classes of all other words behind them; of: classes of heads.
    """
    label = np.concatenate([of, np.arange(TOTAL)])
    one = np.zeros((len(label), TOTAL))
    one[np.arange(len(label)), label] = 1
    classes = one.T @ (pairs @ one)
    gained = np.inf
    while gained >= least and len(of):
        gained = 0.0
        for w in range(len(of)):
            own, itself = int(label[w]), float(pairs[w, w])
            after, before = np.bincount(label, pairs[w], TOTAL), np.bincount(label, pairs[:, w], TOTAL)
            after[own] -= itself
            before[own] -= itself
            best, gain = best_class(own, after, before, itself, classes)
            if gain > 1e-9 and best != own:
                for k, sign in ((own, -1), (best, 1)):
                    classes[k] += sign * after
                    classes[:, k] += sign * before
                    classes[k, k] += sign * itself
                label[w] = best
                gained += gain
    return label[: len(of)], classes


def context_keys(flat: np.ndarray, cut: np.ndarray, label: np.ndarray, drawn: np.ndarray, buckets: int) -> np.ndarray:
    """A key of bucket, word in the bucket and near for each context of the drawn words of a batch of codes.

    near: the class behind the word, TOTAL + the class before it, or 2 TOTAL for the word itself behind it.
    """
    before = np.roll(flat, 1)
    before[cut[:-1]] = len(label) - 1
    ahead, behind = drawn[before], drawn[flat]
    twice = flat[behind & (before == flat)]
    word = np.concatenate([before[ahead], flat[behind], twice]).astype(np.int64)
    near = np.concatenate([label[flat[ahead]], TOTAL + label[before[behind]], np.full(len(twice), 2 * TOTAL, label.dtype)])
    return (word % buckets) << 50 | (word // buckets) << 16 | near


CONTEXT = 2 * TOTAL + 1
#: Counts of a cell that are looked up instead of computed.
LOOKED_UP = 16


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_class`` of many words at once (a row each); the gain of a word of a fixed class is infinite.

    Only cells with counts are weighed, as all others gain nothing.
    """
    k, each = np.arange(CLASSES), np.arange(len(own))
    free = own < CLASSES
    gain = np.zeros((len(own), CLASSES))
    for counts, others, n in ((after, before, classes[:CLASSES].T), (before, after, classes[:, :CLASSES])):
        table = _xlogx(n[None] + np.arange(LOOKED_UP + 1)[:, None, None]) - _xlogx(n)[None]
        w, c = np.nonzero(counts)
        for i in range(0, len(w), CELLS):
            v, d = w[i : i + CELLS], c[i : i + CELLS]
            add = counts[v, d]
            plain = (add <= LOOKED_UP) & (own[v] != d)
            delta = table[np.minimum(add, LOOKED_UP).astype(np.int64), d]
            at = np.flatnonzero(plain & free[v])
            stay = n[d[at], own[v[at]]]
            delta[at, own[v[at]]] = _xlogx(stay) - _xlogx(stay - add[at])
            at = np.flatnonzero(~plain)
            if len(at):
                base, u = n[d[at]].copy(), v[at]
                f = np.flatnonzero(free[u])
                base[f, own[u[f]]] -= add[at[f]]
                f = np.flatnonzero(own[u] == d[at])
                base[f] -= others[u[f], :CLASSES]
                f = f[free[u[f]]]
                base[f, own[u[f]]] -= itself[u[f]]
                delta[at] = _xlogx(base + add[at, None]) - _xlogx(base)
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            gain[v[start]] += np.add.reduceat(delta, start, axis=0)
    rows, columns, both = (np.tile(x[:CLASSES], (len(own), 1)) for x in (classes.sum(1), classes.sum(0), np.diagonal(classes)))
    out, into, itself_ = after.sum(1) + itself, before.sum(1) + itself, itself[:, None]
    f, o = each[free], own[free]
    rows[f, o] -= out[free]
    columns[f, o] -= into[free]
    both[f, o] -= after[f, o] + before[f, o] + itself[free]
    a, b = after[:, :CLASSES], before[:, :CLASSES]
    gain += _xlogx(both + a + b + itself_) - _xlogx(both + a) - _xlogx(both + b) + _xlogx(both)
    gain -= _xlogx(rows + out[:, None]) - _xlogx(rows) + _xlogx(columns + into[:, None]) - _xlogx(columns)
    best = gain.argmax(1)
    won = np.full(len(own), np.inf)
    won[f] = gain[f, best[f]] - gain[f, o]
    return best, won


def chosen(word: np.ndarray, cells: np.ndarray, own: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that gain by moving and their new classes; ``cells``: a row of CONTEXT counts each."""
    after, before, itself = cells[:, :TOTAL].astype(float), cells[:, TOTAL : 2 * TOTAL].astype(float), cells[:, 2 * TOTAL].astype(float)
    each = np.arange(len(word))
    after[each, own] -= itself
    before[each, own] -= itself
    seen = cells.any(1)
    best, gain = best_classes(own[seen], after[seen], before[seen], itself[seen], classes)
    go = gain > 1e-9
    return word[seen][go], best[go]


class Codes:
    """The training texts as numbers of words, and passes over them.

    codes: 32-bit numbers for each text, ending with the end of the text. The words known by number are ``word``; behind them
    come the forms of the other words, then the end. rest: hashes of the words that are not broadcast, where the model is deep.
    """

    def __init__(self, texts: DataFrame, model: Model, form: np.ndarray):
        self.spark, self.size = texts.sparkSession, len(model.word)
        self.fixed = np.concatenate([CLASSES + 1 + np.arange(FORMS), [CLASSES]])
        shared = self.spark.sparkContext.broadcast(model)

        def encode(batches):
            m = shared.value
            for batch in pieces(batches, "text"):
                tokens = Tokens(RULE, batch.column("text"))
                at, found = m.places(tokens)
                code = len(m.word) + forms(tokens).astype(np.int64)
                own = np.flatnonzero(found)
                own = own[m.n[at[own]] >= MIN_COUNT]
                code[own] = at[own]
                cut = np.cumsum(tokens.count)
                code = np.insert(code, cut, len(m.word) + FORMS)
                ends = np.concatenate([[0], cut + np.arange(1, len(cut) + 1)]) * 4
                rare = ~found if m.deep else np.zeros(len(found), bool)
                rest = np.concatenate([[0], np.cumsum(np.bincount(tokens.row[rare], minlength=tokens.rows))]) * 8
                yield pa.record_batch([_binary(code.astype(np.int32), ends), _binary(tokens.hash[rare], rest)], ["codes", "rest"])

        self.both = materialize(texts.mapInArrow(encode, "codes binary, rest binary"), "codes")
        shared.destroy()
        self.table = self.both.select("codes")
        # Words below MIN_COUNT are never met by number.
        self.start = np.where(model.n >= MIN_COUNT, CLASSES + 1 + form.astype(np.int64), -1)

    def labels(self, own: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(own, 0), self.fixed]).astype(np.int16)

    def pairs(self, label: np.ndarray, kinds: int) -> np.ndarray:
        """Counts of neighbours under ``label`` (below ``kinds``) over all texts."""
        shared = self.spark.sparkContext.broadcast(label.astype(np.int16))

        def count(batches):
            total = np.zeros(kinds * kinds, np.int64)
            for batch in batches:
                flat, cut = _flat(batch.column("codes"))
                now = shared.value[flat].astype(np.int64)
                before = np.roll(now, 1)
                before[cut[:-1]] = shared.value[-1]
                total += np.bincount(before * kinds + now, minlength=kinds * kinds)
            key = np.flatnonzero(total)
            yield pa.record_batch([pa.array(key), pa.array(total[key])], ["key", "n"])

        got = self.table.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        out = np.zeros(kinds * kinds)
        out[got["key"].to_numpy()] = got["n"].to_numpy()
        return out.reshape(kinds, kinds)

    def moved(self, own: np.ndarray, classes: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """``own`` after each drawn word has taken its best class.

        A task counts contexts and deals them to buckets of words; a bucket holds a dense table of its words' contexts,
        which all tasks' counts are added to, whatever their number.
        """
        label, size = self.labels(own), self.size
        buckets = max(1, -(-size // BUCKET))
        shared = self.spark.sparkContext.broadcast((label, np.concatenate([drawn & (own >= 0), np.zeros(FORMS + 1, bool)]), classes))

        def count(batches):
            label, drawn, _ = shared.value
            held, size = [], 0

            def out():
                key, n = np.unique(np.concatenate(held), return_counts=True)
                bucket = key >> 50
                start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, np.int64)
                cut = np.append(start, len(key))
                held.clear()
                return pa.record_batch([pa.array(bucket[start].astype(np.int32)), lists(((key >> 16) & ((1 << 34) - 1)).astype(np.int32), cut), lists((key & 0xFFFF).astype(np.int16), cut), lists(n.astype(np.int32), cut)], ["bucket", "word", "near", "n"])

            for batch in batches:
                held.append(context_keys(*_flat(batch.column("codes")), label, drawn, buckets))
                size += len(held[-1])
                if size > CONTEXTS:
                    yield out()
                    size = 0
            if held:
                yield out()

        def move(batches):
            label, _, classes = shared.value
            at, table = None, None

            def out():
                word = np.arange(len(table)) * buckets + at
                word, best = chosen(word, table, label[word].astype(np.int64), classes)
                return pa.record_batch([pa.array(word.astype(np.int32)), pa.array(best.astype(np.int16))], ["word", "best"])

            for batch in batches:
                for i in range(batch.num_rows):
                    bucket = batch.column("bucket")[i].as_py()
                    if bucket != at:
                        if at is not None:
                            yield out()
                        at, table = bucket, np.zeros((len(range(bucket, size, buckets)), CONTEXT), np.int64)
                    word, near, n = (batch.column(c)[i].values.to_numpy() for c in ("word", "near", "n"))
                    # A task's cells are distinct.
                    table[word, near] += n
            if at is not None:
                yield out()

        dealt = self.table.mapInArrow(count, "bucket int, word array<int>, near array<short>, n array<int>").repartition("bucket").sortWithinPartitions("bucket")
        # Written, so that the shuffle of this turn goes before the next one.
        got = materialize(dealt.mapInArrow(move, "word int, best short"), "moved").toArrow()
        # Nothing reads it again: its copies on the disks of driver and executors go.
        shared.destroy()
        after = own.copy()
        after[got["word"].to_numpy()] = got["best"].to_numpy()
        return after


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the values' bytes, cut at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts of a batch, and where each begins."""
    data, offsets = buffers(codes)
    return data.view(np.int32), offsets // 4


def exchange(codes: Codes, n: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word known by number (-1: seen too rarely), and the class bigram counts."""
    own = codes.start.copy()
    heads = np.lexsort((np.arange(len(n)), -n))[:HEADS]
    heads = heads[own[heads] >= 0]
    # The most frequent words settle first, one after the other, among the forms of all others.
    of = own.copy()
    of[heads] = TOTAL + np.arange(len(heads))
    seen = codes.pairs(codes.labels(of), TOTAL + HEADS)
    order = np.concatenate([TOTAL + np.arange(len(heads)), np.arange(TOTAL)])
    own[heads], classes = settle(seen[np.ix_(order, order)], np.arange(len(heads)) % CLASSES, TOLERANCE * tokens / 4)
    rest = own >= CLASSES
    if rest.any():
        # Words without a class open in their best one; then part after part moves.
        own = codes.moved(own, classes, rest)
        classes = codes.pairs(codes.labels(own), TOTAL)
        now, parts, turn, gain = likelihood(classes), 2, 0, np.inf
        while gain * parts >= TOLERANCE * tokens:
            turn += 1
            tried = codes.moved(own, classes, mix(np.arange(len(own)).astype(U) + U(turn << 40)) % U(parts) == 0)
            counted = codes.pairs(codes.labels(tried), TOTAL)
            gain = likelihood(counted) - now
            if gain < 0:
                parts, gain = parts * 2, np.inf
            else:
                own, classes, now = tried, counted, now + gain
    return own, classes


def deep_labels(codes: Codes, counts: DataFrame, model: Model, own: np.ndarray, classes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """word, label of the words that are not broadcast and seen MIN_COUNT times or more: the best class beside the others.

    Also the class bigram counts with these classes. All broadcast words of a deep model are known by number, so the forms
    among the codes stand for the others.
    """
    size = codes.size
    shared = codes.spark.sparkContext.broadcast((codes.labels(own), classes))

    def placed(batches):
        """Of each batch: classes, which words are not broadcast, and their hashes."""
        for batch in pieces(batches, "codes"):
            flat, cut = _flat(batch.column("codes"))
            rare = (flat >= size) & (flat < size + FORMS)
            word = np.zeros(len(flat), U)
            word[rare] = buffers(batch.column("rest"))[0].view(U)
            yield shared.value[0][flat].astype(np.int32), rare, word, cut

    def count(batches):
        """A row for each occurrence: its class by form, whether the word follows itself, the classes before and behind it (TOTAL more for words that are not broadcast)."""
        for near, rare, word, cut in placed(batches):
            at, beside = np.flatnonzero(rare), near + TOTAL * rare
            before = np.roll(beside, 1)
            before[cut[:-1]] = CLASSES
            # A text ends with its end: something stands behind each word.
            twice = rare[at + 1] & (word[at + 1] == word[at])
            yield pa.record_batch([pa.array(word[at].view(np.int64)), pa.array((near[at] * 2 + twice) << 16 | before[at] << 8 | beside[at + 1], pa.int32())], ["word", "cell"])

    def move(batches):
        """The best class of each word, and what it changes in the class counts beside words that are broadcast."""
        change, held, rows = np.zeros(TOTAL * TOTAL, np.int64), [], 0

        def out(word, cell):
            nonlocal change
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            n = np.diff(np.append(start, len(word)))
            keep = n >= MIN_COUNT
            start, cell, row = start[keep], cell[np.repeat(keep, n)], np.repeat(np.arange(keep.sum()), n[keep])
            word, own = word[start], (cell >> 17)[np.cumsum(n[keep]) - n[keep]].astype(np.int64)
            after, before, twice = cell & 255, cell >> 8 & 255, (cell >> 16 & 1).astype(bool)
            key = np.concatenate([row * CONTEXT + after % TOTAL, row * CONTEXT + TOTAL + before % TOTAL, row[twice] * CONTEXT + 2 * TOTAL])
            at, best = chosen(np.arange(len(word)), np.bincount(key, minlength=len(word) * CONTEXT).reshape(-1, CONTEXT), own, shared.value[1])
            new = own.copy()
            new[at] = best
            for label, sign in ((own, -1), (new, 1)):
                a, b = after < TOTAL, before < TOTAL
                key = np.concatenate([label[row[a]] * TOTAL + after[a], before[b] * TOTAL + label[row[b]]])
                change += sign * np.bincount(key, minlength=TOTAL * TOTAL)
            return pa.record_batch([pa.array(word[at]), pa.array(best.astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], ["word", "label", "cell", "n"])

        for batch in batches:
            held.append((batch.column("word").to_numpy(), batch.column("cell").to_numpy()))
            rows += batch.num_rows
            if rows >= 2 * BUCKET:
                word, cell = (np.concatenate(x) for x in zip(*held, strict=True))
                # The last word may go on.
                whole = int(np.searchsorted(word, word[-1]))
                if whole:
                    yield out(word[:whole], cell[:whole])
                held, rows = [(word[whole:], cell[whole:])], len(word) - whole
        if rows:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
        at = np.flatnonzero(change)
        yield pa.record_batch([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(change[at])], ["word", "label", "cell", "n"])

    def both(batches):
        """The neighbours that are both not broadcast, and their classes by form."""
        for near, rare, word, _ in placed(batches):
            at = np.flatnonzero(rare[:-1] & rare[1:])
            yield pa.record_batch([pa.array(x) for x in (word[at].view(np.int64), word[at + 1].view(np.int64), near[at], near[at + 1])], ["before", "after", "before_near", "after_near"])

    # An occurrence travels once; words seen too rarely are told by their few rows.
    dealt = codes.both.mapInArrow(count, "word long, cell int").repartition("word").sortWithinPartitions("word")
    moves = materialize(dealt.mapInArrow(move, "word long, label int, cell int, n long"), "deep")
    labels = moves.filter("word is not null").select("word", "label")
    got = moves.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = classes.copy()
    out.reshape(-1)[got["cell"].to_numpy()] += got["n"].to_numpy()
    named = codes.both.mapInArrow(both, "before long, after long, before_near int, after_near int")
    for side in ("before", "after"):
        named = named.join(labels.select(F.col("word").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
    ends = [c for side in ("before", "after") for c in (F.col(f"{side}_near").alias(f"{side}_old"), F.coalesce(f"{side}_label", f"{side}_near").alias(f"{side}_new"))]
    named = materialize(named.select(*ends).groupBy("before_old", "before_new", "after_old", "after_new").agg(F.count("*").alias("n")), "beside").toArrow()
    shared.destroy()
    for state, sign in (("old", -1), ("new", 1)):
        np.add.at(out, (named[f"before_{state}"].to_numpy(), named[f"after_{state}"].to_numpy()), sign * named["n"].to_numpy())
    return labels, out


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the training words that are not broadcast (word, n, label)."""
    texts = docs.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("text").cast("binary").alias("text"))
    counts = materialize(word_counts(texts), "words")
    ends = texts.count()
    model = Model()
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model.tokens, model.types, model.ends = words + ends, types + (1 if ends else 0), ends
    # The least count of a broadcast word: the words at or above it are BROADCAST at most.
    steps, total, least = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")), 0, None
    for r in steps.toLocalIterator():
        total += r.k
        if total > BROADCAST:
            break
        least = r.n
    got = counts.filter(F.col("n") >= least).toArrow() if least is not None else None
    model.word, form, model.n = (got[c].to_numpy() if got else np.zeros(0, np.int64) for c in ("word", "form", "n"))
    del got
    order = np.argsort(model.word.view(U))
    model.word, form, model.n = model.word[order].view(U), form[order], model.n[order]
    model.index()
    model.least = least
    # Whether words that are not broadcast can have a class of the exchange.
    model.deep = least is None or least > MIN_COUNT
    rare = counts.filter(F.col("n") < least) if least is not None else counts
    own = (F.lit(CLASSES + 1) + F.col("form")).cast("int")
    with scratch(docs.sparkSession):
        codes = Codes(texts, model, form)
        label, classes = exchange(codes, model.n, max(1, model.tokens))
        if model.deep:
            labels, classes = deep_labels(codes, counts, model, label, classes)
            rare = rare.join(labels, "word", "left").select("word", "n", F.coalesce("label", own).alias("label"))
            rare = materialize(rare, "rare", outlive=True)
        else:
            rare = rare.select("word", "n", own.alias("label"))
    model.label = np.where(label < 0, CLASSES + 1 + form.astype(np.int64), label).astype(np.int16)
    after = classes.sum(0)
    share = (after + 1) / (after.sum() + TOTAL)
    model.transition = np.log10((classes + SMOOTHING * share) / (classes.sum(1, keepdims=True) + SMOOTHING))
    # Tokens and distinct words of each class.
    size, kinds = np.bincount(model.label, model.n, TOTAL), np.bincount(model.label, minlength=TOTAL).astype(float)
    for r in rare.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        size[r.label] += r.n
        kinds[r.label] += r.k
    model.spread = np.log10(size + kinds + 1)
    model.spread[CLASSES] = 0.0
    return model, rare


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text_batches(spark)
    model, rare = train(docs)
    shared = spark.sparkContext.broadcast(model)
    kind = [("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("path", pa.float64()), ("rest", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("labels", pa.list_(pa.int16()))]

    @F.arrow_udf("n_tokens long, known long, logs double, path double, rest array<long>, at array<int>, labels array<short>")
    def scan(text: pa.Array) -> pa.Array:
        m = shared.value
        out = []
        for batch in pieces([pa.record_batch([text], ["text"])], "text"):
            tokens = Tokens(RULE, batch.column("text"))
            label, n, found = m.labels(tokens, forms(tokens))
            total = lambda x: np.bincount(tokens.row, x, tokens.rows)
            logs = total(np.log10(n + 1.0)) + np.log10(m.ends + 1.0)
            known = total(found.astype(float)) + (1 if m.ends else 0)
            rest = np.concatenate([[0], np.cumsum(np.bincount(tokens.row[~found], minlength=tokens.rows))])
            # Places and classes matter only where words that are not broadcast can have a class of the exchange.
            path, runs, ends, at = m.path(label, tokens.count, ~found & m.deep)
            out.append(pa.StructArray.from_arrays([pa.array(tokens.count + 1), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(path), lists(tokens.hash[~found], rest), lists(at.astype(np.int32), rest if m.deep else rest * 0), lists(runs, ends)], [k for k, _ in kind]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(kind))

    transition, spread = model.transition, model.spread

    @F.arrow_udf("double")
    def path(runs: pa.Array, places: pa.Array, named: pa.Array) -> pa.Array:
        """What the runs of open words add, with the classes ``named`` at ``places``."""
        count = np.diff(runs.offsets.to_numpy())
        cut, own = np.concatenate([[0], np.cumsum(count)]), np.repeat(np.arange(len(count)), count)
        label = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        free = label < 0
        label[free] = ~label[free]
        row = np.repeat(np.arange(len(places)), places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        label[cut[row] + places.flatten().to_numpy(zero_copy_only=False)] = named.flatten().to_numpy(zero_copy_only=False)
        # Runs begin and end with known words: no transition leads from one to the next.
        pair = np.flatnonzero(free[:-1] | free[1:])
        return pa.array(np.bincount(own[pair], transition[label[pair], label[pair + 1]], len(count)) - np.bincount(own[free], spread[label[free]], len(count)))

    first = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), scan(F.col("text").cast("binary")).alias("s")).select("rid", "doc_id", "held_out", "s.*")
    first = materialize(first, "scored")
    shared.destroy()
    # Words that are not broadcast meet their counts and classes; sums of logarithms and classes by place come back.
    found = first.select("rid", F.explode(F.arrays_zip("rest", "at")).alias("w")).select("rid", F.col("w.rest").alias("word"), F.col("w.at").alias("at")).join(rare, "word")
    sums = [F.sum(F.log10(F.col("n") + 1)).alias("more_logs"), F.count("*").alias("more_known")]
    found = found.groupBy("rid").agg(*sums, *([F.collect_list(F.struct("at", "label")).alias("named")] if model.deep else []))
    joined = first.drop("rest", "at").join(found, "rid", "left")
    if model.deep:
        joined = joined.withColumn("path", F.col("path") + path("labels", "named.at", "named.label"))
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1))
    # P(word | class) takes the same logarithms, without that of the end.
    score = F.col("path") + logs - float(np.log10(model.ends + 1.0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def digest(docs: DataFrame) -> DataFrame:
    return lm_scores(docs.select("doc_id", "text"))
