"""Quality by a weak-label model.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of all vote
patterns of all documents estimates each labeller's accuracy and the share of good texts; a pattern's posterior labels
the documents that have it. A linear scorer over hashed word shapes learns the posterior labels of a bounded sample
(MOST_TRAINING distinct texts at most, by a hash, weighed by their copies) and scores every whole text; documents below KEEP are rejected. No gold label is
used.

Defined cases: null and empty texts get no votes and the score of a text without shapes, which is kept; repeated rows
score alike; further columns are kept as they are and not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import text_batches
from kinfold.llm.linear import fit, margins, sigmoid
from kinfold.llm.tokens import Tokens, U, Words, mix, pieces
from kinfold.session import materialize

KEEP = 0.5
DIMENSIONS = 1 << 14
MOST_TRAINING = 20_000
EM_ROUNDS = 60
STEPS, BATCH, RATE, DECAY = 600, 512, 0.05, 1e-5
RULE = Words(fold=False)
#: Each labeller: its measure, bad from here on, good within these bounds (None: never). In between it says nothing.
LABELLERS = (
    ("symbols", 0.08, None),
    ("wordless", 0.2, None),
    ("marks", 0.4, None),
    ("stutter", 0.25, None),
    ("sameness", 0.8, (0.0, 0.6)),
    ("upper", 0.5, (0.0, 0.2)),
    ("stops", 9.0, (0.02, 0.4)),
)
#: Words from which sameness tells anything.
LEAST_WORDS = 40


class Shapes:
    """What the labellers and the scorer read off a batch: counts for each word."""

    def __init__(self, column: pa.Array):
        tokens = Tokens(RULE, column)
        d = tokens.data
        letter = ((d >= 65) & (d <= 90)) | ((d >= 97) & (d <= 122)) | (d >= 128)
        digit = (d >= 48) & (d <= 57)
        odd = np.isin(d, np.frombuffer(b"#$%&*!|~^<>{}[]\\=_@", np.uint8))
        within = lambda flag: (c := np.concatenate([[0], np.cumsum(flag)]))[tokens.end] - c[tokens.begin]
        self.tokens, self.length = tokens, tokens.end - tokens.begin
        self.letters, self.digits, self.odd = within(letter), within(digit), within(odd)
        self.upper, self.lower = within((d >= 65) & (d <= 90)), within((d >= 97) & (d <= 122))
        self.last = d[tokens.end - 1] if len(tokens.end) else np.zeros(0, np.uint8)
        self.wordless = self.letters + self.digits == 0
        same = tokens.hash[1:] == tokens.hash[:-1]
        self.again = np.concatenate([[False], same & (tokens.row[1:] == tokens.row[:-1])]) if len(tokens.hash) else np.zeros(0, bool)

    def per_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.tokens.row, x, self.tokens.rows)

    def measures(self) -> dict[str, np.ndarray]:
        t = self.tokens
        n = np.maximum(t.count, 1)
        part = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), np.nan)
        distinct = np.bincount(np.unique(t.row.astype(np.int64) << 44 | (t.hash >> U(20)).astype(np.int64)) >> 44, minlength=t.rows)
        # Words that end in a sign which is neither a letter or digit nor ends a clause, a quotation or a bracket.
        plain = np.isin(self.last, np.frombuffer(b".,;:?\"')]}", np.uint8)) | (self.last >= 128)
        ends = self.per_row(~plain & ~((self.last >= 48) & (self.last <= 57)) & ~((self.last >= 65) & (self.last <= 90)) & ~((self.last >= 97) & (self.last <= 122)))
        return {
            "symbols": part(self.per_row(self.odd), self.per_row(self.length)),
            "upper": np.where(t.count >= 5, part(self.per_row(self.upper), self.per_row(self.upper + self.lower)), np.nan),
            "wordless": part(self.per_row(self.wordless), t.count),
            "stutter": np.where(t.count >= 5, self.per_row(self.again) / n, np.nan),
            # A longer text repeats more of its words; a tenth for every tenfold length is no defect.
            "sameness": np.where(t.count >= LEAST_WORDS, 1 - distinct / n - 0.1 * np.log10(n / LEAST_WORDS + 1e-9), np.nan),
            "marks": part(ends, t.count),
            "stops": np.where(t.count >= 5, self.per_row(np.isin(self.last, np.frombuffer(b".,;:?", np.uint8))) / n, np.nan),
        }

    def votes(self) -> np.ndarray:
        """A digit in base 4 for each labeller: 0 nothing, 1 bad, 2 good, 3 too little text to tell."""
        measures, code = self.measures(), np.zeros(self.tokens.rows, np.int64)
        for name, bad, good in LABELLERS:
            m = measures[name]
            low, high = good or (1.0, 0.0)
            code = code * 4 + np.where(np.isnan(m), 3, np.where(m >= bad, 1, np.where((m >= low) & (m <= high), 2, 0)))
        return code

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed shapes of each row, the share of words that have them, and row offsets."""
        t = self.tokens
        last = np.where((self.last >= 97) & (self.last <= 122) | (self.last >= 128), 97, np.where((self.last >= 65) & (self.last <= 90), 65, np.where((self.last >= 48) & (self.last <= 57), 48, self.last)))
        case = np.where(self.upper == 0, 0, np.where((self.lower == 0) & (self.upper > 1), 2, 1))
        shape = ((np.minimum(self.odd, 3) * 4 + case) * 2 + (self.digits > 0)) * 2 + self.again
        shape = shape * 256 + last
        size = np.minimum(self.length, 40) // 8
        codes = [mix(shape.astype(U) ^ U(0x1234567)) % U(DIMENSIONS), mix((shape * 8 + size).astype(U) ^ U(0x7654321)) % U(DIMENSIONS)]
        key = np.concatenate([t.row.astype(np.int64) * DIMENSIONS + c.astype(np.int64) for c in codes])
        key, n = np.unique(key, return_counts=True)
        row = key // DIMENSIONS
        return key % DIMENSIONS, n / np.maximum(t.count[row], 1), np.searchsorted(key, np.arange(t.rows + 1) * DIMENSIONS)


def votes(docs: DataFrame) -> DataFrame:
    """``docs`` in struct ``row``, and the vote pattern of each text."""

    @F.arrow_udf("long")
    def vote(text: pa.Array) -> pa.Array:
        out = [Shapes(b.column("text")).votes() for b in pieces([pa.record_batch([text], ["text"])], "text")]
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return docs.select(F.struct("*").alias("row"), vote(F.col("text").cast("binary")).alias("votes"))


def label_model(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """The posterior of good for each vote pattern, and each labeller's share of right votes, by expectation-maximisation."""
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes], float)
    k = len(LABELLERS)
    digits = np.array([[c // 4 ** (k - 1 - j) % 4 for j in range(k)] for c in codes])
    # The start: a vote for bad makes a text suspect. A labeller that only knows defects tells by its silence too, so that
    # saying nothing is an outcome like the others; too little text to tell is none.
    good = np.where((digits == 1).any(1), 0.25, 0.95)
    table = np.zeros((2, k, 3))
    for _ in range(EM_ROUNDS):
        share = (good @ n + 9) / (n.sum() + 10)
        for side, weight in ((0, (1 - good) * n), (1, good * n)):
            for j in range(k):
                seen = np.bincount(digits[:, j], weight, 4)[:3] + 1.0
                table[side, j] = seen / seen.sum()
        odds = np.log(share / (1 - share)) + sum(np.log(np.append(table[1, j] / table[0, j], 1.0))[digits[:, j]] for j in range(k))
        good = sigmoid(odds)
    right = np.array([((1 - share) * table[0, j, 1] + share * table[1, j, 2]) / max(1e-9, (1 - share) * table[0, j, 1:].sum() + share * table[1, j, 1:].sum()) for j in range(k)])
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), right


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` in struct ``row``, and posterior, score, keep of its ``text``."""
    spark = docs.sparkSession
    text_batches(spark)
    # Patterns are few, 4 to the number of labellers; their counts cover all documents.
    counts = {r.votes: r["count"] for r in votes(docs.select("text")).groupBy("votes").count().collect()}
    posterior, _ = label_model(counts) if counts else ({}, None)
    share = min(1.0, MOST_TRAINING / max(1, sum(counts.values())))
    # Copies of a text are drawn as one row with their number as its weight, so that no text can fill the sample.
    drawn = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("text").agg(F.count("*").alias("copies"))
    known = spark.sparkContext.broadcast(posterior)

    def sample(batches):
        for batch in pieces(batches, "text"):
            s = Shapes(batch.column("text"))
            index, value, cut = s.features()
            of = lambda v, t: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v, t))
            yield pa.record_batch([of(index.astype(np.int32), pa.int32()), of(value.astype(np.float32), pa.float32()), pa.array([known.value[v] for v in s.votes()], pa.float64()), batch.column("copies")], ["index", "value", "good", "copies"])

    rows = drawn.select(F.col("text").cast("binary").alias("text"), "copies").mapInArrow(sample, "index array<int>, value array<float>, good double, copies long")
    model = spark.sparkContext.broadcast(_train(materialize(rows, "shapes").toArrow()))

    @F.arrow_udf("posterior double, score double")
    def score(text: pa.Array) -> pa.Array:
        out = []
        for batch in pieces([pa.record_batch([text], ["text"])], "text"):
            s = Shapes(batch.column("text"))
            out += [{"posterior": known.value[v], "score": float(p)} for v, p in zip(s.votes(), sigmoid(margins(*model.value, *s.features())), strict=True)]
        return pa.array(out, pa.struct([("posterior", pa.float64()), ("score", pa.float64())]))

    scored = docs.select(F.struct("*").alias("row"), score(F.col("text").cast("binary")).alias("s"))
    return scored.select("row", "s.*").withColumn("keep", F.col("score") >= KEEP)


def _train(sample: pa.Table) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, from at most some MOST_TRAINING rows of a few dozen shapes."""
    if not sample.num_rows:
        return np.zeros(DIMENSIONS), 3.0
    # An order of the rows that does not depend on how they came: by a hash of their features.
    whole = sample.combine_chunks()
    lengths = whole["index"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    flat = mix(whole["index"].combine_chunks().flatten().to_numpy().astype(U) + U(1))
    total = np.concatenate([np.zeros(1, U), np.cumsum(flat, dtype=U)])
    end = np.cumsum(lengths)
    order = np.argsort(total[end] - total[end - lengths], kind="stable")
    rows = whole.take(pa.array(order))
    lengths = lengths[order]
    index = rows["index"].combine_chunks().flatten().to_numpy().astype(np.int32)
    value = rows["value"].combine_chunks().flatten().to_numpy()
    good = rows["good"].to_numpy()
    # A row is drawn into batches as often as its text stands in the corpus.
    share = rows["copies"].to_numpy() / rows["copies"].to_numpy().sum()
    rng = np.random.default_rng(7)
    cut = np.concatenate([[0], np.cumsum(lengths)])
    batches = [rng.choice(len(good), min(BATCH, len(good)), p=share) for _ in range(STEPS)]
    return fit(DIMENSIONS, index, value, cut, lambda z, pick: (sigmoid(z) - good[pick]) / len(pick), batches, RATE, DECAY)


def digest(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text")).select("row.doc_id", "posterior", "score", "keep")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the scorer rejects."""
    return quality(docs).filter("keep").select("row.*")
