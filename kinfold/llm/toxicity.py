"""Toxicity by non-negative positive-unlabelled learning.

Classifiers are trained from documents marked toxic and from unlabelled text. With the share pi of toxic documents, the
risk on clean text is that of unlabelled text less pi times that of toxic text taken as clean; where it falls below zero
on a batch, the step goes the other way, so that the classifier does not learn the toxic documents by heart.
Features are presence of words and of word beginnings, hashed; those that toxic documents have clearly more often than
unlabelled ones, or less often, take part. A few classifiers see different samples, each in a task of its own; their mean
scores every whole text.

The share pi is estimated from toxic and unlabelled rows alone, so that labels may hold nothing but toxic documents: a
classifier of one half of a sample scores the other half, and of all score thresholds the one where unlabelled rows are
least frequent against toxic ones, by a bound of their ratio, gives pi: there, nearly all that unlabelled text has is
toxic. It may be given as a parameter instead.

Labels come from training rows only (crc32 of the id modulo 5 is not 0). The samples are bounded: MOST_TOXIC toxic and
MOST_UNLABELLED unlabelled training rows for each classifier. Their features are counted and chosen before any row travels.

Defined cases: null and empty texts have the score of the bias; labels of one id count once, toxic if any row says so;
null labels and ids without a document do not count; without toxic training rows every score is PRIOR; repeated rows
have equal scores; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import crc_mod, text_batches
from kinfold.llm.linear import fit, margins, sigmoid
from kinfold.llm.tokens import Tokens, U, Words, lists, mix, pieces
from kinfold.session import materialize, scratch

FOLDS, HELD_OUT = 5, 0
DIMENSIONS = 1 << 18
#: Bytes of word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
CLASSIFIERS = 3
MOST_TOXIC, MOST_UNLABELLED = 4096, 12288
#: The share of toxic documents where there are no toxic rows to estimate it from, and the bounds of the estimate.
PRIOR, PRIOR_BOUNDS = 0.1, (0.005, 0.5)
#: Features that take part: the most, and the least standard score of the difference in frequency, which rises from 0 with
#: the number of toxic samples to LEAST_Z; at HALF_Z samples it is half of it.
MOST_FEATURES, LEAST_Z, HALF_Z = 4096, 5.0, 50
STEPS, BATCH_TOXIC, BATCH_UNLABELLED = 400, 1024, 4096
#: Steps of the classifiers that estimate the share.
PRIOR_STEPS = 100
RATE = 0.05
#: Weight decay times the number of toxic samples.
PENALTY = 0.03
RULE = Words()


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row and the row offsets."""
    tokens = Tokens(RULE, column)
    parts, owners = [tokens.hash], [tokens.row]
    for k in BEGINNINGS:
        long = np.flatnonzero(tokens.end - tokens.begin > k)
        begin = tokens.begin[long]
        parts.append(mix(RULE.hashes(tokens.data, begin, begin + k) ^ U(k * 0x9E3779B9)) if len(long) else np.zeros(0, U))
        owners.append(tokens.row[long])
    key = np.concatenate(owners).astype(np.int64) * DIMENSIONS + (np.concatenate(parts) % U(DIMENSIONS)).astype(np.int64)
    key = np.unique(key)
    return (key % DIMENSIONS).astype(np.int32), np.searchsorted(key, np.arange(tokens.rows + 1) * DIMENSIONS)


def _counts(batches):
    """feature, p, u: how many toxic and how many unlabelled rows have each feature."""
    p, u = np.zeros(DIMENSIONS, np.int64), np.zeros(DIMENSIONS, np.int64)
    for batch in pieces(batches, "text"):
        index, cut = features(batch.column("text"))
        toxic = np.repeat(batch.column("toxic").to_numpy(), np.diff(cut)) == 1
        p += np.bincount(index[toxic], minlength=DIMENSIONS)
        u += np.bincount(index[~toxic], minlength=DIMENSIONS)
    seen = np.flatnonzero(p + u)
    yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(p[seen]), pa.array(u[seen])], ["feature", "p", "u"])


def _select(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The features that tell most."""
    rate = (p + u + 1) / (n_p + n_u + 2)
    z = np.abs(p / n_p - u / n_u) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u))
    chosen = np.argsort(-z, kind="stable")[:MOST_FEATURES]
    return np.sort(chosen[z[chosen] >= LEAST_Z * n_p / (n_p + HALF_Z)])


def _slope(prior: float, toxic: np.ndarray):
    """The derivative of the non-negative risk with the logistic loss."""

    def slope(z: np.ndarray, rows: np.ndarray) -> np.ndarray:
        p = toxic[rows]
        n_p, n_u = max(1, p.sum()), max(1, (~p).sum())
        s = sigmoid(z)
        loss_clean = np.logaddexp(0, z)
        clean_risk = loss_clean[~p].sum() / n_u - prior * loss_clean[p].sum() / n_p
        clean_slope = np.where(p, -prior * s / n_p, s / n_u)
        if clean_risk < 0:
            return -clean_slope
        return clean_slope + np.where(p, prior * (s - 1) / n_p, 0)

    return slope


def toxic_share(toxic: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of toxic rows in ``unlabelled``, from scores of either kind: the least ratio of both tails, bounded from above."""
    at = np.unique(toxic)
    n_p, n_u = len(toxic), len(unlabelled)
    # Rows that score as high or higher.
    p = (n_p - np.searchsorted(np.sort(toxic), at)) / n_p
    u = (n_u - np.searchsorted(np.sort(unlabelled), at)) / n_u
    # The most that the standard deviations of both shares can be: thin tails have the widest bounds.
    best = np.argmin((u + (n_p**-0.5 + n_u**-0.5) / 2) / p)
    return float(u[best] / p[best])


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """One classifier from one sample of rows with their chosen features by number."""
    pdf = pdf.sort_values(["toxic", "order", "doc_id"], kind="stable")
    seed, prior, size = int(pdf.bag.iloc[0]), float(pdf.prior.iloc[0]), int(pdf["size"].iloc[0])
    index = np.concatenate([np.asarray(x, np.int64) for x in pdf["index"]])
    cut = np.concatenate([[0], np.cumsum([len(x) for x in pdf["index"]])]).astype(np.int64)
    toxic = pdf.toxic.to_numpy(bool)
    rng = np.random.default_rng(seed)
    draw = lambda rows, n: rng.choice(rows, min(n, len(rows)), replace=False) if len(rows) else rows

    def fitted(rows: np.ndarray, share: float, steps: int) -> tuple[np.ndarray, float]:
        p, u = rows[toxic[rows]], rows[~toxic[rows]]
        batches = [np.concatenate([draw(p, BATCH_TOXIC), draw(u, BATCH_UNLABELLED)]) for _ in range(steps)]
        return fit(size, index, None, cut, _slope(share, toxic), batches, RATE, PENALTY / max(1, len(p)))

    if prior <= 0:
        # Equal rows have one order and stay in one half.
        half, found = pdf["order"].to_numpy() % 2 == 0, []
        for one in (half, ~half):
            if (toxic & one).any() and (~toxic & one).any() and (toxic & ~one).any() and (~toxic & ~one).any():
                z = margins(*fitted(np.flatnonzero(one), PRIOR, PRIOR_STEPS), index, None, cut)
                found.append(toxic_share(z[toxic & ~one], z[~toxic & ~one]))
        prior = float(np.clip(np.mean(found), *PRIOR_BOUNDS)) if found else PRIOR
    weights, bias = fitted(np.arange(len(toxic)), prior, STEPS)
    return pd.DataFrame({"weights": [weights.astype(np.float32)], "bias": [bias], "prior": [prior]})


def train(docs: DataFrame, labels: DataFrame, toxic_label: str = "toxic", prior: float | None = None) -> tuple[np.ndarray, float] | None:
    """Mean weights and bias of the classifiers, from the training rows of ``docs`` (doc_id, text); prior: the share of toxic documents."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(toxic_label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col(toxic_label).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", "text")
    rows = docs.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col("text").cast("binary").alias("text"), order.alias("order"))
    marked = marked.filter(crc_mod(F.col("label_id"), FOLDS) != HELD_OUT)
    n_toxic = marked.filter("toxic = 1").count()
    n_rows = rows.count()
    if not n_toxic or not n_rows:
        return None
    # Rows are sampled by ranges of a hash, so that a classifier gets about its bound of them whatever the table's size.
    share = lambda n, most: min(1.0, most / n)
    drawn = lambda salt, p: (F.pmod(F.xxhash64("order", F.lit(salt)), F.lit(1 << 30)) < int(p * (1 << 30)))
    toxic_ids = marked.filter("toxic = 1").filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share(n_toxic, MOST_TOXIC) * (1 << 30)))
    every = F.sequence(F.lit(1), F.lit(CLASSIFIERS))
    positive = rows.join(F.broadcast(toxic_ids), rows.doc_id == F.col("label_id")).select("doc_id", "text", "order", F.lit(1).alias("toxic"), every.alias("bags"))
    p = share(n_rows, MOST_UNLABELLED)
    bags = F.filter(F.array(*[F.when(drawn(i, p), F.lit(i)) for i in range(1, CLASSIFIERS + 1)]), lambda x: x.isNotNull())
    unlabelled = rows.select("doc_id", "text", "order", F.lit(0).alias("toxic"), bags.alias("bags")).filter(F.size("bags") > 0)
    with scratch(docs.sparkSession):
        sample = materialize(positive.unionByName(unlabelled), "sample")
        n_p, n_u = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
        if not n_p or not n_u:
            return None
        counts = sample.select("text", "toxic").mapInArrow(_counts, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
        seen = counts["feature"].to_numpy()
        of = lambda c: np.bincount(seen, counts[c].to_numpy(), DIMENSIONS)
        chosen = _select(of("p"), of("u"), n_p, n_u)
        number = np.full(DIMENSIONS, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        shared = docs.sparkSession.sparkContext.broadcast(number)

        @F.arrow_udf("array<int>")
        def known(text: pa.Array) -> pa.Array:
            out = []
            for batch in pieces([pa.record_batch([text], ["text"])], "text"):
                index, cut = features(batch.column("text"))
                index = shared.value[index]
                kept = np.concatenate([[0], np.cumsum(index >= 0)])
                out.append(lists(index[index >= 0], kept[cut]))
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

        # Only the numbers of chosen features travel to the classifiers.
        bagged = sample.select("doc_id", "order", "toxic", F.explode("bags").alias("bag"), known("text").alias("index"))
        bagged = bagged.withColumn("prior", F.lit(float(prior or 0))).withColumn("size", F.lit(len(chosen)))
        fitted = bagged.groupBy("bag").applyInPandas(_train, "weights array<float>, bias double, prior double").collect()
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[chosen] = np.mean([np.array(r.weights, np.float32) for r in fitted], axis=0)
    return weights, float(np.mean([r.bias for r in fitted]))


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text); prior: the share of toxic documents, estimated if not given."""
    text_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, prior=prior))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if model.value is None:
            return pa.array(np.full(len(text), PRIOR))
        out = []
        for batch in pieces([pa.record_batch([text], ["text"])], "text"):
            index, cut = features(batch.column("text"))
            out.append(sigmoid(margins(*model.value, index, None, cut)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(F.col("text").cast("binary")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
